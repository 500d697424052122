"""Fill-in-the-middle: documents cut at two unit boundaries and written with the middle last.

A unit is a match of UNIT (a line with its end), matched left to right. Two passes over a lazy iterator of matches cut a text: the first
counts the units, the second stops at both ranks and notes where the matches before them end. No list of units or of their
places is ever held, so besides the text itself a row takes the same memory however many units it has.

Cuts and form follow from the sha256 of a seed and the document's id alone: runs, retries and lost executors give the same rows.

Scale: one pass over the rows, nothing is shuffled; texts are read in Arrow batches of a bounded size.

Defined cases: a null text is the empty text; an empty text, and one that contains a sentinel, stay plain, whole and in order; a null id
counts as the empty string; repeated rows give repeated rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and of those the percent that are written suffix first.
RATE, SPM_RATE, SEED = 100, 50, 7
_COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if text can neither hide nor complete one: none empty, inside another, or ending as one begins."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + 1) if i != j else len(a))):
                raise ValueError(f"sentinels must be told apart in any text: {a!r}, {b!r}")
    return sentinels


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that follow from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def ends(matches: Iterator[regex.Match], ranks: tuple[int, int]) -> list[int]:
    """Where the units before each of two ascending ranks end; the iterator is advanced no further than that."""
    found, done, end = [], 0, 0
    for rank in ranks:
        for match in islice(matches, rank - done):
            end = match.end()
        done = rank
        found.append(end)
    return found


def cut(text: str, doc_id: int | None, unit: regex.Pattern, sentinels: tuple[str, str, str], rate: int, spm_rate: int, seed: int) -> tuple:
    """units, form, code points of prefix and middle, and the text as it is written."""
    n = sum(1 for _ in unit.finditer(text))
    h = draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = ends(unit.finditer(text), (a, b))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = sentinels
    if h[3] % 100 < spm_rate:
        return n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = UNIT, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output (the text as it is written).

    ``unit`` must match without looking back; what it leaves unmatched belongs to the unit that follows, or to the suffix.
    """
    _checked(sentinels)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(unit)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            made = [(i.as_py(), *cut(t.as_py(), i.as_py(), pattern, sentinels, rate, spm_rate, seed)) for i, t in zip(*batch.columns, strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:5], arrays[5].cast(pa.string())], names)

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, _COLUMNS)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was written from, by its form alone."""
    p, s, m = sentinels
    begins = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substr(output, begins(a) + len(a), begins(b) - begins(a) - len(a))
    after = F.substr(output, begins(m) + len(m))
    psm = F.concat(between(p, s), after, between(s, m))
    spm = F.concat(between(p, m), after, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(docs: DataFrame) -> DataFrame:
    """Every document cut, with digests of what is written and of what is rebuilt from it."""
    rows = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rebuilt = digest(restored(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), rebuilt.alias("restored_sha256"))


def sql() -> str:
    """The same rows in DuckDB SQL, by lists of lines."""
    h = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM d),
r AS (SELECT *, len(lines) AS n, {h(0)} % (len(lines) + 1) AS a, {h(1)} % (len(lines) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {h(2)} % 100 >= {RATE} THEN 'plain'
    WHEN {h(3)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
  coalesce(array_to_string(lines[greatest(a, b) + 1:], ''), '') AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""
