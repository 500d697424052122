"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps the leading 32 bits of every shingle hash below a fixed fraction of the hash space, each value once, so its size
follows the document's, sketches of parts merge by union, and the share of a small document's sketch that lies in a large one's
estimates containment without bias however unequal they are. A text of which fewer than LEAST hashes lie below the fraction keeps
its LEAST smallest instead (all, if it has no more). How far a sketch reaches follows from its values, and two are compared up
to where both reach; short texts are thus compared exactly. A fingerprint writes the kept values in order, 8 hex digits each.

Defined cases: a null text counts as empty; a text without words has the empty fingerprint, like (1) to itself only;
fewer words than a shingle are one shingle; documents are in order of doc_id, nulls first, ties by a hash of the text;
a short text none of whose hashes lies where a long one's sketch reaches has likeness 0 to it; a single document is its own
next; an empty table gives an empty result. Identical rows are one key of the order and are streamed by one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_of
from .simhash import shingles, words

SHINGLE, FRACTION_BITS, LEAST = 5, 2, 16
#: Rows in a bucket of neighbouring ids, about; the most buckets (a bound on what is sent to every task: wider buckets stream longer);
#: keys read a bucket to place its bounds.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 2048, 1 << 16, 32
_SEED = 5
_END = 1 << (32 - FRACTION_BITS)


def _kept(values: np.ndarray) -> np.ndarray:
    """What a sketch keeps of all of a text's values, in order."""
    below = values[: int(np.searchsorted(values, _END))]
    return below if len(below) >= LEAST else values[:LEAST]


def sketch(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Kept values of a text, in order (below 2**32, each once)."""
    digest = xxhash.xxh64_intdigest
    found = shingles(words(text), shingle)
    hashes = np.fromiter((digest(s, _SEED) for s in found), dtype=np.uint64, count=len(found))
    return _kept(np.unique(hashes >> np.uint64(32)))


def _reach(a: np.ndarray) -> int:
    """Below which value a sketch holds all that its text has."""
    if len(a) < LEAST:
        return 1 << 32
    return max(_END, int(a[-1]) + 1)


def _up_to(a: np.ndarray, end: int) -> np.ndarray:
    return a[: int(np.searchsorted(a, end))]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two parts together."""
    return _kept(_up_to(np.union1d(a, b), min(_reach(a), _reach(b))))


def written(kept: np.ndarray) -> str:
    """The fingerprint."""
    return "".join([f"{h:08x}" for h in kept.tolist()])


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller document's shingles that the other has too, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    end = min(_reach(a), _reach(b))
    a, b = _up_to(a, end), _up_to(b, end)
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by the beginning of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bounds(keys: DataFrame, rows_a_bucket: int) -> list[tuple]:
    """Upper bounds of ranges of (known, doc_id, th) of about equal count, from a sample of SAMPLED keys a bucket."""
    total, grid = keys.count(), 1 << 30
    n = max(1, min(MOST_BUCKETS, -(-total // rows_a_bucket)))
    if n == 1:
        return []
    part = min(1.0, SAMPLED * n / total)
    taken = keys.where(F.pmod(F.xxhash64("th", "doc_id"), F.lit(grid)) < int(part * grid)).toArrow()
    found = sorted((d is not None, d or 0, th) for d, th in zip(taken.column(0).to_pylist(), taken.column(1).to_pylist(), strict=True))
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def _bucket(bounds: list[tuple]):
    """The range that a key lies in, as a function of its columns."""

    @F.arrow_udf("int")
    def run(ids: pa.Array, ths: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, (d is not None, d or 0, th)) for d, th in zip(ids.to_pylist(), ths.to_pylist(), strict=True)], pa.int32())

    return run("doc_id", "th")


def with_next(docs: DataFrame, rows_a_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Rows by bucket, each bucket ended by the first row of the next one (``guest`` 1), in order, for streaming.

    Texts are read twice, once for the keys and once to be shuffled; nothing else is read again.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    keys = materialize(rows.select("doc_id", "th"), "sketch-keys")
    bucket = _bucket(_bounds(keys, rows_a_bucket))
    firsts = keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")).alias("f"))
    # one row a bucket, MOST_BUCKETS at most
    order = W.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(W.partitionBy()))
    firsts = firsts.select(F.col("f.doc_id").alias("_id"), F.col("f.th").alias("_th"), before.alias("_before"))
    led = rows.withColumn("bucket", bucket).join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    places = F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("guest")))
    dealt = led.select("doc_id", "text", "th", F.explode(F.slice(places, F.lit(1), F.when(F.col("_before").isNull(), 1).otherwise(2))).alias("at"))
    dealt = dealt.select("doc_id", "text", "th", "at.bucket", "at.guest")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "th")


def fingerprint_documents(docs: DataFrame, rows_a_bucket: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""

    def row(one: tuple, other: tuple) -> tuple:
        changed = edited(one[1], other[1])
        new = sketch(changed)
        return one[0], len(one[1]), hashlib.sha256(changed.encode()).hexdigest(), written(one[2]), written(new), containment(one[2], new), containment(one[2], other[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = None, None
        for batch in batches:
            out = []
            for doc_id, text, where, guest in zip(*batch.columns, strict=True):  # one text at a time is a Python string
                text, where = text.as_py(), where.as_py()
                now = (doc_id.as_py(), text, sketch(text))
                if held is not None and bucket == where:
                    out.append(row(held, now))
                held, bucket = (None if guest.as_py() else now), where
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, rows_a_bucket).select("doc_id", "text", "bucket", "guest").mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """As the contract has it."""
    return fingerprint_documents(docs.select("doc_id", "text"))
