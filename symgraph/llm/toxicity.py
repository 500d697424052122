"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct lower-cased words of the whole text and the stems of four and five letters that longer words begin with, each
hashed to one of TABLE rows. Every row has a weight and a factor vector: score = sigmoid(b + sum w_i x + sum over pairs <v_i, v_j> x^2),
the pairs in linear time. Pairwise terms learn what single weights miss, such as an insult beside the mention of a group.
No term is left out beforehand: weights are held down by an absolute-value penalty and factor vectors by one on their length, so
rows that tell nothing, alone or in pairs, end at zero. x = 1 / sqrt(1 + terms / LONG) keeps what is left from adding up in very long texts.

The model is fitted on the driver, on at most SAMPLE documents of each label, each given by at most TABLE numbers of 16 bits;
its parameters are a table of a fixed size. Every text is scored whole, in Arrow batches, without a shuffle.

Defined cases: null and empty texts have no terms and score the model's intercept; without labels of both kinds every
score is the prior (0 if there is none); repeated rows are scored each; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_of
from .labelled import sample

SAMPLE = {1: 3000, 0: 5000}
TABLE, FACTORS, LONG = 1 << 16, 4, 512
EPOCHS, BATCH, RATE, START = 10, 64, 0.15, 0.02
#: Penalties on a weight's absolute value, and on a factor vector's length.
WEIGHT_PENALTY, FACTOR_PENALTY = 1.5e-3, 3e-3
STEMS = (4, 5)
_WORD = re.compile(r"\w+")
#: Words that a worker remembers the terms of.
REMEMBER = 100_000


def terms_of_word(word: str) -> list[int]:
    """Rows of a lower-cased word: its own, and its stems' if it is longer."""
    return [zlib.crc32(b"w" + word.encode()) % TABLE] + [zlib.crc32(b"s" + word[:n].encode()) % TABLE for n in STEMS if len(word) > n]


class Terms:
    """Rows of texts' terms; what a frequent word's are is remembered."""

    def __init__(self) -> None:
        self._words: dict[str, list[int]] = {}

    def of(self, text: str) -> np.ndarray:
        """Distinct rows of a text's terms, in order."""
        if len(self._words) > REMEMBER:
            self._words.clear()
        known, out = self._words, set()
        for word in set(_WORD.findall(text.lower())):
            rows = known.get(word)
            if rows is None:
                rows = known[word] = terms_of_word(word)
            out.update(rows)
        return np.fromiter(sorted(out), dtype=np.uint16, count=len(out))


class FactorizationMachine:
    """Parameters of the fitted machine: an intercept, a weight and a factor vector a row."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, rows: np.ndarray) -> float:
        x = _size(len(rows))
        v = self.factors[rows] * x
        z = self.bias + self.weights[rows].sum() * x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _size(n: np.ndarray | int) -> np.ndarray | float:
    """What each of n terms counts."""
    return 1 / np.sqrt(1 + n / LONG)


def fit(found: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> FactorizationMachine:
    """A machine for documents given by their terms' rows: AdaGrad with proximal penalties, each class with the same total weight."""
    n, positive = len(labels), int(labels.sum())
    if not n or positive in (0, n):
        prior = positive / n if n else 0.0
        return FactorizationMachine(float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), np.zeros(TABLE), np.zeros((TABLE, FACTORS)))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(TABLE), rng.normal(0, START, (TABLE, FACTORS)), 0.0
    seen = np.zeros(TABLE, dtype=bool)
    seen[np.concatenate(found)] = True
    v[~seen] = 0
    gw, gv, gb = np.full(TABLE, 1e-4), np.full(TABLE, 1e-4), 1e-4
    weight = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            sizes = np.array([len(found[i]) for i in batch])
            rows = np.concatenate([found[i] for i in batch]).astype(np.int64)
            if not len(rows):
                continue
            doc, x = np.repeat(np.arange(len(batch)), sizes), np.repeat(_size(sizes), sizes)
            vx = v[rows] * x[:, None]
            sums = np.stack([np.bincount(doc, weights=vx[:, k], minlength=len(batch)) for k in range(FACTORS)], axis=1)
            z = b + np.bincount(doc, weights=w[rows] * x, minlength=len(batch))
            z = z + 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, weights=(vx**2).sum(axis=1), minlength=len(batch)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            used, at = np.unique(rows, return_inverse=True)
            gx = g[doc] * x
            dw = np.bincount(at, weights=gx)
            pairs = gx[:, None] * (sums[doc] - vx)
            dv = np.stack([np.bincount(at, weights=pairs[:, k]) for k in range(FACTORS)], axis=1)
            gw[used] += dw**2
            gv[used] += (dv**2).mean(axis=1)
            gb += g.sum() ** 2
            step_w, step_v = RATE / np.sqrt(gw[used]), RATE / np.sqrt(gv[used])
            new = w[used] - step_w * dw
            w[used] = np.sign(new) * np.maximum(np.abs(new) - step_w * WEIGHT_PENALTY, 0)
            new = v[used] - step_v[:, None] * dv
            length = np.sqrt((new**2).sum(axis=1)) + 1e-12
            v[used] = new * np.maximum(1 - step_v * FACTOR_PENALTY / length, 0)[:, None]
            b -= RATE * g.sum() / np.sqrt(gb)
    return FactorizationMachine(float(b), w, v)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", most: dict[int, int] | None = None, seed: int = 3) -> FactorizationMachine:
    """Fit on a bounded sample; terms are extracted where the texts are, and only their rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "terms", "label"])

    chosen = sample(docs, labels, label, F.lit(True) if usable is None else usable, most or SAMPLE, seed)
    rows = chosen.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, terms binary, label int").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([np.frombuffer(bytes(r.terms), dtype=np.uint16) for r in rows], np.array([r.label for r in rows], dtype=int), seed)


def scorer(model: FactorizationMachine):
    """A function of a column of texts: the score of each, from 0 to 1."""

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms()
        for part in texts:  # one text at a time is a Python string
            yield pa.array([model.score(terms.of(t.as_py())) for t in part], pa.float64())

    return scores


def score_documents(docs: DataFrame, model: FactorizationMachine, into: str = "score") -> DataFrame:
    """``docs`` with a double column ``into`` (0 to 1), scored over whole texts."""
    return docs.withColumn(into, scorer(model)(text_of()))


HELD_OUT = (5, 0)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, ~held_out(*HELD_OUT))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more; fitted on all labels that ``labels`` has. No column is added, so none can clash."""
    return docs.where(scorer(train(docs, labels))(text_of()) < 0.5)
