"""Quality: a byte-level convolutional network in numpy.

The bytes of the whole text are covered by chunks of two BLOCKs that overlap by one. Each of FILTERS learned filters
spans KERNEL bytes (a table of a weight for every byte at every place) and is max-pooled over a chunk. A document's features are
the mean, the largest and the smallest of its chunks' pooled values, and two of its length; one hidden layer combines
them into a probability. The smallest tells what a text lacks: one that repeats itself never shows most of the usual
patterns, while a short one has no room for them, which its length tells.

The network is trained on the driver by Adam on the whole texts of at most SAMPLE documents of each label, convolved in pieces
as in scoring; its parameters are some twenty thousand numbers.

Defined cases: null and empty texts are one chunk of zero bytes; the last block is filled with zero bytes, in training too;
without labels of both kinds every score is the prior (0 if there is none); repeated rows are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_of
from .labelled import sample

SAMPLE = {1: 2400, 0: 1400}
BLOCK, KERNEL, FILTERS, HIDDEN = 256, 5, 16, 16
EPOCHS, BATCH, RATE = 10, 32, 0.01
#: Blocks convolved at a time: bounds memory for any length of text and keeps the sums in cache.
AT_ONCE = 64


def blocks_of(text: str) -> tuple[np.ndarray, int]:
    """The bytes filled up to whole blocks and KERNEL - 1 more, and the number of blocks (two at least)."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(2, -(-len(raw) // BLOCK))
    out = np.zeros(n * BLOCK + KERNEL - 1, dtype=np.uint8)
    out[: len(raw)] = raw
    return out, n


def of_length(data: np.ndarray, n: int) -> list[float]:
    """Two numbers for the length of a text: its logarithm, and how far it fills the first chunk."""
    used = data[: n * BLOCK][::-1] != 0
    size = n * BLOCK - int(np.argmax(used)) if used.any() else 1
    return [np.log2(size) / 10, min(1.0, size / (2 * BLOCK))]


def _convolved(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    out = tables[0][data[:n]]
    for j in range(1, KERNEL):
        out += tables[j][data[j : n + j]]
    return out


def _pieces(tables: np.ndarray, data: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """From which block to which, and their values by block, place and filter; AT_ONCE blocks at a time."""
    for at in range(0, n, AT_ONCE):
        m = min(AT_ONCE, n - at)
        part = _convolved(tables, data[at * BLOCK : (at + m) * BLOCK + KERNEL - 1], m * BLOCK)
        yield at, at + m, part.reshape(m, BLOCK, FILTERS)


def pooled_blocks(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each filter in each block."""
    out = np.empty((n, FILTERS), dtype=np.float32)
    for a, b, part in _pieces(tables, data, n):
        out[a:b] = part.max(axis=1)
    return out


def pooled_places(tables: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each filter in each block, and its place there."""
    out, place = np.empty((n, FILTERS), dtype=np.float32), np.empty((n, FILTERS), dtype=np.int64)
    for a, b, part in _pieces(tables, data, n):
        place[a:b] = part.argmax(axis=1)
        out[a:b] = np.take_along_axis(part, place[a:b, None], axis=1)[:, 0]
    return out, place


class ByteNetwork:
    """tables: KERNEL x 256 x FILTERS; a hidden layer of HIDDEN; ``prior``: the score, if nothing could be learned."""

    def __init__(self, params: dict[str, np.ndarray], prior: float | None = None) -> None:
        self.params, self.prior = params, prior

    def score(self, text: str) -> float:
        if self.prior is not None:
            return self.prior
        p = self.params
        data, n = blocks_of(text)
        blocks = pooled_blocks(p["tables"], data, n)
        chunks = np.maximum(np.maximum(blocks[:-1], blocks[1:]) + p["shift"], 0)
        z = np.concatenate((chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0), of_length(data, n)))
        out = float(np.tanh(z @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0])
        return float(1 / (1 + np.exp(-np.clip(out, -30, 30))))


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = np.float32
    return {
        "tables": rng.normal(0, 0.3, (KERNEL, 256, FILTERS)).astype(f), "shift": np.zeros(FILTERS, dtype=f),
        "w1": rng.normal(0, 0.2, (3 * FILTERS + 2, HIDDEN)).astype(f), "b1": np.zeros(HIDDEN, dtype=f),
        "w2": rng.normal(0, 0.3, HIDDEN).astype(f), "b2": np.zeros(1, dtype=f),
    }


def _gradient(p: dict[str, np.ndarray], docs: list[tuple[np.ndarray, int]], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the weighted log loss; through each maximum to the place that holds it."""
    cols = np.arange(FILTERS)
    pooled, places, zs, picks = [], [], [], []
    for data, n in docs:
        blocks, place = pooled_places(p["tables"], data, n)
        second = blocks[1:] > blocks[:-1]
        raw = np.where(second, blocks[1:], blocks[:-1]) + p["shift"]
        chunks = np.maximum(raw, 0)
        top, low = chunks.argmax(axis=0), chunks.argmin(axis=0)
        zs.append(np.concatenate((chunks.mean(axis=0), chunks[top, cols], chunks[low, cols], of_length(data, n))))
        pooled.append(raw)
        places.append(place)
        picks.append((second, top, low))
    z = np.array(zs)
    h = np.tanh(z @ p["w1"] + p["b1"])
    out = h @ p["w2"] + p["b2"][0]
    g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * weight / len(y)
    gh = np.outer(g, p["w2"]) * (1 - h**2)
    grad = {"w2": h.T @ g, "b2": np.array([g.sum()]), "w1": z.T @ gh, "b1": gh.sum(axis=0), "shift": np.zeros(FILTERS), "tables": np.zeros_like(p["tables"])}
    gz = gh @ p["w1"].T
    for (data, _), raw, place, (second, top, low), one in zip(docs, pooled, places, picks, gz, strict=True):
        gc = np.repeat(one[None, :FILTERS] / len(raw), len(raw), axis=0)
        gc[top, cols] += one[FILTERS : 2 * FILTERS]
        gc[low, cols] += one[2 * FILTERS : 3 * FILTERS]
        gc *= raw > 0
        grad["shift"] += gc.sum(axis=0)
        block = np.arange(len(raw))[:, None] + second
        at = block * BLOCK + np.take_along_axis(place, block, axis=0)
        for j in range(KERNEL):
            np.add.at(grad["tables"][j], (data[at + j], cols[None, :]), gc)
    return grad


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> ByteNetwork:
    """A network for the texts, both classes with the same total weight."""
    n, positive = len(labels), int(labels.sum())
    if not n or positive in (0, n):
        return ByteNetwork({}, positive / n if n else 0.0)
    rng = np.random.default_rng(seed)
    p = _start(rng)
    docs = [blocks_of(t) for t in texts]
    weight = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    batches = max(1, n // BATCH)
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(n), batches):
            t += 1
            rate = RATE * (1 - (epoch * batches + (t - 1) % batches) / (EPOCHS * batches)) + 1e-4
            grad = _gradient(p, [docs[i] for i in batch], labels[batch], weight[batch])
            for k, x in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x**2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return ByteNetwork(p)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", most: dict[int, int] | None = None, seed: int = 11) -> ByteNetwork:
    """Fit on the whole texts of a bounded sample of rows."""
    chosen = sample(docs, labels, label, F.lit(True) if usable is None else usable, most or SAMPLE, seed)
    rows = chosen.select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], np.array([r.label for r in rows], dtype=int), seed)


def score_documents(docs: DataFrame, model: ByteNetwork, into: str = "score") -> DataFrame:
    """``docs`` with a double column ``into`` (0 to 1), scored over whole texts."""

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:  # one text at a time is a Python string
            yield pa.array([model.score(t.as_py()) for t in part], pa.float64())

    return docs.withColumn(into, scores(text_of()))


HELD_OUT, THRESHOLD = (4, 2), 0.7


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, ~held_out(*HELD_OUT))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
