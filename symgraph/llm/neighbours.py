"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is brought to length 1, the centre of a sample is taken off, and what remains is rotated at random; the signs
are its code, packed to 64-bit words. With three scalars (the length of the remainder, its inner product with the code's own direction,
and with the centre) a code estimates the inner product with any query. The rotated query is cut to QUERY_BITS bits a component,
so that the inner product with a code is a sum of population counts. The estimate's error is bounded: for a remainder of
direction o and its code's direction x, |<o,q> - <x,q>/<x,o>| <= EPSILON * sqrt((1 - <x,o>^2) / <x,o>^2 / (dim - 1)), and that of the
cut by EPSILON * step / sqrt(12), both with a probability that EPSILON sets. A vector is compared exactly if the upper end of its
interval reaches the k-th largest exact cosine seen so far; all others cannot be among the k nearest, within that probability.

Scale: every vector is indexed; the centre is fitted on at most SAMPLE of them. Queries are rows of a table, dealt to blocks by hash;
each block meets all codes, dealt to cells of about CELL rows, as two kinds of rows of one sorted stream. A worker holds one block of
queries and AT_ONCE codes at a time, reads vectors of survivors alone, and gives at most k rows a query and cell to the final ranking,
whatever the group that a query lies in. Nothing is collected, and the plan does not grow with the number of queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than ``dim`` (by default the most common one); ties go to the smaller id; rows that share a query's id are its
own, and of several vectors under one query id that of the smallest hash asks; a null id takes no part; fewer than k candidates are
all returned; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

EPSILON, SAMPLE, SEED, QUERY_BITS = 3.0, 4096, 29, 4
#: Queries in a block and codes in a cell, about; codes compared with a block, and queries with those, at a time: bounds a worker's memory.
QUERY_BLOCK, CELL, AT_ONCE, ASKED_AT_ONCE = 2048, 1 << 15, 2048, 512
K = 5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (columns past ``dim`` up to a multiple of 64 are there for packing)."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def usable(vectors: DataFrame, id: str, vector: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """id, v (doubles) of the vectors that take part, and their length."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = kept.select(F.col(id).cast("bigint").alias("id"), v.alias("v"))
    if dim is None:
        first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = int(first.n) if first else 1
    return rows.where(F.size("v") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1, and their lengths; scaled first, so that no square overflows or vanishes."""
    top = np.abs(x).max(axis=1, keepdims=True)
    n = np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True))
    return x / top / n, (n * top)[:, 0]


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, and per row: length of the remainder, <code, remainder's direction>, <remainder, centre>."""
    rest = _unit(x)[0] - centre
    length = np.sqrt((rest**2).sum(axis=1))
    turned = rest @ turn
    wide = turn.shape[1]
    own = np.abs(turned).sum(axis=1) / np.sqrt(wide) / np.maximum(length, 1e-300)
    return np.packbits(turned > 0, axis=1), np.stack((length, np.where(length > 0, own, 1.0), rest @ centre), axis=1)


class Asked:
    """A block of queries as codes meet them: bit planes of the rotated queries, and what the estimate and its error need."""

    def __init__(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.unit, self.norms = _unit(queries)
        rest = self.unit - centre
        turned = rest @ turn
        self.low, top = turned.min(axis=1), turned.max(axis=1)
        levels = (1 << QUERY_BITS) - 1
        self.step = np.maximum((top - self.low) / levels, 1e-300)
        cut = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, levels).astype(np.uint8)
        self.planes = [np.packbits((cut >> j) & 1, axis=1).view(np.uint64) for j in range(QUERY_BITS)]
        self.total = self.low * turned.shape[1] + self.step * cut.sum(axis=1)
        self.length, self.with_centre, self.wide = np.sqrt((rest**2).sum(axis=1)), self.unit @ centre, turned.shape[1]

    def bounds(self, codes: np.ndarray, scalars: np.ndarray, some: slice, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of some queries (rows) with coded vectors (columns), and the half widths of their intervals."""
        words = np.ascontiguousarray(codes).view(np.uint64)
        ones = np.bitwise_count(words).sum(axis=1)
        found = np.zeros((len(self.low[some]), len(words)), dtype=np.float32)
        for j, plane in enumerate(self.planes):
            for w in range(words.shape[1]):
                found += np.float32(1 << j) * np.bitwise_count(plane[some, w][:, None] & words[None, :, w])
        raw = 2 * (self.low[some][:, None] * ones + self.step[some][:, None] * found) - self.total[some][:, None]
        span, own, with_centre = scalars[:, 0], np.maximum(scalars[:, 1], 1e-6), scalars[:, 2]
        estimate = raw / np.sqrt(self.wide) * (span / own) + with_centre + self.with_centre[some][:, None]
        error = np.outer(self.length[some], span * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(self.wide - 1, 1)))
        return estimate, epsilon * (error + np.outer(self.step[some] / np.sqrt(12), span / own)) + 1e-9


def index(rows: DataFrame, dim: int, sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The table of codes (id, v, code, scalars) of all rows, its centre and its rotation."""
    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").collect()
    centre = _unit(np.array([r.v for r in chosen], dtype=np.float64))[0].mean(axis=0) if chosen else np.zeros(dim)
    turn = rotation(dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, scalars = encode(_matrix(batch.column(1), dim), centre, turn)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(scalars) + 1, 3, dtype=np.int32)), pa.array(scalars.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, flat], ["id", "v", "code", "scalars"])

    coded = rows.select("id", "v").mapInArrow(run, "id bigint, v array<double>, code binary, scalars array<double>")
    return materialize(coded, "codes"), centre, turn


class Best:
    """The k nearest so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> None:
        self.ids, self.queries, self.asked, self.k, self.epsilon = ids, queries, Asked(queries, centre, turn), k, epsilon
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)

    def meet(self, numbers: np.ndarray, codes: np.ndarray, scalars: np.ndarray, vectors: np.ndarray) -> None:
        """Compare with some codes; only vectors that may be among the nearest are read."""
        for start in range(0, len(self.ids), ASKED_AT_ONCE):
            some = slice(start, start + ASKED_AT_ONCE)
            estimate, error = self.asked.bounds(codes, scalars, some, self.epsilon)
            for i in range(len(estimate)):
                self._one(start + i, numbers, vectors, estimate[i], estimate[i] + error[i])

    def _one(self, q: int, numbers: np.ndarray, vectors: np.ndarray, estimate: np.ndarray, upper: np.ndarray) -> None:
        k = self.k
        own = numbers == self.ids[q]
        if own.any():
            estimate, upper = np.where(own, -np.inf, estimate), np.where(own, -np.inf, upper)
        if len(self.found[q][0]) < k and len(numbers) > k:  # the likely ones first, so that there is something to reach
            self._add(q, numbers, vectors, likely := np.argpartition(estimate, -k)[-k:], own)
            upper = upper.copy()
            upper[likely] = -np.inf
        least = self.found[q][1][k - 1] if len(self.found[q][0]) >= k else -np.inf
        at = np.flatnonzero(upper >= least - 1e-9) if np.isfinite(least) else np.flatnonzero(np.isfinite(upper))
        if len(at):
            self._add(q, numbers, vectors, at, own)

    def _add(self, q: int, numbers: np.ndarray, vectors: np.ndarray, at: np.ndarray, own: np.ndarray) -> None:
        at = at[~own[at]]
        ids = np.concatenate((self.found[q][0], numbers[at]))
        scores = np.concatenate((self.found[q][1], cosine(self.queries[q], self.asked.norms[q], vectors[at])))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = ids[order], scores[order]

    def rows(self) -> pa.RecordBatch:
        n = [len(f[0]) for f in self.found]
        columns = [np.repeat(self.ids, n), np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _search(centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float):
    """The task: sorted by block and cell, in each the queries (kind 0) first, then the codes (kind 1)."""
    dim = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best = None, [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            keys = np.stack([whole.column(i).to_numpy() for i in range(3)], axis=1)  # block, cell, kind
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)])).tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                now, kind = (int(keys[x, 0]), int(keys[x, 1])), int(keys[x, 2])
                if now != cell:
                    if best:
                        yield best.rows()
                    cell, asked, best = now, [], None
                part = whole.slice(x, y - x)
                if not kind:
                    asked.append((part.column(3).to_numpy(), _matrix(part.column(4), dim)))
                    continue
                if best is None and asked:
                    best = Best(np.concatenate([a for a, _ in asked]), np.concatenate([b for _, b in asked]), centre, turn, k, epsilon)
                for at in range(0, part.num_rows if best else 0, AT_ONCE):
                    some = part.slice(at, AT_ONCE)
                    codes = np.frombuffer(b"".join(some.column(5).to_pylist()), dtype=np.uint8).reshape(some.num_rows, -1)
                    best.meet(some.column(3).to_numpy(), codes, _matrix(some.column(6), 3), _matrix(some.column(4), dim))
        if best:
            yield best.rows()

    return run


def cosine(q: np.ndarray, norm: float, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows give equal values."""
    top = np.abs(x).max(axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    unit = x / top
    return (unit * (q / norm)).sum(axis=1) / np.sqrt((unit**2).sum(axis=1))


def nearest(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = K, dim: int | None = None, epsilon: float = EPSILON, block: int = QUERY_BLOCK, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each query, ``is_query`` a condition on ``id``."""
    rows, dim = usable(vectors, id, vector, dim)
    codes, centre, turn = index(rows, dim)
    asked = codes.where(is_query).groupBy("id").agg(F.min_by("v", F.struct(F.xxhash64("v"), "v")).alias("v"))
    asked = materialize(asked, "asked")
    blocks, cells = (F.lit(max(1, -(-df.count() // n))) for df, n in ((asked, block), (codes, cell)))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    left = asked.select(of(blocks, 1).alias("block"), each(cells).alias("cell"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<double>").alias("scalars"))
    salt = F.pmod(F.xxhash64("id", "v", F.lit(2)), cells).cast("int")
    right = codes.select(each(blocks).alias("block"), salt.alias("cell"), F.lit(1).alias("kind"), "id", "v", "code", "scalars")
    dealt = left.unionByName(right).repartition("block", "cell").sortWithinPartitions("block", "cell", "kind", "id")
    found = dealt.mapInArrow(_search(centre, turn, k, epsilon), "query_id bigint, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(embeddings.select("vec_id", "embedding"), F.col("id") % 50 == 0)
