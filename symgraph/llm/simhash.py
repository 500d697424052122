"""Near-duplicates by SimHash, found with vantage-point trees over Hamming distance.

A fingerprint has 64 bits; bit i is set if it is set in over half of the hashes of the text's word shingles. Equal
fingerprints are one class; only classes are searched.

The search is a forest of one tree a band of the fingerprint. Of two fingerprints within ``radius`` bits, some band differs in
``radius // bands`` bits at most, so the tree of that band prunes with this smaller radius. A node has a vantage point v and a
threshold mu: a point at band distance d from v goes inside if d <= mu, else outside, and an inside point within the
radius of the boundary (d + radius > mu) goes outside as well. By the triangle bound |d(x,v) - d(y,v)| <= d(x,y) every close
pair then meets in some leaf. The upper part of each tree is grown on a bounded sample and deals the fingerprints to shards; a
shard's task goes on splitting in the same way, with vantage points of its own, until at most BASE points are left, which are compared
directly. A split that would not shrink both sides is not made; points that no split tells apart are searched breadth first.

Within a leaf a spanning forest of the links is kept, not all pairs: a group of copies gives as many links as members.
The search is exact for every number of rows. ``deduplicated`` takes its first candidates from it (see ``set_join``).

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; a text
of fewer words than a shingle is one shingle; repeated rows share a class and all are returned; a null doc_id never
names a component unless all of it are null; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import majority, materialize, text_of
from .components import connected_components
from .set_join import key_of, listed, similar_groups


@dataclass(frozen=True)
class Search:
    """shingle: words in a shingle. bands: equal parts of the fingerprint, a tree each. radius: links have at most so many differing
    bits. leaf: a shard expected to hold more points is split, if the sample has LEAST_SAMPLED of them. sample: how many fingerprints,
    about, the driver reads to place vantage points."""

    shingle: int = 3
    bands: int = 2
    radius: int = 3
    leaf: int = 256
    sample: int = 1 << 16


#: As the query contract has it.
EXACT = Search()
#: The similarity of texts that ``deduplicated`` links, and its shingle.
SIMILAR, SIMILAR_SHINGLE = 0.8, 5
#: Points compared directly; sampled points that a node of the dealing tree needs; vantage points tried a node.
BASE, LEAST_SAMPLED, TRIED = 128, 32, 6
_SEED = 42


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case (on bytes, both touch ASCII only)."""
    return text.encode().lower().split()


def shingles(found: list[bytes], k: int) -> list[bytes]:
    """Space-joined runs of k words, repeats included; all words if they are fewer; none if there are none."""
    if len(found) <= k:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - k + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, shingle: int) -> bytes:
    """The fingerprint, most significant byte first."""
    found = shingles(words(text or ""), shingle)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, _SEED) for s in found), dtype="<u8", count=len(found))).to_bytes(8, "big")


def fingerprints(docs: DataFrame, search: Search) -> DataFrame:
    """doc_id, th (a hash of the text, to find the row again) and fp of every row."""
    shingle = search.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], ["doc_id", "th", "fp"])

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, th bigint, fp binary")


def points_of(fps: list[bytes] | np.ndarray) -> np.ndarray:
    """Fingerprints as numbers."""
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64)


def bytes_of(points: np.ndarray) -> pa.Array:
    """Numbers as fingerprints."""
    data = pa.py_buffer(points.astype(">u8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(points), [None, data]).cast(pa.binary())


def mask_of(band: int, bands: int) -> np.uint64:
    """The bits of a band."""
    first, last = 64 * band // bands, 64 * (band + 1) // bands
    return np.uint64(((1 << last) - 1) ^ ((1 << first) - 1))


def _distances(points: np.ndarray, to: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ to) & mask)


def _split(points: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and threshold, among a few tried, that leave the fewest pairs to compare; None if none shrinks both sides."""
    n, best = len(points), None
    for v in points[np.linspace(0, n - 1, TRIED).astype(int)]:
        up_to = np.cumsum(np.bincount(_distances(points, v, mask), minlength=66 + radius))
        mu = np.arange(65)
        inside = up_to[mu]
        outside = n - np.where(mu >= radius, up_to[mu - radius], 0)
        cost = inside.astype(float) ** 2 + outside.astype(float) ** 2
        cost[(inside > 0.9 * n) | (outside > 0.9 * n)] = np.inf
        i = int(np.argmin(cost))
        if cost[i] < 0.85 * n**2 and (best is None or cost[i] < best[0]):
            best = (cost[i], v, i)
    return best and (best[1], best[2])


def _sides(d: np.ndarray, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside, and which outside: those beyond the threshold, and those so near to it that a close one may be."""
    return d <= mu, d.astype(np.int64) + radius > mu


class Tree:
    """The dealing part of a band's tree, grown on a sample; ``leaves`` counts its shards."""

    def __init__(self, sample: np.ndarray, part: float, mask: np.uint64, radius: int, leaf: int) -> None:
        self.mask, self.radius, self.leaves = mask, radius, 0
        self.root = self._grow(sample, max(LEAST_SAMPLED, int(leaf * part)))

    def _grow(self, points: np.ndarray, least: int) -> tuple | int:
        split = _split(points, self.mask, self.radius) if len(points) > least else None
        if split is None:
            self.leaves += 1
            return self.leaves - 1
        inside, outside = _sides(_distances(points, split[0], self.mask), split[1], self.radius)
        return *split, self._grow(points[inside], least), self._grow(points[outside], least)

    def route(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(indexes, leaf) of the points that go to a leaf."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield at, node
                continue
            v, mu, in_, out = node
            inside, outside = _sides(_distances(points[at], v, self.mask), mu, self.radius)
            todo += [(in_, at[inside]), (out, at[outside])]


def grow(classes: DataFrame, search: Search) -> list[Tree]:
    """A tree a band over ``classes.fp``, from a sample of bounded size."""
    total, grid = classes.count(), 1 << 30
    part = min(1.0, search.sample / max(1, total))
    rows = classes.where(F.pmod(F.xxhash64("fp"), F.lit(grid)) < int(part * grid)).select("fp").toArrow()
    points = points_of(rows.column(0).to_pylist())
    return [Tree(points, part, mask_of(b, search.bands), search.radius // search.bands, search.leaf) for b in range(search.bands)]


_ALL = np.uint64((1 << 64) - 1)


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) of a spanning forest of the pairs within ``radius``, breadth first; memory linear in points."""
    rest, a, b = np.arange(len(points)), [], []
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for i in queue.pop():
                near = _distances(points[rest], points[i], _ALL) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    a.append(np.full(len(found), i))
                    b.append(found)
                    queue.append(found)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links_within(points: np.ndarray, mask: np.uint64, radius: int, band_radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the points of a shard that a band's tree finds: split on the band, then, where that tells no more apart, on
    the whole fingerprint; leaves are compared as a whole."""
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        x = points[at]
        if len(at) <= BASE:
            if np.count_nonzero(np.bitwise_count(x[:, None] ^ x) <= radius) == len(at):
                continue
            split = None
        else:
            by, reach = mask, band_radius
            split = _split(x, by, reach)
            if split is None:
                by, reach = _ALL, radius
                split = _split(x, by, reach)
        if split is None:
            a, b = forest(x, radius)
            if len(a):
                yield at[a], at[b]
        else:
            inside, outside = _sides(_distances(x, split[0], by), split[1], reach)
            todo += [at[inside], at[outside]]


def deal(classes: DataFrame, trees: list[Tree]) -> DataFrame:
    """shard, fp: every fingerprint in each shard of each tree that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = points_of(batch.column(0).to_pylist())
            for b, tree in enumerate(trees):
                routed = list(tree.route(points))
                if routed:
                    shards = np.concatenate([np.full(len(at), (b << 48) | leaf, dtype=np.int64) for at, leaf in routed])
                    yield pa.RecordBatch.from_arrays([pa.array(shards), bytes_of(points[np.concatenate([at for at, _ in routed])])], ["shard", "fp"])

    return classes.select("fp").mapInArrow(run, "shard bigint, fp binary")


def links(classes: DataFrame, search: Search) -> DataFrame:
    """a, b: links between distinct fingerprints ``classes.fp``; a spanning forest of each leaf."""
    trees = grow(classes, search)
    masks, radius, band_radius = [t.mask for t in trees], search.radius, search.radius // search.bands

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: int, points: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in links_within(points, masks[shard >> 48], radius, band_radius):
                yield pa.RecordBatch.from_arrays([bytes_of(points[a]), bytes_of(points[b])], ["a", "b"])

        held: list[np.ndarray] = []
        now = -1
        for batch in batches:  # sorted by shard; the last one of a batch may go on in the next
            if not batch.num_rows:
                continue
            shards, points = batch.column(0).to_numpy(), points_of(batch.column(1).to_pylist())
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if int(shards[x]) != now and held:
                    yield from found(now, np.concatenate(held))
                    held = []
                now = int(shards[x])
                held.append(points[x:y])
        if held:
            yield from found(now, np.concatenate(held))

    return deal(classes, trees).repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, search: Search = EXACT) -> DataFrame:
    """doc_id, th, fp, root, component_id of every row of ``docs`` (doc_id, text).

    Rows of a component share ``root`` (its smallest fingerprint) and ``component_id`` (its smallest doc_id).
    """
    rows = materialize(fingerprints(docs, search), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("least")), "simhash-classes")
    roots = connected_components(links(classes, search))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("_fp"), "root", F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("first_th"))
    return rows.join(of, F.col("fp") == F.col("_fp")).drop("_fp")


def deduplicated(docs: DataFrame, at_least: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """``docs`` without all but one document of each group of texts linked by so similar shingle sets: the one of the smallest doc_id.

    Of rows equal in doc_id and text, that whose other columns come first in order is kept. Null and empty texts are alike.
    """
    groups = similar_groups(docs.select("doc_id", "text"), at_least, shingle, fingerprint_links)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th"))
    rows = groups.select(key_of(F.col("doc_id"), F.col("th")).alias("k"), F.col("th").alias("own"), stays.alias("stays"))
    # rows that go or are repeated; all others stay without a shuffle of their texts
    touched = rows.groupBy("k", "own").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 OR NOT stays")
    touched = materialize(touched.select("k", "own", "stays"), "similar-touched")
    may = listed(touched, "similar-filter")("k", "own")
    marked = docs.select(F.struct("*").alias("d")).withColumn("own", F.xxhash64(F.coalesce("d.text", F.lit(""))))
    marked = marked.withColumn("k", key_of(F.col("d.doc_id"), F.col("own")))
    unsure = marked.where(may).join(touched, ["k", "own"], "left").where("stays IS NULL OR stays")
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    order = F.struct(*[F.col(f"d.`{c}`") for c in rest], F.lit(0).alias("z"))
    once = unsure.groupBy("k", "own").agg(F.min_by("d", order).alias("d"))
    return marked.where(~may).select("d.*").unionByName(once.select("d.*"))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of ``nodes`` (node, fp) to be checked, as vantage-point trees find them: each node with the first of its
    fingerprint, and the first ones of linked fingerprints."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhash-first")
    near = links(first, EXACT)
    same = nodes.join(first.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    x = first.select(F.col("fp").alias("a"), F.col("first").alias("first_a"))
    y = first.select(F.col("fp").alias("b"), F.col("first").alias("first_b"))
    return same.unionByName(near.join(x, "a").join(y, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
