"""Similarity join of texts by their sets of word shingles: Jaccard similarity, fingerprints, prefix filter, verified on the texts.

Texts of equal sets are one node, known by the set's SimHash fingerprint and a hash. A set's shingles are put in one order for all
texts, frequent ones last, and two sets of similarity t share one of the first ``n - ceil(t * n) + 1`` of each; so every pair that is
similar meets in the list of some such shingle, whatever was edited. The order is that of counts in a bounded sample, ties by the
hash: the sample decides how long lists get, never which pairs are found. Of two sets of LARGE shingles or more that meet, those
whose fingerprints differ in more than APART of 64 bits are passed over: at similarity 0.8 a bit differs with chance 0.15, so by the
binomial law, not by measurement, a similar pair is lost with a chance of about 1 in 10^8. ``apart=64`` passes over none and is exact.

Candidates are verified before any is left out. First come the pairs that the caller's own search proposes (by fingerprints), and each
node with the first of its lists and with its neighbours there, whose links join most of a group before its other pairs are made; after that, round by round, every pair of a list that sizes and places in the prefixes allow,
within a span of neighbours that grows until it covers the list, unless earlier links already join the two or the pair was checked. A pair that shares many shingles meets
in as many lists; a row carries the few shingles before its own, and where two rows share one of those they are left to its list, so a pair is always made in
the list of the first shingle it shares and in few others. When no list is left, each pair that meets
and is not passed over has been checked or lies within one component.

Defined cases: a null text counts as empty; texts without words are alike; fewer words than a shingle are one shingle.
Shingles are compared by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import majority, materialize, text_of
from .components import connected_components
from .url_filter import bloom_filter, might_contain

_SEED = 17
#: Texts in the sample that tells frequent shingles, the least count there, and how many shingles are kept.
SAMPLE, FREQUENT, MOST = 20_000, 3, 200_000
#: From how many shingles on fingerprints count, and how many bits at most differ in texts that are alike.
LARGE, APART = 32, 28
#: The span of the first full round, and its growth.
SPAN, GROWTH = 16, 16
#: How many shingles before its own a row of a list carries.
BEFORE = 2
_BEFORE = [f"p{k}" for k in range(1, BEFORE + 1)]


def shingle_set(text: str, k: int) -> np.ndarray:
    """Hashes of the distinct runs of k words (A-Z in lower case), in order; of all words if they are fewer."""
    found = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, _SEED) for w in found), dtype=np.uint64, count=len(found))
    run = min(k, len(found))
    if not run:
        return hashes
    out = np.full(len(found) - run + 1, run, dtype=np.uint64)
    for j in range(run):
        out = (out ^ hashes[j : len(found) - run + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _least(n: np.ndarray | int, at_least: float) -> np.ndarray:
    """The smallest whole number that is ``at_least * n``."""
    return np.ceil(at_least * np.asarray(n, dtype=np.float64) - 1e-9).astype(np.int64)


def prefix(found: np.ndarray, at_least: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the common order, that a similar set shares one of; ``frequent`` is sorted."""
    if not len(found):
        return found
    rank = np.zeros(len(found), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: len(found) - int(_least(len(found), at_least)) + 1]


def node_of(found: np.ndarray) -> bytes:
    """What a set is known by: its fingerprint, then a hash of it, 8 bytes each."""
    return majority(found).to_bytes(8, "big") + xxhash.xxh3_64_digest(found.tobytes())


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, sorted, and their counts there."""
    total, grid = docs.count(), 1 << 30
    part = min(1.0, SAMPLE / max(1, total))
    sample = docs.select(text_of().alias("text")).withColumn("th", F.xxhash64("text")).where(F.pmod("th", F.lit(grid)) < int(part * grid)).dropDuplicates(["th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], ["s"])

    counts = sample.select("text").mapInArrow(run, "s bigint").groupBy("s").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.col("count").desc(), "s").limit(MOST).toArrow()
    s, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _binary(nodes: np.ndarray) -> pa.Array:
    """Rows of two 64-bit words as binary values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes).tobytes())]).cast(pa.binary())


def _nodes(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.int64).reshape(-1, 2)


def set_rows(docs: DataFrame, at_least: float, shingle: int) -> DataFrame:
    """doc_id, th (a hash of the text), node (see ``node_of``), n (the set's size) and prefix of every row."""
    frequent, counts = _frequent(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for text in batch.column(2):  # one text at a time is a Python string
                found = shingle_set(text.as_py(), shingle)
                nodes.append(node_of(found))
                sizes.append(len(found))
                prefixes.append(prefix(found, at_least, frequent, counts).tobytes())
            made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "th", "node", "n", "prefix"])

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, th bigint, node binary, n bigint, prefix binary")


_WORDS = ", ".join(f"{p} bigint" for p in _BEFORE)


def _dealt(classes: DataFrame) -> DataFrame:
    """s, n, x, y, at and the BEFORE shingles before s (anything where there are fewer): a row for each shingle of a node's prefix; x and y are the node's two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(p.as_py(), dtype=np.int64) for p in batch.column(2)]
            sizes = np.array([len(p) for p in parts])
            nodes, n = np.repeat(_nodes(batch.column(0)), sizes, axis=0), np.repeat(batch.column(1).to_numpy(), sizes)
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            s = np.concatenate(parts)
            columns = [s, n, nodes[:, 0], nodes[:, 1], at, *[np.roll(s, k) for k in range(1, BEFORE + 1)]]
            for i in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + (1 << 16)])) for c in columns], ["s", "n", "x", "y", "at", *_BEFORE])

    return classes.select("node", "n", "prefix").mapInArrow(run, f"s bigint, n bigint, x bigint, y bigint, at int, {_WORDS}")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole lists (runs of the first column), a batch at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on in the next batch
        if last:
            yield [c[:last] for c in held]
            held = [c[last:] for c in held]
    if held is not None:
        yield held


def _spans(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each row's list."""
    cuts = np.flatnonzero(np.diff(s)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(s)]))
    return np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)


def _may(i: np.ndarray, j: np.ndarray, n: np.ndarray, at: np.ndarray, fp: np.ndarray, at_least: float, apart: int = APART) -> np.ndarray:
    """Whether sizes, places and fingerprints allow the similarity, if this is the first shingle that both share; i is no larger than j."""
    shared = np.minimum(n[i] - at[i], n[j] - at[j])
    near = (n[i] < LARGE) | (np.bitwise_count(fp[i] ^ fp[j]) <= apart)
    return near & (n[i] >= _least(n[j], at_least)) & (shared >= _least(n[i] + n[j], at_least / (1 + at_least)))


def _met_before(i: np.ndarray, j: np.ndarray, at: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Whether two rows share one of the shingles just before their own: they meet in its list too, where all that allows the pair here allows it."""
    found = np.zeros(len(i), dtype=bool)
    for u, p in enumerate(before, 1):
        for v, q in enumerate(before, 1):
            found |= (p[i] == q[j]) & (at[i] >= u) & (at[j] >= v)
    return found


def _reach(s: np.ndarray, n: np.ndarray, at: np.ndarray, span: int, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole lists, sizes ascending: where the rows end that sizes and places let be similar to a row before them
    (after i only those before ``end[i]`` can be), and which rows have such a partner more than ``span`` rows away.

    Two sets that share this shingle first share no more than either has from its place on, so a row met late in its
    prefix reaches no larger set, and is at most the larger one of a pair. Bounds are rounded towards reaching too far; ``_may`` decides.
    """
    most = np.floor((n - at) * ((1 + at_least) / at_least) + 1e-6).astype(np.int64) - n
    of = np.concatenate(([0], np.cumsum(np.diff(s) != 0))) << 32
    key, here = of + n, np.arange(len(s))
    upper = np.clip(np.minimum(most, np.floor(n / at_least + 1e-6).astype(np.int64)), 0, (1 << 32) - 1)
    end = np.searchsorted(key, of + upper, side="right")
    ahead = end > here + span + 1
    least = np.searchsorted(key, of + _least(n, at_least))
    behind = np.minimum(np.searchsorted(key, of + np.clip(most, 0, n), side="right"), here - span) > least
    met = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(met, here[ahead] + span + 1, 1)
    np.add.at(met, end[ahead], -1)
    return end, ahead | (behind & (np.cumsum(met)[:-1] > 0))


_POSTING = f"s bigint, n bigint, at int, node binary, first binary, near binary, {_WORDS}"


def _met(dealt: DataFrame, at_least: float, apart: int = APART) -> DataFrame:
    """s, n, at, node, first, near and the shingles before: the rows of lists that sizes and places let be similar to another; ``first`` is the list's first
    node of such a size, ``near`` the one before in the list, if the two may be similar (and meet in no list of the shingles before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, n, x, y, at, *before in _lists(batches):
            starts, _ = _spans(s)
            keep = np.flatnonzero(_reach(s, n, at, 0, at_least)[1])
            if not len(keep):
                continue
            first = []
            for k in keep.tolist():
                a = int(starts[k])
                first.append(a + int(np.searchsorted(n[a : k + 1], _least(n[k], at_least))))
            first = np.array(first)
            nodes = np.stack((x, y), axis=1)
            heads = _binary(nodes[first])
            use = (first != keep) & _may(first, keep, n, at, x.view(np.uint64), at_least, apart)
            heads = pa.array([h if u else None for u, h in zip(use.tolist(), heads.to_pylist(), strict=True)], pa.binary())
            prior = np.concatenate((keep[:1], keep[:-1]))
            use = (s[prior] == s[keep]) & (prior != keep) & _may(prior, keep, n, at, x.view(np.uint64), at_least, apart) & ~_met_before(prior, keep, at, before)
            near = pa.array([m if u else None for u, m in zip(use.tolist(), _binary(nodes[prior]).to_pylist(), strict=True)], pa.binary())
            made = [pa.array(s[keep]), pa.array(n[keep]), pa.array(at[keep]), _binary(nodes[keep]), heads, near, *[pa.array(p[keep]) for p in before]]
            yield pa.RecordBatch.from_arrays(made, ["s", "n", "at", "node", "first", "near", *_BEFORE])

    return dealt.repartition("s").sortWithinPartitions("s", "n", "x", "y").mapInArrow(run, _POSTING)


def _round(postings: DataFrame, roots: DataFrame, past: int, span: int, at_least: float, apart: int = APART) -> DataFrame:
    """a, b: pairs of a list, over ``past`` and up to ``span`` rows apart, that may be similar and that no link joins yet; a row
    of nulls, if some list has rows further apart that may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = False
        for s, n, at, node, root, *before in _lists(batches):
            starts, _ = _spans(s)
            fp = _nodes(pa.array(node, pa.binary()))[:, 0].view(np.uint64)
            end, left = _reach(s, n, at, span, at_least)
            i = np.arange(len(s))
            for k in range(past + 1, span + 1):
                i = i[i + k < end[i]]
                if not len(i):
                    break
                j = i + k
                hit = np.flatnonzero(_may(i, j, n, at, fp, at_least, apart) & (root[i] != root[j]).astype(bool))
                hit = hit[~_met_before(i[hit], j[hit], at, before)]
                if len(hit):
                    a, b = node[i[hit]], node[j[hit]]
                    swap = (a > b).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a), pa.binary()), pa.array(np.where(swap, a, b), pa.binary())], ["a", "b"])
            left = np.flatnonzero(left)
            more = more or bool((root[left] != root[starts[left]]).any())
        if more:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary())] * 2, ["a", "b"])

    known = roots.select(F.col("node").alias("_node"), "root")
    rows = postings.join(known, F.col("node") == F.col("_node"), "left").select("s", "n", "at", "node", F.coalesce("root", "node").alias("root"), *_BEFORE)
    return rows.repartition("s").sortWithinPartitions("s", "n", "node").mapInArrow(run, "a binary, b binary")


def similar(pairs: DataFrame, at_least: float, shingle: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, text_a, text_b) whose sets of word shingles have Jaccard similarity ``at_least``; a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # one pair at a time is Python strings
                p, q = shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= at_least * (len(p) + len(q) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def key_of(doc_id: Column, th: Column) -> Column:
    """What a row is known by beside the hash of its text; rows are joined on both, two hashes of 64 bits."""
    return F.xxhash64(doc_id, th, F.lit(7))


def listed(keys: DataFrame, name: str) -> Callable[[str, str], Column]:
    """Whether a row of key ``k`` and hash ``own`` may be one of ``keys`` (k, own), by a Bloom filter of bounded size: it
    keeps most other texts out of a shuffle, and a join decides."""
    word = lambda k, own: F.concat_ws(":", k, own)
    bits = materialize(bloom_filter(keys.select(word("k", "own").alias("key"))), name).scalar()
    return lambda k, own: might_contain(bits, word(k, own))


def _texts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """k, own, text of the rows that ``ends`` lists, once each, and of few others."""
    source = docs.select("doc_id", text_of().alias("text")).withColumn("own", F.xxhash64("text")).withColumn("k", key_of(F.col("doc_id"), F.col("own")))
    source = source.where(listed(ends, "similar-filter")("k", "own"))
    return materialize(source.select("k", "own", "text").dropDuplicates(["k", "own"]), "similar-texts")


def _checked(pairs: DataFrame, ends: DataFrame, texts: DataFrame, at_least: float, shingle: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that are similar by the texts of their ``ends`` (node, k, own)."""
    for c in "ab":
        pairs = pairs.join(ends.select(F.col("node").alias(c), F.col("k").alias(f"k_{c}"), F.col("own").alias(f"own_{c}")), c)
    pairs = materialize(pairs, "similar-ends")
    both = [pairs.select(F.col(f"k_{c}").alias("k"), F.col(f"own_{c}").alias("own")) for c in "ab"]
    texts = texts.where(listed(both[0].unionByName(both[1]), "similar-filter")("k", "own"))
    for c in "ba":
        pairs = pairs.join(texts.select(F.col("k").alias(f"k_{c}"), F.col("own").alias(f"own_{c}"), F.col("text").alias(f"text_{c}")), [f"k_{c}", f"own_{c}"])
    return materialize(similar(pairs, at_least, shingle), "similar-links")


def similar_groups(docs: DataFrame, at_least: float, shingle: int, proposed: Callable[[DataFrame], DataFrame] | None = None, apart: int = APART) -> DataFrame:
    """doc_id, th, node, component_id, first_th of every row of ``docs`` (doc_id, text).

    Rows of a component share ``component_id``, its smallest doc_id, and ``first_th``, the hash of that row's text.
    ``proposed``: pairs (a, b) of nodes (node, fp) that are checked first. ``apart``: how many bits of fingerprints of LARGE sets may
    differ in pairs that are checked; at 64 no pair is passed over, and the groups are exact.
    """
    rows = materialize(set_rows(docs, at_least, shingle), "similar-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("least")
    classes = materialize(rows.groupBy("node").agg(least, F.first("n").alias("n"), F.first("prefix").alias("prefix")), "similar-classes")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    fps = classes.select("node", F.substring("node", 1, 8).alias("fp"))
    first = proposed(fps).select(*ordered("a", "b")).distinct() if proposed else None
    postings = materialize(_met(_dealt(classes), at_least, apart), "similar-lists")
    classes = classes.select("node", "least")
    ends = classes.select("node", key_of(F.col("least.doc_id"), F.col("least.th")).alias("k"), F.col("least.th").alias("own"))
    heads = postings.where("first IS NOT NULL").groupBy("node").agg(F.min("first").alias("first"))
    tested = heads.select(*ordered("node", "first")).unionByName(postings.where("near IS NOT NULL").select(*ordered("node", "near")))
    tested = materialize((tested.unionByName(first) if first is not None else tested).distinct(), "similar-pairs")
    # also the sets that only the first search pairs
    needed = postings.select("node").unionByName(tested.select(F.col("a").alias("node"))).unionByName(tested.select(F.col("b").alias("node")))
    ends = materialize(ends.join(needed.distinct(), "node"), "similar-ends")
    texts = _texts(docs, ends)
    check = lambda pairs: _checked(pairs, ends, texts, at_least, shingle)

    roots, span = connected_components(check(tested)), SPAN
    past, more = 0, not postings.isEmpty()
    while more:
        met = materialize(_round(postings, roots, past, span, at_least, apart), "similar-round")
        pairs = met.where("a IS NOT NULL").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "similar-pairs")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            # what is known goes in as each node's root, so that few rounds are left
            roots = connected_components(check(pairs).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        past, span, more = span, span * GROWTH, not met.where("a IS NULL").isEmpty()
    rooted = classes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "similar-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of = rooted.select("node", "root").join(named, "root").select(F.col("node").alias("_node"), F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("first_th"))
    return rows.select("doc_id", "th", "node").join(of, F.col("node") == F.col("_node")).drop("_node")
