"""Byte-level BPE by a rank file: encoding, with a hierarchical-bitmap queue of ranks, and decoding.

A text is split by a pattern, and each match (a pre-token) is merged on its own. The queue has a bucket for every rank that some pair of
neighbours has; a bucket holds places in a linked list of parts. Three levels of bits mark the ranks whose buckets hold something, and
finding the lowest set bit of one word a level gives the lowest rank: no search over pairs, no heap. A merge changes two pairs; what
they were stays in its bucket and is skipped when its turn comes, as the place no longer has that rank.

All pre-tokens that a worker has not met before go into one list, without links between them, so a bucket holds the places of many
words, or the many places of a very long one, and is merged by array operations: time grows with bytes at any length of pre-token.
Ids are those of merging the leftmost pair of the lowest rank until none is left. In a bucket all places may be merged at once if no
merge of that rank can make a pair of a lower one, which is known of each rank from the file; of other ranks, the places of a pre-token up to one that does.

A worker numbers the pre-tokens that it meets and keeps their ids, up to a bound, so that a text is then a gather from an array.

Scale: one pass over the rows, nothing is shuffled. Long texts are split piece by piece, cut before white space that
follows a character that is none, where the split pattern always ends a match.

Defined cases: a null text is the empty text and has no ids; special tokens are ordinary text; repeated rows give repeated rows; other columns
are not read; an empty table gives an empty result. A file that lacks a single byte is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import path_of

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker numbers before it starts afresh, and their characters.
REMEMBER, CHARACTERS = 250_000, 1 << 23
#: Characters of texts that are numbered before new pre-tokens are merged, and bytes of those that are merged together, about.
GROUP, TOGETHER = 1 << 22, 1 << 19
#: Characters that are split, and items that are gathered, at a time.
PIECE, GATHERED = 1 << 18, 1 << 18
#: Places that are looked at in one go where a merge may make a pair of a lower rank.
IN_TURN = 1 << 12


def default_pattern() -> str:
    """The split pattern that belongs to the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Places by rank, the lowest rank first."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.words = [0] * ((ranks >> 6) + 1)  # a bit a rank
        self.groups = [0] * ((ranks >> 12) + 1)  # a bit a word that is not zero
        self.top = 0  # a bit a group that is not zero, of any number

    def push(self, rank: int, places: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(places)
            return
        self.buckets[rank] = [places]
        word = rank >> 6
        self.words[word] |= 1 << (rank & 63)
        self.groups[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank that has places, found by one find-first-set a level, and its places from left to right, which go."""
        group = (self.top & -self.top).bit_length() - 1
        marked = self.groups[group]
        word = group << 6 | (marked & -marked).bit_length() - 1
        bits = self.words[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.words[word] = bits = bits & (bits - 1)
        if not bits:
            self.groups[group] = marked = marked & (marked - 1)
            if not marked:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Merges:
    """merge(pieces) by one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for byte {missing[0]}")
        self.ranks, self.size = ranks, 1 + max(ranks.values())
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        splits = [(ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(splits), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.rank_of_pair = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], -1)
        self.safe = np.ones(self.size, dtype=bool)  # ranks whose tokens are in pairs of higher ranks only
        for part in (pairs[:, 0] >> 32, pairs[:, 0] & 0xFFFFFFFF):
            self.safe[part[pairs[:, 1] <= part]] = False

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 if it has none; an id of -1 is in no pair."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs[:-1], keys)
        return np.where((self.pairs[at] == keys) & (right >= 0), self.rank_of_pair[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        word = np.repeat(np.arange(len(pieces)), sizes)
        # parts are named by the byte at which they begin; n stands for none
        ids = np.append(self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1], before[(ends - sizes)[sizes > 0]] = n, n
        rank_at = np.full(n + 1, -1)  # the rank of a part and the next one as a pair; -1: no pair, or a part that is gone
        rank_at[:n] = self.rank(ids[:n], ids[after[:n]])
        queue, gone = RankQueue(self.size), np.zeros(n, dtype=bool)
        places = np.flatnonzero(rank_at >= 0)
        self._push(queue, rank_at[places], places)
        while queue.top:
            rank, places = queue.pop()
            if not self.safe[rank] and len(places) > IN_TURN:
                queue.push(rank, places[IN_TURN:])
                places = places[:IN_TURN]
            places = places[rank_at[places] == rank]  # the others are stale: they have another pair by now, or none
            if not len(places):
                continue
            if self.safe[rank]:
                places = places[_apart(places, after)]
            else:
                places, waiting = self._in_turn(rank, places, ids, after, before, word)
                if len(waiting):
                    queue.push(rank, waiting)
            second = after[places]
            end = after[second]
            after[places], before[end], ids[places] = end, places, rank
            rank_at[second], gone[second] = -1, True
            left = before[places]
            left = left[left < n]
            changed = np.concatenate((places, left))
            new = self.rank(ids[changed], ids[after[changed]])
            rank_at[changed] = new
            self._push(queue, new, changed)
        kept = ~gone
        return ids[:n][kept].astype("<u4"), np.bincount(word[kept], minlength=len(pieces))

    def _in_turn(self, rank: int, places: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places can be merged before a merge makes a pair whose turn is no later, and which wait for that pair."""
        apart = _apart(places, after)
        left, right = before[places], after[after[places]]
        merged = np.append(False, (left[1:] == after[places[:-1]]) & apart[:-1])  # the part on the left is a merge of this rank already
        low = self.rank(np.where(merged, rank, ids[left]), np.full(len(places), rank)), self.rank(np.full(len(places), rank), ids[right])
        makes = apart & (((low[0] >= 0) & (low[0] <= rank)) | ((low[1] >= 0) & (low[1] <= rank)))
        if not makes.any():
            return places[apart], places[:0]
        earlier = np.cumsum(makes) - makes
        starts = np.append(True, word[places[1:]] != word[places[:-1]])
        waits = earlier > np.maximum.accumulate(np.where(starts, earlier, 0))
        return places[apart & ~waits], places[waits]

    @staticmethod
    def _push(queue: RankQueue, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put each place into the bucket of its rank; places without a rank stay out."""
        some = ranks >= 0
        ranks, places = ranks[some], places[some]
        if len(ranks) > 1:
            order = np.lexsort((places, ranks))
            ranks, places = ranks[order], places[order]
            once = np.append(True, (ranks[1:] != ranks[:-1]) | (places[1:] != places[:-1]))
            ranks, places = ranks[once], places[once]
            starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(starts, starts[1:]):
                queue.push(int(ranks[a]), places[a:b])
        elif len(ranks):
            queue.push(int(ranks[0]), places)


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of ascending places to merge: where pairs overlap in a row, every other one from the left."""
    overlaps = np.append(False, places[1:] == after[places[:-1]])
    number = np.arange(len(places))
    return (number - np.maximum.accumulate(np.where(overlaps, 0, number))) % 2 == 0


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> Iterator[bytes]:
    """The stretches of ``flat`` that items ``which`` stand for, one after another, some at a time."""
    for at in range(0, len(which), GATHERED):
        part = which[at : at + GATHERED]
        n = sizes[part]
        shift = begins[part] - np.cumsum(n) + n
        yield flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes()


class _Numbers(dict):
    """pre-token -> its number; new ones are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.new.append(token)
        return number


class BytePairs:
    """encode(texts) and decode(ids) for one rank file; one for each worker process."""

    def __init__(self, ranks: str = RANKS, pattern: str | None = None) -> None:
        self.ranks = read_ranks(path_of(ranks))
        self.merges: Merges | None = None
        self.split = regex.compile(pattern or default_pattern()).findall
        by_id = {i: t for t, i in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(1 + max(by_id, default=-1))]
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._afresh()

    def _afresh(self) -> None:
        self.numbers, self.characters = _Numbers(), 0
        self.known_ids, self.known_sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def _learn(self) -> None:
        """Find the ids of the pre-tokens that are new; those that are tokens themselves are not merged."""
        self.merges = self.merges or Merges(self.ranks)
        new, self.numbers.new = self.numbers.new, []
        at = 0
        while at < len(new):
            upto, size = at, 0
            whole, parts = [], []
            while upto < len(new) and size < TOGETHER:
                token = new[upto].encode()
                rank = self.ranks.get(token)
                whole.append(-1 if rank is None else rank)
                if rank is None:
                    parts.append(token)
                    size += len(token)
                upto += 1
            ids, sizes = self.merges.merge(parts)
            whole = np.array(whole)
            every = np.ones(len(whole), dtype=np.int64)
            every[whole < 0] = sizes
            out = np.repeat(whole, every)
            out[out < 0] = ids
            self.known_ids, self.known_sizes = np.append(self.known_ids, out.astype("<u4")), np.append(self.known_sizes, every)
            self.characters += sum(map(len, new[at:upto]))
            at = upto

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                out += self._encoded(group)
                group, size = [], 0
        return out + self._encoded(group)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        number = self.numbers.__getitem__
        found = [[np.fromiter(map(number, self.split(piece)), dtype=np.int32) for piece in pieces(text)] for text in texts]
        self._learn()
        begins = np.cumsum(self.known_sizes) - self.known_sizes
        out = [b"".join([x for part in parts for x in gather(self.known_ids, begins, self.known_sizes, part)]) for parts in found]
        if len(self.numbers) > REMEMBER or self.characters > CHARACTERS:
            self._afresh()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(gather(self.bytes, self.begins, self.sizes, np.frombuffer(ids, dtype="<u4")))


_CUT = regex.compile(r"(?<=\S)\s")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only before white space that follows none, where every match ends."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


_open: dict[tuple, BytePairs] = {}


def byte_pairs(ranks: str, pattern: str | None) -> BytePairs:
    """The worker's own coder, loaded once."""
    if (ranks, pattern) not in _open:
        _open[ranks, pattern] = BytePairs(ranks, pattern)
    return _open[ranks, pattern]


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit numbers) of every whole text.

    ``ranks``: a file, or the name of an installed public one. A pattern of the caller's must, as the public one does, end a match
    before white space that follows a character that is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(ranks, pattern)
        for batch in batches:
            ids = coder.encode(t.as_py() for t in batch.column(1))
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (binary) of rows of ``encode``; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(ranks, None)
        for batch in batches:
            decoded = pa.array([coder.decode(x.as_py() or b"") for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def text_from(decoded: Column) -> Column:
    """Decoded bytes as a string; ids of a whole text always give whole characters."""
    return F.decode(decoded, "UTF-8")


def query(docs: DataFrame) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    rows = decode(encode(docs))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
