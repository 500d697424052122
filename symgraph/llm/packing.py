"""Packing token streams into sequences with a controlled mixture: deficit round-robin over source queues.

Documents are dealt by hash to lanes of about LANE_TOKENS; rows that repeat are told apart by their number, so that they go to many
lanes too. In a lane every source has a queue; each round gives a source its target share of a window in credit, fills the window
and cuts documents where the credit ends, so that every window has each source's tokens in proportion. What whole tokens leave, and
credit below LEAST tokens (a piece should be more than a scrap), is the source's deficit and carries on to the next window. Across lanes
it carries on as well: what a source is owed at a lane's start is its share of all tokens packed before, less what it had served,
and both follow from sums over the lanes before, so lanes run in parallel and yet continue one another. A lane pays evenly over its
windows what it was handed, so that no window strays from the target to make up for others. Where a source's queue in a lane runs out
before the lane does, the others fill its place in proportion, and the next lane is handed the deficit.

Lanes follow one another in one stream, so a sequence may span two lanes and none is left partly filled at a lane's end.
The tail of the stream, short of a window, is cut at powers of two, which need no padding.

Targets: by default each source's share of all tokens, the only proportions at which every document is packed and no
source runs out before the others. ``weights`` overrides them; then sources that run out leave their share to the rest.

Scale: tokens are written once and shuffled once, by lane; a worker holds one lane's tokens at a time, and one batch. Sums over
lanes have two levels. One number, the sum of all tokens, comes to the driver.

Defined cases: a null text is empty and packs as its end id alone; a null source is a queue of its own; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .mixing import _running
from .tokens import TOKENIZER, tokenizer_for

WINDOW, LEAST, LANE_TOKENS, END_ID = 4096, 16, 1 << 19, 2
#: Tokens that a task reads, about, where the session's number of partitions would give it more.
TASK_TOKENS = 1 << 25
_COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, h (orders the rows at random, the same way every time), copy, n, ids (little-endian, the end id last;
    16 bits each if the vocabulary fits, else 32). copy: how many rows of the same h the task had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_for(tokenizer)
        end = np.array([END_ID], dtype=tokens.dtype)
        before: Counter[int] = Counter()
        for batch in batches:
            copies = []
            for h in batch.column(2).to_pylist():
                copies.append(before[h])
                before[h] += 1
            ids = [np.concatenate((x, end)) for x in tokens.ids((x.as_py() for x in batch.column(3)))]
            n = pa.array([len(x) for x in ids], pa.int64())
            made = [pa.array(copies, pa.int64()), n, pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "source", "h", "copy", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "source", F.xxhash64("doc_id", text_of()).alias("h"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, h bigint, copy bigint, n bigint, ids binary")


def _dealt(room: int, owed: dict, left: dict) -> dict:
    """How many of ``room`` tokens each source gets: in proportion to what it is owed, whole tokens, the largest remainders first,
    none beyond what it has left."""
    out: dict = {}
    while room and (open_ := [s for s in owed if left[s] > out.get(s, 0)]):
        sum_ = sum(owed[s] for s in open_)
        exact = {s: room * owed[s] / sum_ for s in open_}
        more = {s: int(exact[s]) for s in open_}
        for s in sorted(open_, key=lambda s: more[s] - exact[s])[: max(0, room - sum(more.values()))]:
            more[s] += 1
        for s in open_:
            n = min(more[s], left[s] - out.get(s, 0), room)
            out[s] = out.get(s, 0) + n
            room -= n
    return out


def round_robin(queues: dict, credit: dict, share: dict, at: int = 0, window: int = WINDOW, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(row, start, length) in the order served, from ``at`` tokens into the stream: a round fills the rest of a window.
    ``queues``: source -> deque of (row, tokens); ``credit``: carried in, and paid evenly over the lane."""
    left = {s: sum(n for _, n in q) for s, q in queues.items()}
    lane = sum(left.values())
    rate = {s: max(0.0, share[s] + credit.get(s, 0.0) / max(1, lane)) for s in queues}
    begun = dict.fromkeys(queues, 0)
    # sources too small for a piece a window begin at different stages of waiting, so that they do not all wait and come due together
    deficit = {s: least * (i * 0.618034 % 1) if rate[s] * window < least else 0.0 for i, s in enumerate(queues)}
    while open_ := [s for s in queues if left[s]]:
        room = min(window - at % window, lane)
        all_ = sum(rate[s] for s in open_) or 1.0
        for s in open_:
            deficit[s] += rate[s] / all_ * room
        # a source waits until a piece of some length is due; if nobody is due, whoever is owed most, or else all, go by rate
        due = {s: deficit[s] for s in open_ if deficit[s] >= min(least, left[s])}
        parts = _dealt(room, due, left) if due else {}
        if (rest := room - sum(parts.values())) > 0:
            others = {s: left[s] - parts.get(s, 0) for s in open_ if left[s] > parts.get(s, 0)}
            for s, n in _dealt(rest, {s: rate[s] or 1e-9 for s in others}, others).items():
                parts[s] = parts.get(s, 0) + n
        for s, n in parts.items():
            deficit[s] -= n
            left[s] -= n
            queue = queues[s]
            while n:
                row, size = queue[0]
                size = min(n, size - begun[s])
                yield row, begun[s], size
                begun[s] += size
                n -= size
                if begun[s] == queue[0][1]:
                    queue.popleft()
                    begun[s] = 0
        at, lane = at + room, lane - room


def cut(at: int, length: int, total: int, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(sequence, offset, length) of the stretch that begins ``at`` tokens into a stream of ``total``."""
    whole = total // window * window
    while length and at < whole:
        n = min(length, window - at % window)
        yield at // window, at % window, n
        at, length = at + n, length - n
    first, number, left = whole, whole // window, total - whole
    while left:  # the tail: its binary digits, the largest first
        size = 1 << (left.bit_length() - 1)
        if length and first <= at < first + size:
            n = min(length, first + size - at)
            yield number, at - first, n
            at, length = at + n, length - n
        first, number, left = first + size, number + 1, left - size


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, weights: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, if asked, ids."""
    tokens = materialize(tokenized(docs, tokenizer), "tokens")
    size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lanes = size // LANE_TOKENS + 1
    tokens = tokens.withColumn("lane", F.pmod(F.xxhash64("h", "copy"), F.lit(lanes)))
    sums = materialize(tokens.groupBy("lane", "source").agg(F.sum("n").alias("n")), "lane-sums")
    total = sums.select(F.sum("n")).scalar()
    per = sums.groupBy("source").agg(F.sum("n").alias("_all"))
    if weights:
        pick = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.coalesce("source", F.lit(""))], F.lit(1.0))
        per = per.withColumn("_all", pick)
    per = per.select(F.col("source").alias("_source"), (F.col("_all") / per.select(F.sum("_all")).scalar()).alias("share"))
    by_lane = sums.groupBy("lane").agg(F.sum("n").alias("n")).withColumn("bucket", F.floor(F.col("lane") / 4096)).withColumn("one", F.lit(1))
    starts = _running(by_lane, ["one"], [F.col("lane")], "bucket", F.col("n"), "begins").select(F.col("lane").alias("_lane"), "begins")
    keyed = sums.withColumn("bucket", F.floor(F.col("lane") / 4096)).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    served = _running(keyed, ["key"], [F.col("lane")], "bucket", F.col("n"), "served")
    heads = served.join(starts, F.col("lane") == F.col("_lane")).join(per, F.col("source").eqNullSafe(F.col("_source")))
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("lane", F.lit(0).alias("kind"), "source", none("bigint").alias("h"), none("bigint").alias("doc_id"), F.col("begins").alias("n"), none("binary").alias("ids"), "share", (F.col("share") * F.col("begins") - F.col("served")).alias("carry"), F.coalesce(total, F.lit(0)).alias("total"))
    rows = tokens.select("lane", F.lit(1).alias("kind"), "source", "h", "doc_id", "n", "ids", none("double").alias("share"), none("double").alias("carry"), none("bigint").alias("total"))
    every, tasks = heads.unionByName(rows), size // TASK_TOKENS + 1
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (every.repartition(tasks, "lane") if tasks > usual else every.repartition("lane")).sortWithinPartitions("lane", "kind", "source", "h", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, kept = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != lane and kept:
                    yield _pieces(kept, with_ids)
                    kept = []
                lane = row[0]
                kept.append(row)
        if kept:
            yield _pieces(kept, with_ids)

    return dealt.mapInArrow(run, _COLUMNS + (", ids array<int>" if with_ids else ""))


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    """The pieces of one lane: its heads (a source's share and carry, where the lane begins), then its documents."""
    share, credit, queues, at, total = {}, {}, {}, 0, 0
    for i, (_, kind, source, _, _, n, _, part, carry, total_) in enumerate(rows):
        if not kind:
            share[source], credit[source], at, total = part, carry, n, total_
        else:
            queues.setdefault(source, deque()).append((i, n))
    out: list[list] = []
    for i, start, length in round_robin(queues, credit, share, at):
        for sequence, offset, n in cut(at, length, total):
            last = out[-1] if out else None
            if last and last[0] == i and last[3] == sequence and last[1] + last[2] == start:
                last[2] += n
            else:
                out.append([i, start, n, sequence, offset])
            start, at = start + n, at + n
    ids = {}
    for i, (_, kind, _, _, _, n, raw, *_) in enumerate(rows):
        if kind:
            ids[i] = np.frombuffer(raw, dtype=f"<u{len(raw) // n}")
    data = [ids[i][start : start + n].astype("<u4").tobytes() for i, start, n, _, _ in out]
    ints = lambda values: pa.array(list(values), pa.int64())
    columns = [
        ints(rows[x[0]][4] for x in out), ints(x[1] for x in out), ints(x[2] for x in out), ints(zlib.crc32(d) for d in data),
        ints(rows[x[0]][5] for x in out), ints(x[3] for x in out), ints(x[4] for x in out), pa.array([rows[x[0]][2] for x in out], pa.string()),
    ]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    if with_ids:
        ends = np.concatenate(([0], np.cumsum([x[2] for x in out]))).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), dtype="<i4"), pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def query(docs: DataFrame) -> DataFrame:
    """The pieces of every document."""
    return pack(docs.select("doc_id", "text", "source"))
