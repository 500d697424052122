"""Mixing sources to target weights by a low-discrepancy schedule. Built-in functions only.

The mix is a row of slots of ``block`` words each. Slot n has the golden-ratio point frac(n * phi); mapped through the
sources' cumulative targets it names a source. A source's slots are ranked; rank k takes its block k modulo the number
of its blocks, so a source larger than its target is taken in part and a smaller one again. A source's blocks are equal
cuts of its documents, laid end to end in a fixed random order.

Targets: sources in code-point order (null last) weigh WEIGHTS, repeating; they share ``budget`` times all words. No
target exceeds MOST times its source's words; the excess goes to the others by weight until none is above (the level at
which all fit, found by sorting the sources by what they can hold a weight).

Scale: every running sum has two levels, over buckets of bounded size and within one, so a source holding a third of
all rows is spread over as many tasks as its size asks for; sources themselves are put in order by ranges, so there may be many. Slots find their source by an equi-join on a bin of the unit interval;
low-discrepancy points fill the bins evenly.

Defined cases: a null text has no words; documents without words, and sources without any, are returned with zeros; a
null source is a source of its own; repeated rows count as documents of their own and each is returned; empty tables
give empty results. A source at its cap may be due a slot more than twice its blocks; that slot stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
#: Words in a slot, and how many slots a small mix has at least (slots get smaller for that, not under MIN_BLOCK).
BLOCK, MIN_BLOCK, LEAST_SLOTS = 512, 8, 16384
#: Rows in a bucket of a running sum, about; slots in a chunk of their ranking.
BUCKET_ROWS, CHUNK = 8192, 1 << 12
PHI = 0.6180339887498949
SEED = 17


def sized(docs: DataFrame, th: Column | None = None) -> DataFrame:
    """doc_id, source, th (what tells documents of one id apart), size (words of the text)."""
    return docs.select("doc_id", "source", (F.lit(0).cast("long") if th is None else th).alias("th"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``bucket``, numbers of ranges of ``order``, and ``one``, a key that all rows share; written, so that the ranges stay."""
    return materialize(df.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()).withColumn("one", F.lit(1)), "mix-ranges")


def _by_source() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, docs, target and s, its number from 1 in order of the sources; bucket, one (see ``_ranged``)."""
    per = _ranged(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), *_by_source())
    per = _running(per, ["one"], _by_source(), "bucket", F.lit(1).cast("long"), "before").withColumn("s", F.col("before") + 1).drop("before")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = materialize(per.withColumn("weight", pick).withColumn("cap", most * F.col("source_size")), "mix-numbers")
    # in order of what they can hold a weight: while a source is filled to its cap the level only rises; the first one that is not
    # filled sets it for all that follow, and those before hold their cap
    order = [F.col("cap") / F.col("weight"), F.col("s")]
    sums = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight"))
    sorted_ = _ranged(per.select("s", "cap", "weight"), *order)
    filled = _running(_running(sorted_, ["one"], order, "bucket", F.col("cap"), "filled"), ["one"], order, "bucket", F.col("weight"), "spent")
    level = (budget * sums.select("words").scalar() - F.col("filled")) / (sums.select("weight").scalar() - F.col("spent"))
    first = filled.withColumn("level", level).where(F.col("level") * F.col("weight") < F.col("cap"))
    level = first.agg(F.min_by("level", F.struct(*order)).alias("level")).scalar()
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return materialize(per.select("source", "source_size", "docs", "s", "bucket", "one", target.alias("target")), "mix-targets")


def _running(df: DataFrame, keys: list[str], order: list[Column], bucket: str, value: Column, into: str) -> DataFrame:
    """``into``: the sum of ``value`` over the rows before, by key, in order of (bucket, order)."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(*keys, bucket).agg(F.sum("_v").alias("_s"))
    first = F.sum("_s").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*keys, bucket)], F.coalesce(first, F.lit(0)).alias("_first"))
    within = F.coalesce(F.sum("_v").over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = F.lit(True)
    for c in (*keys, bucket):
        same = same & (F.col(c) == F.col(f"_{c}"))
    return df.withColumn("_w", within).join(sums, same).withColumn(into, F.col("_first") + F.col("_w")).drop("_v", "_w", "_first", *[f"_{c}" for c in (*keys, bucket)])


def schedule(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """slot, source number s and block: the mix in order. ``sources``: s, target, blocks, lo, hi (its part of the unit interval), slots, bins."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.max("slots"), F.lit(0))).scalar()
    bins = sources.agg(F.coalesce(F.max("bins"), F.lit(1))).scalar()
    point = lambda c: F.pmod(F.lit(seed * PHI) + c * PHI, F.lit(1.0))
    # a generator, as the number of slots is itself computed: chunks, then the slots of each
    chunks = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.floor(n / CHUNK))).alias("chunk")).repartition("chunk")
    slots = chunks.select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.col("chunk") * CHUNK + CHUNK - 1)).alias("slot")).where(F.col("slot") < n)
    slots = slots.withColumn("u", point(F.col("slot"))).withColumn("bin", F.floor(F.col("u") * bins))
    spans = sources.where("target > 0").select("s", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.floor(F.col("hi") * bins))).alias("bin"))
    # the planner cannot know how many slots the generator makes and would send them to every task: the hint forbids it here, and
    # what is written has its true size for the joins that follow
    placed = slots.hint("merge").join(spans, "bin").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "chunk", "s", "blocks")
    placed = materialize(placed, "mix-slots")
    ranked = _running(placed, ["s"], [F.col("slot")], "chunk", F.lit(1), "rank")
    return ranked.where(F.col("rank") < MOST * F.col("blocks")).select("slot", "s", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def pieces(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """row, s, block, words: what of each document lies in each block of its source."""
    keyed = rows.where("size > 0").withColumn("h", F.xxhash64("row", F.lit(seed)))
    # buckets by the hash's top, as many as the source's rows ask for
    joined = keyed.join(sources.select(F.col("s").alias("_k"), "docs", "block_words"), F.col("s") == F.col("_k")).drop("_k")
    joined = joined.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 33) / float(1 << 31) * F.ceil(F.col("docs") / BUCKET_ROWS)))
    laid = _running(joined, ["s"], [F.col("h"), F.col("row")], "bucket", F.col("size"), "at")
    first, last = F.floor(F.col("at") / F.col("block_words")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block_words"))
    cut = laid.select("row", "s", "at", "size", "block_words", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest(F.col("at"), F.col("block") * F.col("block_words"))
    return cut.select("row", "s", "block", words.alias("words"))


def mix(docs: DataFrame, seed: int = SEED, th: Column | None = None) -> DataFrame:
    """One row a document: doc_id, source, th, size, source_size, target, taken."""
    sizes = materialize(sized(docs, th), "mix-sizes")
    targets = source_targets(sizes)
    # equal documents, as to id, source and size, are one row here with a count
    rows = sizes.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("copies"))
    sums = materialize(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("total"), F.count("*").alias("n")), "mix-sums")
    total, n = sums.select("total").scalar(), sums.select("n").scalar()
    words = F.greatest(F.lit(MIN_BLOCK), F.least(F.lit(BLOCK), F.floor(total / LEAST_SLOTS))).cast("long")
    sources = _running(targets, ["one"], [F.col("s")], "bucket", F.col("target"), "at").select(
        "source", "source_size", "docs", "target", "s", words.alias("block_words"),
        F.ceil(F.col("source_size") / words).cast("long").alias("blocks"), F.ceil(total / words).cast("long").alias("slots"), F.try_divide(F.col("at"), total).alias("lo"),
        F.when(F.col("s") == n, F.lit(1.0)).otherwise(F.try_divide(F.col("at") + F.col("target"), total)).alias("hi"),
        F.greatest(n * 16, F.ceil(total / words / CHUNK)).cast("long").alias("bins"),
    )
    sources = materialize(sources, "mix-sources")
    numbered = rows.join(sources.select("s", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # each copy of a row gets its number, so that all of them are laid out
    numbered = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    numbered = materialize(numbered.withColumn("row", F.struct("doc_id", "th", "size", "copy")), "mix-rows")
    takes = schedule(sources, seed).hint("merge").join(pieces(numbered, sources, seed), ["s", "block"]).groupBy("row", "s").agg(F.sum("words").alias("taken"))
    left = numbered.select("doc_id", "source", "th", "size", "s", "row")
    out = left.join(takes.withColumnRenamed("s", "_s").withColumnRenamed("row", "_row"), (F.col("s") == F.col("_s")) & F.col("row").eqNullSafe(F.col("_row")), "left")
    per = sources.select(F.col("s").alias("_t"), "source_size", "target")
    return out.join(per, F.col("s") == F.col("_t")).select("doc_id", "source", "th", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).cast("long").alias("taken"))


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken / size times, the fraction by a hash of the document.

    A document that the mix takes no word of goes; one without words, which no weight concerns, stays once.
    """
    key = [F.col("doc_id"), F.xxhash64(text_of())]
    taken = mix(docs.select("doc_id", "text", "source"), seed, F.xxhash64(text_of())).groupBy("doc_id", "th", "source").agg(F.max("size").alias("size"), F.avg("taken").alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    times = F.when(F.col("_size") == 0, F.lit(1.0)).otherwise(F.col("_taken") / F.col("_size"))
    whole = F.floor(times)
    # the caller's columns are one struct here, so that no name can clash
    marked = docs.select(F.struct("*").alias("d"), key[1].alias("own"))
    chance = F.pmod(F.xxhash64("d.doc_id", "_th", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    copies = (whole + F.when(chance < times - whole, 1).otherwise(0)).cast("int")
    same = F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_th")) & F.col("d.source").eqNullSafe(F.col("_source"))
    drawn = marked.join(taken, same).withColumn("copies", copies).where(F.col("copies") > 0)
    return drawn.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
