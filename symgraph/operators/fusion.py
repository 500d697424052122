"""Fusion of ranked lists, reranking, and the choice of a strategy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions.text import lines

#: Fixed values of the candidate funnel.
RRF_K, CANDIDATES, KEPT = 60, 24, 8
RERANK_WEIGHT, PASSAGE_LINES = 0.75, 40
KEY = ["filepath", "symbol", "start_line"]
STRATEGIES = {
    "symbol_lookup": "vector", "implementation": "vector", "call_flow": "graph", "impact": "graph",
    "dependency": "hybrid", "architecture": "hybrid", "bug_analysis": "hybrid",
}


def reciprocal_rank_fusion(lists: DataFrame, n_lists: int, k: int = RRF_K) -> DataFrame:
    """Key, rrf_score, score, sources, vector_score, bm25_score, rank.

    ``lists``: list_id (0 first), rank, source (``vector`` or ``bm25``), score, key. ``n_lists`` counts empty lists too,
    so it is given and never derived from rows. Ties go to the list, then the rank, where a hit was seen first.
    """
    seen = lists.withColumn("at", F.struct("list_id", "rank"))
    fused = seen.groupBy(*KEY).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf_score"),
        F.min("at").alias("first_at"),
        F.array_sort(F.collect_set(F.struct("list_id", "source"))).alias("_s"),
        F.max(F.when(F.col("source") == "vector", F.col("score"))).alias("vector_score"),
        F.max(F.when(F.col("source") == "bm25", F.col("score"))).alias("bm25_score"),
    )
    order = W.partitionBy().orderBy(F.desc("rrf_score"), "first_at")
    out = fused.withColumn("sources", F.array_distinct(F.transform("_s", lambda x: x["source"])))
    out = out.withColumn("score", F.col("rrf_score") / (n_lists / (k + 1.0)))
    # the lists hold at most a few dozen hits each
    return out.withColumn("rank", F.row_number().over(order)).drop("_s", "first_at")


def passage(symbol: Column, chunk_type: Column, filepath: Column, code: Column, most: int = PASSAGE_LINES) -> Column:
    """What a reranker reads of a hit."""
    return F.concat(symbol, F.lit(" ("), chunk_type, F.lit(") in "), filepath, F.lit("\n"), F.array_join(F.slice(lines(code), 1, most), "\n"))


def word_overlap(question: str) -> Callable[[Column], Column]:
    """A deterministic scorer: the share of the question's words that a passage has."""
    words = sorted(set(question.lower().split()))
    return lambda text: sum((F.when(F.contains(F.lower(text), F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words))


def rerank(hits: DataFrame, score: Column, top_k: int = KEPT, weight: float = RERANK_WEIGHT) -> DataFrame:
    """Hits in the order of ``weight * score + (1 - weight) * retrieval score``; ``hits`` has rank and score."""
    w = min(1.0, max(0.0, weight))
    out = hits.withColumn("retrieval_rank", F.col("rank")).withColumn("retrieval_score", F.col("score")).withColumn("rerank_score", score)
    out = out.withColumn("score", F.round(w * F.col("rerank_score") + (1 - w) * F.col("retrieval_score"), 9))
    return out.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("score"), "retrieval_rank"))).where(F.col("rank") <= top_k)


def model_scores(hits: DataFrame, model: Callable[[str, list[str]], list[float]], question: str, text: str = "passage") -> DataFrame:
    """``hits`` with ``model_score`` of a pluggable model, in batches; the model is called after the limit."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model(question, part.tolist()), dtype="float64")

    return hits.withColumn("model_score", run(F.col(text)))


def merged_queries(rows: DataFrame, most: int = 3) -> DataFrame:
    """conv_id, ord, query: stripped queries, the first of those equal but for case, at most ``most`` (rows: conv_id, ord, query)."""
    cleaned = rows.withColumn("query", F.trim("query")).where(F.length("query") > 0)
    first = cleaned.groupBy("conv_id", F.lower("query").alias("_l")).agg(F.min(F.struct("ord", "query")).alias("f"))
    out = first.select("conv_id", "f.ord", "f.query")
    return out.withColumn("ord", F.row_number().over(W.partitionBy("conv_id").orderBy("ord"))).where(F.col("ord") <= most)


def strategy(query_type: Column) -> Column:
    """The retrieval strategy of a query type; unknown types search vectors."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])[query_type], F.lit("vector"))


def expansion(named: DataFrame, overriding: DataFrame, callees: DataFrame, seen: DataFrame, limit: int = 6) -> DataFrame:
    """Symbols to pull in through the graph: those a question names, then overrides, then direct callees (ord, filepath, symbol)."""
    parts = [df.select(F.lit(i).alias("priority"), "ord", "filepath", "symbol") for i, df in enumerate((named, overriding, callees), 1)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(seen.select("filepath", "symbol"), ["filepath", "symbol"], "left_anti")
    best = every.groupBy("filepath", "symbol").agg(F.min(F.struct("priority", "ord")).alias("at"))
    return best.select("filepath", "symbol", "at.priority", "at.ord").orderBy("priority", "ord", "filepath", "symbol").limit(limit)
