"""Relational parts of the explorer: file trees, districts, counts, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_repositories(local: DataFrame, server: DataFrame) -> DataFrame:
    """url, last_indexed, symbols, state: known repositories brought up to date, and those only the server has."""
    a = local.select("url", "state")
    b = server.select("url", "last_indexed", "symbols")
    return a.join(b, "url", "full").select("url", "last_indexed", "symbols", F.coalesce("state", F.lit("indexed")).alias("state"))


def tree_counts(files: DataFrame) -> DataFrame:
    """prefix, depth, symbols for every folder and file (files: path, symbols)."""
    parts = F.split("path", "/")
    prefixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    rows = files.select(F.explode(prefixes).alias("prefix"), "symbols")
    return rows.groupBy("prefix").agg(F.sum("symbols").cast("long").alias("symbols")).withColumn("depth", F.size(F.split("prefix", "/")))


def height(lines: Column) -> Column:
    """The height of a building of so many lines."""
    return F.least(0.35 + 0.42 * F.sqrt(lines), F.lit(9.0))


def districts(buildings: DataFrame, most: int = 8) -> DataFrame:
    """district, symbols and the centre weighted by them, of the largest districts (buildings: district, x, y, symbols)."""
    centre = lambda c: F.round(F.sum(F.col(c) * F.col("symbols")) / F.sum("symbols"), 6).alias(c)
    return buildings.groupBy("district").agg(F.sum("symbols").cast("long").alias("symbols"), centre("x"), centre("y")).orderBy(F.desc("symbols"), "district").limit(most)


def kind_counts(symbols: DataFrame) -> DataFrame:
    """type, n."""
    return symbols.groupBy("type").agg(F.count("*").alias("n"))


def select_symbols(symbols: DataFrame, path: str | None = None, name: str | None = None) -> DataFrame:
    """Symbols of a file or folder whose name contains a string."""
    out = symbols
    if path:
        out = out.where((F.col("filepath") == path) | F.startswith("filepath", F.lit(path.rstrip("/") + "/")))
    return out.where(F.contains(F.lower("name"), F.lit(name.lower()))) if name else out


def rank_change(hits: DataFrame) -> DataFrame:
    """How far a reranker moved each hit (up is positive)."""
    return hits.withColumn("rank_change", F.col("retrieval_rank") - F.col("rank"))


def hop_map(targets: DataFrame, affected: DataFrame) -> DataFrame:
    """node, hops: targets at 0, then the affected symbols."""
    return targets.select("node", F.lit(0).alias("hops")).unionByName(affected.select("node", "hops")).groupBy("node").agg(F.min("hops").alias("hops"))
