"""Incremental maintenance: what changed between two versions of a repository, and tables that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.schemas import INDEX_VERSION


def plan_changes(current: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """path, change: added, modified, deleted or unchanged (both sides: path, sha). A missing stored hash counts as modified.

    A full rebuild adds every current path, and deletes what is no longer there.
    """
    now = current.select("path", F.col("sha").alias("sha_now"), F.lit(True).alias("is_now"))
    then = stored.select("path", F.coalesce("sha", F.lit("")).alias("sha_then"), F.lit(True).alias("is_then"))
    both = now.join(then, "path", "full")
    change = (
        F.when(F.col("is_now").isNull(), "deleted")
        .when(F.lit(full) | F.col("is_then").isNull(), "added")
        .when(F.col("sha_now") == F.col("sha_then"), "unchanged")
        .otherwise("modified")
    )
    return both.select("path", change.alias("change"))


def needs_full(state: DataFrame | None, version: int | None, full: bool = False) -> bool:
    """Whether stored tables cannot be trusted: none, of another version, or without file hashes."""
    return full or state is None or version != INDEX_VERSION or not state.take(1)


def up_to_date(current: DataFrame, stored: DataFrame, same_commit: bool = True) -> DataFrame:
    """One row: ``differing`` paths and whether nothing needs doing."""
    left = current.select("path", "sha").exceptAll(stored.select("path", "sha"))
    right = stored.select("path", "sha").exceptAll(current.select("path", "sha"))
    return left.unionAll(right).agg(F.countDistinct("path").alias("differing")).withColumn("up_to_date", F.lit(same_commit) & (F.col("differing") == 0))


def delete_files(rows: DataFrame, paths: DataFrame, path: str = "filepath") -> DataFrame:
    """``rows`` without those of the listed paths (column ``path``)."""
    return rows.join(paths.select(F.col("path").alias(path)), path, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not fresh, and the fresh rows."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def replaced(stored: DataFrame, fresh: DataFrame, failed: DataFrame, changes: DataFrame, path: str = "filepath") -> DataFrame:
    """The next version of a table: rows of changed or deleted files go, unless the file failed, and fresh rows come."""
    gone = changes.where(F.col("change").isin("modified", "deleted", "added")).join(failed, "path", "left_anti")
    return delete_files(stored, gone, path).unionByName(fresh.join(failed.withColumnRenamed("path", path), path, "left_anti"))


def summary(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: counts by change, failures and the status."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    out = changes.agg(*map(count, ("added", "modified", "deleted", "unchanged")))
    return out.withColumn("failed", failed.agg(F.count("*")).scalar()).withColumn("status", F.when(F.col("failed") > 0, "partial_success").otherwise("success"))
