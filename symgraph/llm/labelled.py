"""Bounded, reproducible samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: dict[int, int], seed: int) -> DataFrame:
    """doc_id, text, label of at most ``most[l]`` usable documents of each label l, those whose hashed ids are smallest.

    Only the ids of the sample, a number fixed by ``most``, are sent to every task. A doc_id that ``labels`` has twice is used
    with its larger label; of rows that share a doc_id one is used, that of the smallest hash of the text; null ids and labels are not used.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    parts = [one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n) for value, n in most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
