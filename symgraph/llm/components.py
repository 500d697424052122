"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round aggregates before it shuffles and is written to the shared folder, so lineage stays short and a lost
executor costs one round at most. A node with many links is one key with one minimum; the join that hands it out has a
unique side, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _downward(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open(links: DataFrame) -> bool:
    """Whether some node has two links down, or one down and one up: not each root is linked to all its nodes directly yet."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b) but the roots themselves; root: the smallest node reachable.

    Null ends and links of a node to itself are ignored; repeated links count once; no links give no rows.
    """
    links = materialize(_downward(links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")), "links")
    while _open(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _downward(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
        small = large.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
        links = materialize(_downward(small), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
