"""Continuous indexing: new versions of files arrive as Parquet, each complete snapshot is one incremental run a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from symgraph.plans.engine import Engine

#: ``snapshot`` names a version of a repository, later ones by greater names; ``n_files`` is how many files it has.
FILES = "repo_url string, snapshot string, n_files bigint, path string, language string, sha string, content string"
_KEY = ["repo_url", "snapshot"]


def complete(files: DataFrame) -> DataFrame:
    """repo_url, snapshot of the newest snapshot of each repository all of whose files have arrived."""
    seen = files.groupBy(*_KEY).agg(F.count_distinct("path").alias("there"), F.max("n_files").alias("n_files")).where("there >= n_files")
    return seen.groupBy("repo_url").agg(F.max("snapshot").alias("snapshot"))


def stream_index(spark: SparkSession, source: str, engine: Engine, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follow a folder of snapshots and keep the engine's tables up to date.

    A file that a snapshot lacks counts as deleted, so a snapshot is indexed only once all its files are there: files of one that is
    split over micro-batches wait in a table of their own beside the engine's. Of a path that a snapshot has twice, the version
    of the greatest hash counts. An older snapshot than the last one indexed is dropped; a batch that is run again finds nothing changed.
    """
    waiting = f"{engine.store.root}/waiting"

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{waiting}/batch={number}")
        every = spark.read.schema(FILES).parquet(waiting)
        # a row a repository that has a complete snapshot
        for key in sorted(complete(every).join(batch.select("repo_url").distinct(), "repo_url", "left_semi").collect()):
            files = every.where((F.col("repo_url") == key.repo_url) & (F.col("snapshot") == key.snapshot))
            known = engine.store.read("repositories", key.repo_url).first()
            if known is not None and known.commit is not None and known.commit > key.snapshot:
                continue
            one = files.groupBy("path").agg(F.max_by(F.struct("repo_url", "language", "sha", "content"), "sha").alias("f")).select("path", "f.*")
            engine.index(one, key.snapshot)

    writer = spark.readStream.schema(FILES).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
