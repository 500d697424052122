"""The engine's tables as Parquet, a partition a repository.

Parquet has no merge: the next version of a partition is computed, written to the shared folder, and put in place of the old
one. A reader sees a repository's tables one after another, as they are replaced; the file state comes last, so a
run that ends early is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators.segments import SegmentedIndex
from symgraph.schemas import CHUNK, EDGE, FILE_STATE
from symgraph.session import materialize

SCHEMAS = {
    "chunks": "repo_url string, " + CHUNK,
    "vectors": "repo_url string, filepath string, symbol string, start_line int, vector array<float>",
    "edges": EDGE,
    "file_state": FILE_STATE,
    "repositories": "repo_url string, created_at bigint, last_indexed bigint, commit string, index_version int",
    "embedding_cache": "model string, key string, vector array<float>, created_at bigint",
}
#: What each table is partitioned by, if not by repository, and how rows are sorted within a file.
PARTITION = {"embedding_cache": ["model"]}
SORTED = {"chunks": ["file_path"], "vectors": ["filepath"]}


class Store:
    """Tables below a folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str, repo_url: str | None = None) -> DataFrame:
        """A table, or one repository's part of it; empty if it was never written. The filter prunes partitions."""
        path, fs = self._path(name)
        schema = SCHEMAS[name]
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(str(path))
        return rows if repo_url is None else rows.where(F.col("repo_url") == repo_url)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put ``rows`` in place of the partitions that they belong to."""
        fields = [c.strip().split(" ")[0] for c in SCHEMAS[name].replace("array<string>", "x").split(",")]
        staged = materialize(rows.select(*fields), f"stage-{name}")
        part = PARTITION.get(name, ["repo_url"])
        spread = [F.pmod(F.xxhash64(*[c for c in fields if c not in part][:3]), F.lit(64))]
        dealt = staged.repartition(*part, *spread).sortWithinPartitions(*part, *SORTED.get(name, []))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(f"{self.root}/{name}")

    def drop(self, name: str, repo_url: str) -> bool:
        """Remove a repository's partition; false if there was none."""
        path, fs = self._path(name)
        if not fs.exists(path):
            return False
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo_url)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"repo_url={escaped}")
        return bool(fs.exists(target) and fs.delete(target, True))

    def delete_repository(self, repo_url: str) -> bool:
        """Remove a repository from all tables; false if it was not indexed."""
        return any([self.drop(name, repo_url) for name in ("chunks", "vectors", "edges", "file_state", "repositories")])

    def points(self, refs: DataFrame) -> DataFrame:
        """The chunks of listed places (ord, repo_url, filepath, symbol, start_line), in their order; unknown ones are left out."""
        c = self.read("chunks")
        keyed = c.withColumnRenamed("file_path", "filepath").withColumnRenamed("qualified_name", "symbol")
        return refs.join(keyed, ["repo_url", "filepath", "symbol", "start_line"]).orderBy("ord")

    def backup(self, to: str, stamp: str, keep: int = 7) -> list[str]:
        """Copy all tables to ``to/stamp`` and keep the newest ``keep`` copies; returns the copies there are."""
        for name in SCHEMAS:
            path, fs = self._path(name)
            if fs.exists(path):
                self.spark.read.parquet(str(path)).write.mode("overwrite").parquet(f"{to}/{stamp}/{name}")
        SegmentedIndex(self.spark, f"{self.root}/lexical").copy_to(SegmentedIndex(self.spark, f"{to}/{stamp}/lexical"))
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(to)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        for old in there[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, old), True)
        return there[-keep:]

    def restore(self, source: str, stamp: str | None = None) -> str:
        """Put all tables back as the copy ``stamp`` (the newest) below ``source`` has them; returns the stamp. Tables that the copy lacks go."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(source)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        if not there or stamp not in (None, *there):
            raise ValueError(f"no such copy below {source}: {stamp}")
        stamp = stamp or there[-1]
        for name in SCHEMAS:
            path, own = self._path(name)
            copy = self.spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{stamp}/{name}")
            if own.exists(path):
                own.delete(path, True)
            if fs.exists(copy):
                rows = self.spark.read.schema(SCHEMAS[name]).parquet(str(copy))
                rows.write.partitionBy(*PARTITION.get(name, ["repo_url"])).parquet(f"{self.root}/{name}")
        SegmentedIndex(self.spark, f"{source}/{stamp}/lexical").copy_to(SegmentedIndex(self.spark, f"{self.root}/lexical"))
        return stamp
