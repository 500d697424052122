"""What a session needs: workers that can import this package, and a folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_code(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path; on a cluster ship it with ``--py-files``, this then changes nothing."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``); a temporary one where none is set and all run on this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("symgraph.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="symgraph-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("symgraph.shared.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: what reads the result never recomputes what made it, and the files outlive any executor. They
    stay until ``sweep``, as a result that is not yet read may need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # zstd sets up so much a file and column that many small files take longer to open than to fill
    writer = df.write.option("compression", "snappy" if partition else "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder, once no result that reads it is needed; returns how many tables."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
