"""Indexes over tables that others write: built once, found again by what they were built of, built anew when that changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.session import shared_dir


def stamp(*tables: DataFrame) -> str:
    """What the files of tables are: paths, sizes and times of change, as one short text; any file that is added, rewritten or removed changes it."""
    parts = []
    for table in tables:
        file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")
        parts.append(table.select(file).distinct().agg(F.coalesce(F.bit_xor("h"), F.lit(0))).first()[0])
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table that was written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def kept(spark: SparkSession, name: str, tables: list[DataFrame], build: Callable[[str], object], last: str) -> str:
    """The folder of the index ``name`` of these tables as they are now; ``build`` fills it where it does not hold ``last``, the table that is written last."""
    path = f"{shared_dir(spark)}/index-{name}-{stamp(*tables)}"
    if not exists(spark, f"{path}/{last}"):
        build(path)
    return path
