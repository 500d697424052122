"""What the training-data operators share: tables, the shared folder, texts, the rows that learning leaves out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.session import materialize, shared_dir, sweep

__all__ = ["SPACE", "WORD", "held_out", "majority", "materialize", "shared_dir", "sweep", "table", "text_of"]

#: White space as the query contracts define it: space and the six ASCII controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder; the path may belong to any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(n: int, remainder: int) -> Column:
    """Whether crc32 of the decimal doc_id leaves ``remainder`` when divided by ``n`` (a null id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == remainder, F.lit(False))


#: Hashes whose bits are counted at a time: bounds memory for any length of text.
_STEP = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes, as a number."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at : at + _STEP], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])
