"""Files of a repository: discovery, languages, hashes, text."""

from __future__ import annotations

import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import blob_sha

#: Extensions by language, folders that hold no source of a project's own, names that are skipped.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
}
SKIP_DIRS = [".git", ".venv", "venv", "node_modules", "dist", "build", "out", "coverage", "vendor", "tests", "test", "__tests__", "__pycache__"]
SKIP_ENDS = (".min.js", ".d.ts", ".bundle.js")
SKIP_PARTS = (".test.", ".spec.")


def language_of(path: Column) -> Column:
    """The language of a path by its extension (case counts); null if there is none or the file is skipped."""
    file = F.substring_index(path, "/", -1)
    by_extension = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.regexp_extract(file, r"^.+\.([^.]+)$", 1)]
    tests = (by_extension == "python") & (F.startswith(file, F.lit("test_")) | F.endswith(file, F.lit("_test.py")))
    made = F.lit(False)
    for end in SKIP_ENDS:
        made = made | F.endswith(file, F.lit(end))
    for part in SKIP_PARTS:
        made = made | F.contains(file, F.lit(part))
    return F.when(~tests & ~((by_extension != "python") & made), by_extension)


def in_skipped_folder(path: Column) -> Column:
    """Whether a folder above the file is one that is skipped."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS)))


def selected(files: DataFrame) -> DataFrame:
    """Files (path, ...) of a known language outside skipped folders, with ``language``."""
    return files.withColumn("language", F.when(~in_skipped_folder(F.col("path")), language_of(F.col("path")))).where("language IS NOT NULL")


def read_repository(spark: SparkSession, root: str, repo_url: str) -> DataFrame:
    """repo_url, path, language, sha, content, error of a checked-out repository.

    Content that is no UTF-8 gives no text but an error, and the file counts as failed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    found = selected(raw.select(path.alias("path"), "content"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return found.select(
        F.lit(repo_url).alias("repo_url"), "path", "language", blob_sha(F.col("content")).alias("sha"), text.alias("content"), F.when(text.isNull(), F.lit("not UTF-8")).alias("error")
    )


def clone(url: str, into: str, timeout: int = 300) -> str:
    """Clone the last commit of a repository; returns its hash."""
    subprocess.run(["git", "clone", "--depth", "1", url, into], check=True, timeout=timeout, capture_output=True)
    return commit_of(into)


def commit_of(root: str) -> str:
    """The hash of the checked-out commit."""
    return subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, check=True, capture_output=True, text=True).stdout.strip()


def blob_shas(root: str) -> dict[str, str]:
    """path -> hash of every tracked file."""
    listed = subprocess.run(["git", "ls-files", "-s", "-z"], cwd=root, check=True, capture_output=True, text=True).stdout
    return {path: meta.split()[1] for meta, _, path in (line.partition("\t") for line in listed.split("\0") if line)}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions of a TOML file: id, kind, question, gold, mention, answerable; checked as they are read."""
    cases = tomllib.loads(Path(path).read_text())["cases"]
    ids = [c["id"] for c in cases]
    if len(set(ids)) < len(ids):
        raise ValueError(f"{path}: an id occurs twice")
    rows = []
    for c in cases:
        gold = [(g, None) if isinstance(g, str) else (g["name"], g.get("filepath")) for g in c.get("gold", [])]
        answerable = bool(c.get("answerable", True))
        if answerable != bool(gold):
            raise ValueError(f"{path}: case {c['id']} needs gold exactly if it is answerable")
        rows.append((c["id"], c["kind"], c["question"], gold, [list(m) for m in c.get("mention", [])], answerable))
    return spark.createDataFrame(rows, "id string, kind string, question string, gold array<struct<name:string,filepath:string>>, mention array<array<string>>, answerable boolean")


def append_new(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append to a folder of JSON lines the rows whose key it does not have; returns those appended."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = rows.join(spark.read.schema(rows.schema).json(path).select(key), key, "left_anti") if there else rows
    fresh.write.mode("append").json(path)
    return fresh
