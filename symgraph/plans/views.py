"""Adapter views: the driver's tables in the roles of the engine's. ``SQL`` defines the same views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import blob_sha


class Views:
    """Views over one data folder; each is built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self) -> DataFrame:
        """Documents as symbol chunks."""
        text = F.coalesce("text", F.lit(""))
        return self.table("documents").select(
            "doc_id", F.col("source").alias("repo_url"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("filepath"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("symbol"), F.col("lang").alias("chunk_type"), F.lit(1).alias("start_line"),
            (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("end_line"), text.alias("code_text"),
        )

    def points(self) -> DataFrame:
        """Vectors with their chunk's place."""
        e = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        return e.join(self.chunks().drop("code_text"), "doc_id")

    def query_vectors(self, *ids: int) -> DataFrame:
        """query_id, vector of a few vectors."""
        return self.table("embeddings").where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def calls(self) -> DataFrame:
        """type, src, dst: all orders as calls between customers."""
        n = self.table("customer").agg(F.count("*")).scalar()
        pairs = self.table("orders").select(F.col("o_custkey").alias("a"), F.pmod(F.col("o_orderkey"), n).alias("b")).where("a <> b").distinct()
        return pairs.select(F.lit("CALLS").alias("type"), F.concat(F.lit("f"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("f"), F.col("b").cast("string")).alias("dst"))

    def inherits(self) -> DataFrame:
        """Suppliers as a hierarchy of classes: s inherits from floor(s / 2)."""
        key = F.col("s_suppkey")
        rows = self.table("supplier").where(key >= 2)
        return rows.select(F.lit("INHERITS").alias("type"), F.concat(F.lit("c"), key.cast("string")).alias("src"), F.concat(F.lit("c"), F.floor(key / 2).cast("string")).alias("dst"))

    def methods(self) -> DataFrame:
        """Parts as methods: node, owner (a class node), name, qualified_name, filepath, start_line, end_line."""
        n = self.table("supplier").agg(F.count("*")).scalar()
        key, owner = F.col("p_partkey"), F.pmod(F.col("p_partkey"), n) + 1
        line = (owner * 100 + 2 + F.pmod(F.floor(key / n), F.lit(90))).cast("int")
        return self.table("part").select(
            F.concat(F.lit("m"), key.cast("string")).alias("node"), F.concat(F.lit("c"), owner.cast("string")).alias("owner"), F.col("p_brand").alias("name"),
            F.concat(F.lit("Class_"), owner.cast("string"), F.lit("."), F.col("p_brand"), F.lit("#"), key.cast("string")).alias("qualified_name"),
            F.concat(F.lit("cls_"), owner.cast("string"), F.lit(".py")).alias("filepath"), line.alias("start_line"), (line + 1).alias("end_line"),
        )

    def has_method(self) -> DataFrame:
        """Methods of classes that exist."""
        classes = self.table("supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("owner"))
        return self.methods().join(classes, "owner").select(F.lit("HAS_METHOD").alias("type"), F.col("owner").alias("src"), F.col("node").alias("dst"))

    def symbols(self) -> DataFrame:
        """node, filepath, qualified_name, name, type, start_line, end_line: functions, classes and methods."""
        c, s = F.col("c_custkey"), F.col("s_suppkey")
        text = lambda p, k, q="": F.concat(F.lit(p), k.cast("string"), F.lit(q))
        functions = self.table("customer").select(
            text("f", c).alias("node"), text("mod_", F.col("c_nationkey"), ".py").alias("filepath"), text("fn_", c).alias("qualified_name"), text("fn_", c).alias("name"),
            F.lit("function").alias("type"), (c * 10 + 1).cast("int").alias("start_line"), (c * 10 + 8).cast("int").alias("end_line"),
        )
        classes = self.table("supplier").select(
            text("c", s).alias("node"), text("cls_", s, ".py").alias("filepath"), text("Class_", s).alias("qualified_name"), text("Class_", s).alias("name"),
            F.lit("class").alias("type"), (s * 100 + 1).cast("int").alias("start_line"), (s * 100 + 99).cast("int").alias("end_line"),
        )
        methods = self.methods().select("node", "filepath", "qualified_name", "name", F.lit("method").alias("type"), "start_line", "end_line")
        return functions.unionByName(classes).unionByName(methods)

    def edges(self) -> DataFrame:
        """All edges."""
        return self.calls().unionByName(self.inherits()).unionByName(self.has_method())

    def file_state(self) -> tuple[DataFrame, DataFrame]:
        """Current and stored (path, sha) of documents."""
        path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
        text = F.coalesce("text", F.lit(""))
        docs = self.table("documents")
        now = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(" changed"))).otherwise(text)
        return docs.where(F.col("doc_id") % 11 != 0).select(path, blob_sha(now).alias("sha")), docs.where(F.col("doc_id") % 10 != 0).select(path, blob_sha(text).alias("sha"))

    def paths(self) -> DataFrame:
        """path, symbols: pages as files below their host."""
        cut = F.regexp_extract("url", r"://([^?#]*)", 1)
        return self.table("pages").select(F.rtrim(cut, F.lit("/")).alias("path"), F.lit(1).alias("symbols"))


#: The views in DuckDB SQL, as a list of common table expressions.
SQL = r"""
chunks_v AS (SELECT doc_id, source AS repo_url, lang || '/' || doc_id AS filepath, 'doc_' || doc_id AS symbol, lang AS chunk_type, 1 AS start_line,
  length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS end_line, coalesce(text, '') AS code_text FROM documents),
points_v AS (SELECT c.* EXCLUDE (code_text), e.embedding AS vector FROM embeddings e JOIN chunks_v c ON e.vec_id = c.doc_id),
calls_v AS (SELECT DISTINCT 'CALLS' AS type, 'f' || o_custkey AS src, 'f' || (o_orderkey % (SELECT count(*) FROM customer)) AS dst
  FROM orders WHERE o_custkey <> o_orderkey % (SELECT count(*) FROM customer)),
inherits_v AS (SELECT 'INHERITS' AS type, 'c' || s_suppkey AS src, 'c' || (s_suppkey // 2) AS dst FROM supplier WHERE s_suppkey >= 2),
methods_v AS (SELECT 'm' || p_partkey AS node, 'c' || own AS owner, p_brand AS name, 'Class_' || own || '.' || p_brand || '#' || p_partkey AS qualified_name,
  'cls_' || own || '.py' AS filepath, (own * 100 + 2 + (p_partkey // n) % 90)::INT AS start_line, (own * 100 + 3 + (p_partkey // n) % 90)::INT AS end_line
  FROM (SELECT *, p_partkey % n + 1 AS own FROM part, (SELECT count(*) AS n FROM supplier))),
has_method_v AS (SELECT 'HAS_METHOD' AS type, owner AS src, node AS dst FROM methods_v WHERE owner IN (SELECT 'c' || s_suppkey FROM supplier)),
symbols_v AS (
  SELECT 'f' || c_custkey AS node, 'mod_' || c_nationkey || '.py' AS filepath, 'fn_' || c_custkey AS qualified_name, 'fn_' || c_custkey AS name, 'function' AS type,
    (c_custkey * 10 + 1)::INT AS start_line, (c_custkey * 10 + 8)::INT AS end_line FROM customer
  UNION ALL SELECT 'c' || s_suppkey, 'cls_' || s_suppkey || '.py', 'Class_' || s_suppkey, 'Class_' || s_suppkey, 'class', (s_suppkey * 100 + 1)::INT, (s_suppkey * 100 + 99)::INT FROM supplier
  UNION ALL SELECT node, filepath, qualified_name, name, 'method', start_line, end_line FROM methods_v),
edges_v AS (SELECT * FROM calls_v UNION ALL SELECT * FROM inherits_v UNION ALL SELECT * FROM has_method_v),
current_v AS (SELECT lang || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' changed' ELSE coalesce(text, '') END AS body FROM documents WHERE doc_id % 11 <> 0),
stored_v AS (SELECT lang || '/' || doc_id AS path, coalesce(text, '') AS body FROM documents WHERE doc_id % 10 <> 0)
"""
