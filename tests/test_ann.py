"""The ANN index: recall, exact searches by bounds, what is read, odd vectors, staleness."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.operators import ann, vector
from symgraph.plans import catalogue, indexes
from symgraph.plans.views import Views

POINTS = "repo_url string, filepath string, symbol string, start_line int, vector array<float>"


def hits(df):
    return sorted((r.query_id, r["rank"], r.filepath, r.symbol, r.score) for r in df.collect())


def same(a, b):
    """The share of hits of ``b`` that are in ``a``, at any rank."""
    cut = lambda rows: {(q, *rest) for q, _, *rest in rows}
    return len(cut(a) & cut(b)) / len(cut(b))


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Sixty tight groups of points, one of them a third of all rows and mostly one vector; and an index of them."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(60, 20))
    own = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 60, 3000))
    x = middle[own] + 0.15 * rng.normal(size=(3000, 20))
    x[:600] = middle[0]
    rows = [(f"r{i % 3}", f"f{i // 10}", f"s{i}", i % 7, v.astype(float).tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 20, [float("nan")] * 20, [None] * 20, [1.0] * 19, [float("inf")] + [0.0] * 19, [1e38] * 20]
    rows += [("r0", "odd", f"o{i}", 1, v) for i, v in enumerate(odd)] + [rows[5], rows[5]]
    points = spark.createDataFrame(rows, POINTS).repartition(6)
    path = str(tmp_path_factory.mktemp("ann"))
    sizes = ann.build(points, path)
    assert sizes.agg(F.sum("rows")).first()[0] == 3000 + 1 + 2  # of the odd ones the last can be pointed at
    asked = spark.createDataFrame([(i, x[i * 37].tolist()) for i in range(40)] + [(99, [0.0] * 20), (98, None)], "query_id int, vector array<double>")
    return points.where("symbol NOT LIKE 'o%' OR symbol = 'o7'"), path, asked


def test_few_probes_find_what_lies_in_clusters(spark, clustered):
    points, path, asked = clustered
    exact, found = hits(vector.search(points, asked.where("query_id < 90"))), hits(ann.search(spark, path, asked))
    model = ann.read_model(spark, path)
    assert model.probes(ann.RECALL) <= len(model.centers) // 4
    assert same(found, exact) >= 0.95
    assert hits(ann.search(spark, path, asked, certain=True)) == exact


def test_filters_thresholds_and_blocks_of_queries(spark, clustered, monkeypatch):
    points, path, asked = clustered
    real = asked.where("query_id < 90")
    exact = hits(vector.search(points, real, repo_url="r1", limit=5, threshold=0.4))
    monkeypatch.setattr(ann, "ASKED", 16)
    assert hits(ann.search(spark, path, asked, repo_url="r1", limit=5, threshold=0.4, certain=True)) == exact
    assert same(hits(ann.search(spark, path, asked, repo_url="r1", limit=5, threshold=0.4)), exact) >= 0.95
    assert ann.search(spark, path, asked, repo_url="none").count() == 0 == ann.search(spark, path, asked.limit(0)).count()


def test_only_probed_cells_are_read(spark, clustered):
    _, path, asked = clustered
    found = ann.search(spark, path, asked.where("query_id = 3"), probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([\d,]+)\)", plan)
    assert len(read) == 1 and len(read[0].split(",")) == 2
    cells = spark.read.parquet(f"{path}/points").groupBy("cell").count()
    assert cells.count() > 20
    hit = spark.read.parquet(f"{path}/points").join(found, ["filepath", "symbol", "start_line"]).select("cell").distinct().collect()
    assert {str(r.cell) for r in hit} <= set(read[0].split(","))


def test_cells_of_many_rows_are_many_files(spark, tmp_path, monkeypatch, clustered):
    points, _, asked = clustered
    monkeypatch.setattr(ann, "FILE_ROWS", 100)
    ann.build(points, str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a/points")).groupBy(F.input_file_name().alias("f")).count()
    assert rows.agg(F.max("count")).first()[0] <= 3 * 700  # copies of one vector differ in their key and spread
    assert rows.count() > 30


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    ann.build(spark.createDataFrame([], POINTS), str(tmp_path / "a"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>")
    assert ann.search(spark, str(tmp_path / "a"), asked).count() == 0 == ann.search(spark, str(tmp_path / "a"), asked, certain=True).count()


def test_the_registered_query_finds_most(spark, sf_dir):
    v = Views(spark, sf_dir)
    asked = v.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.filepath) for r in vector.search(v.points(), asked).collect()}
    found = {(r.query_id, r.filepath) for r in catalogue.queries()["vector_index_topk"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.95 * len(exact)


def test_an_index_is_found_again_until_a_file_changes(spark, tmp_path):
    built, path = [], str(tmp_path / "t")
    spark.range(3).write.parquet(path)

    def at():
        return indexes.kept(spark, "test", [spark.read.parquet(path)], lambda p: (built.append(p), spark.range(1).write.parquet(f"{p}/end")), "end")

    first = at()
    assert at() == first and built == [first]
    spark.range(4).write.mode("append").parquet(path)
    assert at() != first and len(built) == 2


def test_queries_meet_codes_as_matrices_where_these_are_read(spark, clustered):
    """They once met in a join, a row a query and code; now a task hands on the rows that may be among its best."""
    points, path, asked = clustered
    found = ann.search(spark, path, asked, probes=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan[: plan.index("PartitionFilters")] and plan.count("Join") == 1
    assert hits(found) == hits(vector.search(points, asked.where("query_id < 90")))
