"""The engine over a small repository that changes."""

from __future__ import annotations

import hashlib

import pytest

from symgraph.functions import text as tx
from symgraph.operators import context, evaluate, fusion, graph, resolve
from symgraph.plans import fixtures
from symgraph.plans.engine import Engine


def files(spark, sources):
    from pyspark.sql import functions as F

    rows = [("r", p, "python" if p.endswith(".py") else "typescript", s) for p, s in sources.items()]
    return spark.createDataFrame(rows, "repo_url string, path string, language string, content string").withColumn("sha", tx.blob_sha(F.col("content")))


def test_index_follows_a_repository(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    first = engine.index(files(spark, fixtures.PYTHON), "c1", now=1).first()
    assert first.added == len(fixtures.PYTHON) and first.status == "success"
    n = engine.symbols("r").count()
    assert n == 20 and engine.store.read("vectors", "r").count() == n
    assert engine.index(files(spark, fixtures.PYTHON), "c1", now=2).first().status == "up_to_date"
    edited = dict(fixtures.PYTHON) | {"shop/util.py": fixtures.PYTHON["shop/util.py"] + "\n\ndef extra():\n    return add(1, 2)\n"}
    second = engine.index(files(spark, edited), "c2", now=3).first()
    assert (second.modified, second.unchanged) == (1, len(edited) - 1)
    edges = lambda df: sorted(map(tuple, df.select("type", "src_file", "src_name", "dst_file", "dst_name").collect()))
    assert edges(engine.store.read("edges", "r")) == edges(resolve.link(engine.store.read("chunks", "r")))  # linked by change
    assert engine.symbols("r").count() == n + 1 and engine.store.read("vectors", "r").count() == n + 1
    new = engine.terms_index.segments().orderBy("chunks").first()
    assert {r.filepath for r in engine.terms_index.docs().where(f"segment = {new.segment}").collect()} == {"shop/util.py"}  # postings of the changed file only
    assert engine.lexical(["extra"], url="r").first().symbol == "extra"
    del edited["shop/util.py"]
    third = engine.index(files(spark, edited), "c3", now=4).first()
    assert third.deleted == 1 and not engine.find("r", "extra").take(1)
    assert engine.index(files(spark, fixtures.PYTHON), "c4", full=True, now=5).first().added == len(fixtures.PYTHON)
    assert engine.symbols("r").count() == n
    hops = {(r.qualified_name, r.hops, r.relation) for r in engine.impact("r", "Record.save").collect()}
    assert ("Order.save", 1, "overrides") in hops or ("Order.save", 1, "calls") in hops
    assert engine.impact("r", "nothing") is None
    assert engine.code_at("r", "shop/base.py", 21).first().qualified_name == "write.flush"
    assert engine.search("r", "add total hurry", limit=3).count() == 3
    assert [r.repo_url for r in engine.repositories().collect()] == ["r"]
    assert engine.delete_repository("r") and not engine.delete_repository("r")


def test_start_is_reached_through_a_cycle_only(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.hops for r in graph.reach(pairs, start, 5).collect()}
    assert got == {"b": 1, "c": 2, "a": 3, "d": 3}


def test_need_requests(spark):
    from pyspark.sql import functions as F

    replies = ["NEED: a, `b`; c.\nd", "An answer", "**NEED:** x", "NEED:", "> NEED: a, a, " + "y" * 201, None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", context.requested_items(F.col("r")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {0: ["a", "b", "c", "d"], 1: None, 2: ["x"], 3: [], 4: ["a"], 5: None}


def test_citations_get_their_status(spark):
    answers = spark.createDataFrame([("q", "See a/b.py:3, b.py:3–5, b.py:30, z.py:1, c.tsx:7, host:80 and b.py:3–5 again")], "answer_id string, answer string")
    spans = spark.createDataFrame([("a/b.py", 1, 10, True), ("c.tsx", 5, 9, False)], "filepath string, start int, end int, shown boolean")
    got = [(r.text, r.filepath, r.status) for r in context.check(context.citations(answers), spans).orderBy("ord").collect()]
    assert got == [
        ("a/b.py:3", "a/b.py", "verified"), ("b.py:3–5", "a/b.py", "verified"), ("b.py:30", "a/b.py", "wrong_line"),
        ("z.py:1", "z.py", "unknown_file"), ("c.tsx:7", "c.tsx", "graph"),
    ]


def test_fusion_prefers_agreement_and_counts_empty_lists(spark):
    rows = [(0, 1, "vector", 0.9, "a"), (0, 2, "vector", 0.8, "b"), (1, 1, "bm25", 7.0, "b")]
    lists = spark.createDataFrame(rows, "list_id int, rank int, source string, score double, symbol string").selectExpr("*", "'f' AS filepath", "1 AS start_line")
    got = fusion.reciprocal_rank_fusion(lists, 3).orderBy("rank").collect()
    assert [r.symbol for r in got] == ["b", "a"] and got[0].sources == ["vector", "bm25"]
    assert got[0].score == pytest.approx((1 / 62 + 1 / 61) / (3 / 61), abs=1e-9)


def test_abstention(spark):
    from pyspark.sql import functions as F

    texts = [("Based on the provided context, there is no cache.", True), ("There is no cache.", False), ("A. B. The context does not contain it.", False), ("", False)]
    rows = spark.createDataFrame(texts, "t string, want boolean").select("want", evaluate.abstained(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_discovery_rules(spark):
    from symgraph.sources.files import selected

    paths = ["a.py", "test_a.py", "a_test.py", "tests/a.py", "x/node_modules/b.js", "a.min.js", "a.d.ts", "a.spec.ts", "b.tsx", "c.PY", ".py", "dist", "d/e.mjs"]
    got = {r.path: r.language for r in selected(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"a.py": "python", "b.tsx": "typescript", "d/e.mjs": "javascript"}


def test_streamed_snapshots(spark, tmp_path):
    from pyspark.sql import functions as F

    from symgraph.streaming.ingest import stream_index

    engine = Engine(spark, str(tmp_path / "store"))
    columns = ["repo_url", "snapshot", "n_files", "path", "language", "sha", "content"]

    def put(name, sources, snapshot, n):
        rows = files(spark, sources).withColumn("snapshot", F.lit(snapshot)).withColumn("n_files", F.lit(n).cast("bigint"))
        rows.select(*columns).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream_index(spark, str(tmp_path / "in" / "*"), engine, str(tmp_path / "state")).awaitTermination(120)

    every = list(fixtures.SCRIPT.items())
    put("a", dict(every[:1]), "1", len(every))
    assert engine.symbols("r").count() == 0  # the rest has not arrived
    put("b", dict(every[1:]), "1", len(every))
    assert engine.symbols("r").count() == 14
    put("c", dict(every[:1]), "2", len(every))
    assert engine.symbols("r").count() == 14 and engine.store.read("file_state", "r").count() == len(every)
    put("d", dict(every[:1]), "0", 1)
    assert engine.symbols("r").count() == 14  # older than what is indexed
    put("e", dict(every[:1]), "3", 1)
    assert engine.store.read("file_state", "r").count() == 1


def test_files_of_two_repositories_are_refused(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = files(spark, fixtures.SCRIPT)
    with pytest.raises(ValueError, match="more than one"):
        Engine(spark, str(tmp_path / "store")).index(rows.unionByName(rows.withColumn("repo_url", F.lit("other"))))


def test_backup_and_restore(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(files(spark, fixtures.PYTHON), "c1", now=1)
    before = {name: engine.store.read(name).count() for name in ("chunks", "edges", "repositories", "embedding_cache")}
    found = sorted(map(tuple, engine.lexical(["add", "total"], url="r").collect()))
    docs = engine.terms_index.docs().count()
    assert min(before.values()) > 0 and engine.store.backup(str(tmp_path / "copies"), "2024-01-01") == ["2024-01-01"]
    engine.delete_repository("r")
    assert engine.lexical(["add", "total"]).count() == 0
    assert engine.store.restore(str(tmp_path / "copies")) == "2024-01-01"
    assert {name: engine.store.read(name).count() for name in before} == before
    assert sorted(map(tuple, engine.lexical(["add", "total"], url="r").collect())) == found != [] and engine.terms_index.docs().count() == docs
    assert engine.search("r", "add total hurry", limit=3).count() == 3
    with pytest.raises(ValueError, match="no such copy"):
        engine.store.restore(str(tmp_path / "copies"), "2023-01-01")


def test_searches_read_their_terms_alone(spark, sf_dir):
    from symgraph.plans.catalogue import _bm25
    from symgraph.plans.views import Views

    plan = _bm25(Views(spark, sf_dir), ["idiot", "von"])._jdf.queryExecution().executedPlan().toString()
    assert "code_text" not in plan.replace("code_text,", "") or "documents" not in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "In(term" in plan or "term IN" in plan


def test_read_repository(spark, tmp_path):
    from symgraph.sources.files import read_repository

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "bad.py").write_bytes(b"\xff\xfe")
    got = {r.path: (r.sha, r.error) for r in read_repository(spark, str(tmp_path), "r").collect()}
    assert got["pkg/a.py"] == (hashlib.sha1(b"blob 6\0x = 1\n").hexdigest(), None)
    assert got["pkg/bad.py"][1] == "not UTF-8"


def test_sweep_deletes_what_was_written(spark):
    from symgraph.session import materialize, sweep

    sweep(spark)
    path = materialize(spark.range(3), "swept").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(path) and sweep(spark) == 1 and not os.path.isdir(path)
