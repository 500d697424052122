"""Asking with stand-ins for the models."""

from __future__ import annotations

import pytest
from test_engine import files

from symgraph.plans import fixtures
from symgraph.plans.ask import VARIANTS, Asker, Plan, city, evaluate_retrieval
from symgraph.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("ask") / "store"))
    e.index(files(spark, fixtures.PYTHON), "c1")
    return e


def planner(question, history):
    return Plan("impact", "simple", ["hurry"], ["add total", "ADD total"])


def test_an_answer_is_checked_and_may_ask_once(engine):
    prompts = []

    def generator(prompt):
        prompts.append(prompt)
        return "NEED: Rush, nothing" if len(prompts) == 1 else "See util.py:16 and shop/none.py:3 and base.py:999."

    answer = Asker(engine, "r", planner, generator).ask("what does hurry call?")
    assert answer.status == "ok" and answer.followups == [["Rush", "nothing"]] and len(prompts) == 2
    assert "class Rush" in prompts[1] and "Question: what does hurry call?" in prompts[1]
    got = [r.status for r in answer.citations.orderBy("ord").collect()]
    assert got[0] == "verified" and got[1] == "unknown_file" and got[2] in ("wrong_line", "unknown_file")


def test_failures_degrade(engine):
    def broken(*_):
        raise RuntimeError("no quota")

    answer = Asker(engine, "r", broken, broken).ask("total add")
    assert answer.status == "degraded" and answer.notes == ["planner: no quota", "generator: no quota"] and "- `" in answer.text


def test_variants_are_compared(engine, spark):
    cases = spark.createDataFrame(
        [("a", "lookup", "add total", [("add", None)], [["x"]], True)],
        "id string, kind string, question string, gold array<struct<name:string,filepath:string>>, mention array<array<string>>, answerable boolean",
    )
    some = {k: VARIANTS[k] for k in ("full", "no_rerank")}
    got = {(r.variant, r.stage): r.recall for r in evaluate_retrieval(engine, "r", cases, planner, some).collect()}
    assert set(got) == {(v, s) for v in some for s in ("candidates", "kept", "context")} and got["full", "candidates"] == 1.0


def test_city(spark):
    rows = spark.createDataFrame([("a/x", 100, 3), ("a/y", 4, 1), ("b/z", 10_000, 9)], "filepath string, lines int, symbols int")
    got = {r.filepath: (r.height, r.x, r.y) for r in city(rows).collect()}
    assert got["b/z"][0] == 9.0 and got["a/x"][1:] == (0, 0) and got["a/y"][1:] == (1, 0)
