"""Postings: the counts of a plain loop, made where chunks are read."""

from __future__ import annotations

import re
from collections import Counter

from symgraph.operators import lexical
from symgraph.plans import catalogue

CHUNKS = "repo_url string, filepath string, symbol string, start_line int, code_text string"
ROWS = [("r", "a/b.py", "Add_b", 1, "add Add b 1x é_y py\nb"), ("r", "b", "b", 2, None), ("r", "", "", 3, ""), ("r", None, None, 4, "K kin x9 X9")]


def test_postings_are_counted_without_a_shuffle(spark):
    """Texts end before terms are exploded: lengths once stood beside the explosion, and took the text apart once a token."""
    found = lexical.indexed(spark.createDataFrame(ROWS, CHUNKS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    exploded = plan[: plan.rindex("Generate explode")]
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert "regexp" not in exploded and "code_text#" not in exploded
    want = set()
    for _, path, symbol, line, text in ROWS:
        words = {f: [t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", x or "")] for f, x in (("filepath", path), ("symbol", symbol), ("code_text", text))}
        want |= {(path, symbol, line, f, t, n, sum(map(len, words.values()))) for f, w in words.items() for t, n in Counter(w).items()}
    rows = [(r.filepath, r.symbol, r.start_line, r.field, r.term, r.tf, r.dl) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_tokens_of_bytes_are_those_of_the_pattern():
    for text in ("1a 12 9_x a9 _ __1 9", "K kin KiN é1é x\x00y\x1fz", "a-b.C9d 07up7 7", " tail 1 2a"):
        want = Counter(t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
        assert lexical._words(text.encode()) == {t.encode(): n for t, n in want.items()}


def test_an_index_is_written_without_a_pattern_over_its_texts(spark, monkeypatch):
    """Totals follow from postings; a pattern over every text once gave them."""
    monkeypatch.setattr(lexical, "length", lambda: 1 / 0)
    rows = [*ROWS, ("empty", "", "", 5, None), (None, "x", "y", 6, "z")]
    postings, totals = lexical.written(spark.createDataFrame(rows, CHUNKS))
    tokens = sum(len(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", x or "")) for _, path, symbol, _, text in ROWS for x in (path, symbol, text))
    assert sorted(map(tuple, totals.collect()), key=str) == [("empty", 1, 0), ("r", 4, tokens), (None, 1, 3)]
    assert postings.groupBy("repo_url").sum("tf").count() == 2


def test_the_funnel_searches_once(spark, sf_dir, monkeypatch):
    """Each of its four stages once searched for itself."""
    calls, real = [], catalogue._lists
    monkeypatch.setattr(catalogue, "_lists", lambda v: calls.append(1) or real(v))
    rows = {r.stage: r.hits for r in catalogue.queries()["candidate_funnel"](spark, sf_dir).collect()}
    assert len(calls) == 1 and rows["kept"] <= rows["reranked"] <= rows["fused"] <= rows["candidates"]


def test_an_index_is_written_as_lists_of_postings(spark, monkeypatch, tmp_path):
    """A row a posting was once sorted and written; the lists hold the same postings, however texts are grouped."""
    rows = [*ROWS, (None, "x", "y", 6, "z b"), *[("r", f"f{i}", "sym", i, "common words b common") for i in range(40)]]
    chunks = spark.createDataFrame(rows, CHUNKS)
    tables = []
    real = lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda df, name, *more: tables.append(real(df, name, *more)) or tables[-1])
    columns = ["repo_url", "term", "field", *lexical.KEY, "tf", "dl"]
    plain = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    want = plain(lexical.indexed(chunks))
    for size in (lexical.TASK_BYTES, 1):
        monkeypatch.setattr(lexical, "TASK_BYTES", size)
        postings, _ = lexical.written(chunks)
        assert plain(postings) == want
        if size > 1:
            assert tables[0].where("bucket >= 0").count() < len(want) / 2
