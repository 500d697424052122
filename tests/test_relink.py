"""Linking by change against linking everything."""

from __future__ import annotations

import random

import pytest

from symgraph.operators import relink, resolve
from symgraph.plans import fixtures
from symgraph.plans.engine import Engine
from symgraph.schemas import CHUNK, INDEX_VERSION
from symgraph.session import materialize

SCHEMA = "repo_url string, " + CHUNK
PLAIN = ["save", "load", "get", "run"]
CLASSES = ["Base", "Item", "Order", "Shop", "Store"]


def symbol(path, qualified, kind, calls=(), bases=()):
    return ("r", qualified.rsplit(".", 1)[-1], qualified, kind, path, "python", 1, 2, None, "", list(calls), list(bases))


def reference(rng):
    name = rng.choice(PLAIN)
    return rng.choice([name, rng.choice(CLASSES), f"self.{name}", f"super.{name}", f"{rng.choice(CLASSES)}.{name}", f"f{rng.randrange(8)}.{name}", "nothing"])


def made_file(rng, path):
    """Symbols of a random file: functions and classes with bases and methods, of few names, so that many clash."""
    out = [symbol(path, n, "function", [reference(rng) for _ in range(rng.randrange(3))]) for n in rng.sample(PLAIN, rng.randrange(2))]
    for c in rng.sample(CLASSES, rng.randrange(3)):
        bases = rng.sample([x for x in CLASSES if x != c], rng.randrange(3))
        out.append(symbol(path, c, "class", bases=bases))
        out += [symbol(path, f"{c}.{m}", "method", [reference(rng) for _ in range(1 + rng.randrange(3))]) for m in rng.sample(PLAIN, rng.randrange(3))]
    return out


def edited(rng, files):
    files = dict(files)
    for _ in range(rng.randrange(1, 3)):
        path = f"p/f{rng.randrange(8)}.py"
        if rng.random() < 0.3:
            files.pop(path, None)
        else:
            files[path] = made_file(rng, path)
    return files


def table(spark, repositories):
    return spark.createDataFrame([(f"r{i}", *row[1:]) for i, files in enumerate(repositories) for rows in files.values() for row in rows], SCHEMA)


def rows(df):
    found = [tuple(r) for r in df.select("repo_url", "type", "src_file", "src_name", "dst_file", "dst_name").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_edges_equal_a_full_link_after_random_edits(spark):
    rng = random.Random(5)
    before = [{f"p/f{i}.py": made_file(rng, f"p/f{i}.py") for i in range(8)} for _ in range(60)]
    after = [edited(rng, files) for files in before]
    old, new = table(spark, before), table(spark, after)
    edges = materialize(resolve.link(old), "edges")
    got, want, was = rows(relink.relink(old, new, edges)), rows(resolve.link(new)), rows(edges)
    assert got == want
    changed = {e[0] for e in want ^ was}
    assert len(changed) > 40
    inside = {(f"r{i}", path) for i, (x, y) in enumerate(zip(before, after, strict=True)) for path in {*x, *y} if x.get(path) != y.get(path)}
    assert any((e[0], e[2]) not in inside for e in want ^ was)  # edges of files that were not edited


def test_symbols_of_a_frequent_name_leave_its_references_alone(spark):
    hot = [symbol(f"p/h{i}.py", "get", "function") for i in range(3)]
    users = [symbol(f"p/u{i}.py", f"u{i}", "function", ["get", "lone"]) for i in range(5)]
    lone = [symbol("p/lone.py", "lone", "function")]
    old = spark.createDataFrame(hot + users + lone, SCHEMA)
    edges = resolve.link(old)
    new = spark.createDataFrame([*hot, symbol("p/h9.py", "get", "function"), *users, *lone], SCHEMA)
    files, sources = relink.affected(old, new, edges)
    assert [r.file_path for r in files.collect()] == ["p/h9.py"] and [r.src_name for r in sources.collect()] == ["get"]
    two = spark.createDataFrame([*hot, *users, *lone, symbol("p/other.py", "lone", "function")], SCHEMA)
    assert {r.src_name for r in relink.affected(old, two, edges)[1].collect()} == {"lone", *(f"u{i}" for i in range(5))}
    assert rows(relink.relink(old, two, edges)) == rows(resolve.link(two)) == set()


def test_super_follows_changed_bases(spark):
    top = lambda *methods: [symbol("p/top.py", "Top", "class"), *(symbol("p/top.py", f"Top.{m}", "method") for m in methods)]
    middle = [symbol("p/mid.py", "Mid", "class", bases=["Top"])]
    low = [symbol("p/low.py", "Low", "class", bases=["Mid"]), symbol("p/low.py", "Low.run", "method", ["super.run"])]
    old, new = (spark.createDataFrame(x, SCHEMA) for x in (top("save") + middle + low, top("save", "run") + middle + low))
    edges = resolve.link(old)
    got = rows(relink.relink(old, new, edges))
    assert got == rows(resolve.link(new))
    assert ("r", "CALLS", "p/low.py", "Low.run", "p/top.py", "Top.run") in got - rows(edges)


def test_empty_tables_and_nulls(spark):
    some = spark.createDataFrame([symbol("a.py", "f", "function", ["g", None]), symbol("b.py", "g", "function"), ("r", None, "n", "function", "c.py", "python", 1, 2, None, "", None, None)], SCHEMA)
    none, no_edges = some.limit(0), resolve.link(some.limit(0))
    want = rows(resolve.link(some))
    assert want == rows(relink.relink(none, some, no_edges)) == {("r", "CALLS", "a.py", "f", "b.py", "g")}
    assert rows(relink.relink(some, none, resolve.link(some))) == set()
    assert rows(relink.relink(some, some, resolve.link(some))) == want
    assert rows(relink.relink(none, none, no_edges)) == set()


def test_a_run_that_ends_early_is_followed_by_a_full_one(spark, tmp_path, monkeypatch):
    from tests.test_engine import files

    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(files(spark, fixtures.PYTHON), "c1", now=1)
    edit = dict(fixtures.PYTHON) | {"shop/util.py": fixtures.PYTHON["shop/util.py"] + "\n\ndef extra():\n    return add(1, 2)\n"}
    replace = engine.store.replace

    def stops(name, rows):
        if name == "edges":
            raise RuntimeError("lost")
        replace(name, rows)

    monkeypatch.setattr(engine.store, "replace", stops)
    with pytest.raises(RuntimeError, match="lost"):
        engine.index(files(spark, edit), "c2", now=2)
    monkeypatch.undo()
    assert rows(engine.store.read("edges", "r"))  # the old edges are still there
    assert engine.index(files(spark, edit), "c2", now=3).first().added == len(edit)
    assert rows(engine.store.read("edges", "r")) == rows(resolve.link(engine.store.read("chunks", "r")))
    assert engine.store.read("repositories", "r").first().index_version == INDEX_VERSION


def test_references_meet_what_was_looked_up_and_not_each_lookup(spark):
    """References once were joined with four tables of counts and with all symbols, each a shuffle of all their columns."""
    rows = [("r", "python", f"f{i}.py", f"A.m{i}", f"m{i}", "method", [f"A.m{i + 1}", "m0"], []) for i in range(4)]
    schema = "repo_url string, language string, file_path string, qualified_name string, name string, type string, calls array<string>, bases array<string>"
    chunks = spark.createDataFrame(rows, schema)
    refs = materialize(resolve.enclosed(resolve.references(chunks), chunks), "refs")
    found = resolve.resolved(refs, chunks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3  # symbols (references of self only), and what was found by name and by file
    assert {(r.src_name, r.dst_name) for r in found.collect()} == {(f"A.m{i}", f"A.m{i + 1}") for i in range(3)}


def test_an_edit_of_one_symbol_leaves_the_others_of_its_file_alone(spark):
    """All symbols of a file that differed were once resolved again, and all names in it counted anew."""
    users = [symbol("p/u.py", f"u{i}", "function", ["go"]) for i in range(5)]
    rest = [symbol("p/go.py", "go", "function"), symbol("p/to.py", "to", "function"), symbol("p/k.py", "K", "class", bases=["go"])]
    old = spark.createDataFrame(users + rest, SCHEMA)
    new = spark.createDataFrame([symbol("p/u.py", "u0", "function", ["to"]), *users[1:], *rest], SCHEMA)
    edges = resolve.link(old)
    files, sources = relink.affected(old, new, edges)
    assert [r.file_path for r in files.collect()] == ["p/u.py"] and [r.src_name for r in sources.collect()] == ["u0"]
    assert rows(relink.relink(old, new, edges)) == rows(resolve.link(new))
    # what was a call is now a base, one of two alike is gone, and another file has the only one
    moved = [("r", "K", "K", "class", "p/k.py", "python", 1, 2, None, "", ["go"], [])]
    changed = {(r.qualified_name, r.more) for r in relink.changed_symbols(spark.createDataFrame([*users, *users, *rest], SCHEMA), spark.createDataFrame([*users, *users[1:], *rest[:2], *moved], SCHEMA)).collect()}
    assert changed == {("u0", -1), ("K", 0)}
    away = spark.createDataFrame([*users, symbol("p/other.py", "go", "function"), *rest[1:]], SCHEMA)
    assert {r.src_name for r in relink.affected(old, away, edges)[1].collect()} == {"go", "K", *(f"u{i}" for i in range(5))}
    assert rows(relink.relink(old, away, edges)) == rows(resolve.link(away))
