"""Parsers and the resolver over our own sources."""

from __future__ import annotations

import pytest

from symgraph.operators import resolve
from symgraph.plans import fixtures
from symgraph.sources.parse import parse_file


def of(path, language="python"):
    source = (fixtures.PYTHON if language == "python" else fixtures.SCRIPT)[path]
    return {c["qualified_name"]: c for c in parse_file(path, language, source)}


def test_class_is_its_header_and_members_have_kinds():
    got = of("shop/base.py")
    assert list(got) == ["Record", "Record.save", "Record.check", "write", "write.flush"]
    assert got["Record"]["source_code"].splitlines()[-1].strip() == 'table = "records"'
    assert got["Record"]["docstring"] == "Something kept." and got["Record.save"]["type"] == "method"
    assert got["write.flush"]["type"] == "function" and got["write"]["calls"] == ["flush"]


def test_aliases_decorators_repeated_names():
    got = of("shop/orders.py")
    assert got["Order"]["bases"] == ["Record"] and "util.add" in got["Order.total"]["calls"]
    assert got["Order.total#2"]["name"] == "total" and got["Order.save"]["calls"] == ["audited", "super", "super.save", "write"]


def test_overloads_and_unreadable_files():
    assert [c["start_line"] for c in of("shop/util.py").values() if c["name"] == "add"] == [6]
    assert of("shop/broken.py") == {} and of("shop/empty.py") == {}


def test_script_symbols():
    got = of("web/app.ts", "typescript")
    assert got["Circle"]["bases"] == ["Shape"] and got["Circle"]["type"] == "class"
    assert got["Circle.constructor"]["calls"] == ["super.constructor"]
    assert got["Circle.area"]["calls"] == ["tools.square"]
    assert {"this.describe", "register", "items.map"} == set(got["Circle.onClick"]["calls"])
    assert got["api.load"]["type"] == "function" and "Circle" in got["api.save"]["calls"]
    assert got["outer"]["calls"] == ["inner"] and got["outer.inner"]["calls"] == ["twice"]
    assert of("web/base.ts", "typescript")["register"]["docstring"] == "Keeps a shape."


@pytest.mark.parametrize("source", ["", "  ", "}", "class", "class A {", "const a = (", "`${", "x => {", "function (", "a = /[/]/; b()", "<T,>(x: T) => x", "/** "])
def test_odd_scripts_do_not_crash(source):
    parse_file("a.ts", "typescript", source)


@pytest.fixture(scope="module")
def edges(spark):
    rows = resolve.link(fixtures.chunks(spark)).collect()
    return {(r.type, r.src_name, f"{r.dst_file}:{r.dst_name}") for r in rows}


@pytest.mark.parametrize(
    "edge",
    [
        ("INHERITS", "Order", "shop/base.py:Record"),
        ("HAS_METHOD", "Order", "shop/orders.py:Order.total#2"),
        ("CALLS", "Record.save", "shop/base.py:Record.check"),
        ("CALLS", "Record.save", "shop/base.py:write"),
        ("CALLS", "Order.save", "shop/base.py:Record.save"),
        ("CALLS", "Rush.save", "shop/orders.py:Order.save"),
        ("CALLS", "Order.total", "shop/util.py:add"),
        ("CALLS", "place", "shop/orders.py:Rush"),
        ("CALLS", "place", "shop/util.py:Order.hurry"),
        ("CALLS", "Order.check", "shop/orders.py:Order.again"),
        ("INHERITS", "Circle", "web/base.ts:Shape"),
        ("CALLS", "Circle.constructor", "web/base.ts:Shape.constructor"),
        ("CALLS", "Circle.area", "web/tools/index.ts:square"),
        ("CALLS", "api.save", "web/app.ts:Circle"),
    ],
)
def test_edge(edges, edge):
    assert edge in edges


def test_ambiguous_and_external_references_are_dropped(edges):
    assert not [e for e in edges if e[0] == "CALLS" and e[1] == "place" and e[2].endswith(".save")]
    assert not [e for e in edges if e[1] == "total" and e[2] == "shop/util.py:total"]
    assert not [e for e in edges if e[2].endswith("fetchAll")]
