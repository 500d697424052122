"""Traversal of the symbol graph: bounded reach, inheritance, impact.

``symbols``: node, filepath, qualified_name, name, type, start_line, end_line. ``edges``: type, src, dst (nodes).
Searches go level by level and for many starts at once; every level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions.text import last_segment, owner_of
from symgraph.session import materialize

INHERITANCE_DEPTH = 5
RELATIONS = {"CALLS": "calls", "INHERITS": "subclasses", "OVERRIDES": "overrides"}
CONSTRUCTORS = ("__init__", "__new__", "constructor")


def of_type(edges: DataFrame, kind: str) -> DataFrame:
    """src, dst of one type."""
    return edges.where(F.col("type") == kind).select("src", "dst")


def reversed_(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(pairs: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, hops: every node within ``depth`` steps and its fewest steps; a start counts as reached only through a cycle."""
    frontier, seen = starts.select(F.col("node").alias("start"), "node").distinct(), None
    for hop in range(1, depth + 1):
        step = frontier.join(pairs, frontier.node == pairs.src).select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["start", "node"], "left_anti")
        step = step.withColumn("hops", F.lit(hop))
        frontier_next = materialize(step, "reach") if hop < depth else step
        seen = frontier_next if seen is None else seen.unionByName(frontier_next)
        frontier = frontier_next.select("start", "node")
    return seen


def neighbours(symbols: DataFrame, pairs: DataFrame, matches: DataFrame, depth: int, limit: int, by: tuple[str, ...] = ("hops", "filepath", "qualified_name")) -> DataFrame:
    """One row a neighbour, at most ``limit`` for each match, the first in order of ``by``, with the uncut ``total``."""
    found = reach(pairs, matches.select("node"), depth).join(symbols.select("node", "filepath", "qualified_name"), "node")
    order = W.partitionBy("start").orderBy(*by)
    total = found.groupBy("start").agg(F.count("*").alias("total"))
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).join(total, "start")


def name_matches(name: str) -> Column:
    """A dotted name is a qualified one; a bare name may be either."""
    qualified = F.col("qualified_name") == name
    return qualified if "." in name else qualified | (F.col("name") == name)


def find(symbols: DataFrame, name: str, filepath: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols of a name, in order of (filepath, qualified_name)."""
    out = symbols.where(name_matches(name))
    if filepath is not None:
        out = out.where(F.col("filepath") == filepath)
    return out.orderBy("filepath", "qualified_name").limit(limit)


def at_line(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (filepath, line) the innermost symbol around it."""
    inside = places.join(symbols, "filepath").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    order = W.partitionBy("filepath", "line").orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), "qualified_name")
    return inside.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def ancestors(inherits: DataFrame, depth: int = INHERITANCE_DEPTH) -> DataFrame:
    """cls, ancestor, level for every class, up to ``depth`` levels."""
    starts = inherits.select(F.col("src").alias("node")).distinct()
    return reach(inherits, starts, depth).select(F.col("start").alias("cls"), F.col("node").alias("ancestor"), F.col("hops").alias("level"))


def overrides(methods: DataFrame, inherits: DataFrame, depth: int = INHERITANCE_DEPTH) -> DataFrame:
    """method, overridden, level: methods and those of the same name in an ancestor (methods: node, owner, name)."""
    up = ancestors(inherits, depth)
    own = methods.select(F.col("node").alias("method"), F.col("owner").alias("cls"), "name")
    above = methods.select(F.col("node").alias("overridden"), F.col("owner").alias("ancestor"), "name")
    return own.join(up, "cls").join(above, ["ancestor", "name"]).groupBy("method", "overridden").agg(F.min("level").alias("level"))


def overriding(targets: DataFrame, methods: DataFrame, inherits: DataFrame, depth: int = INHERITANCE_DEPTH) -> DataFrame:
    """method, overridden, level of the methods that override one of ``targets`` (node): from the targets' classes down, so that
    what it costs follows from them and not from all classes (methods: node, owner, name)."""
    own = materialize(targets.select(F.col("node").alias("overridden")).join(methods.withColumnRenamed("node", "overridden"), "overridden"), "targets")
    below = reach(reversed_(inherits), own.select(F.col("owner").alias("node")), depth)
    found = own.join(below.select(F.col("start").alias("owner"), F.col("node").alias("cls"), F.col("hops").alias("level")), "owner").drop("owner")
    found = found.join(methods.select(F.col("node").alias("method"), F.col("owner").alias("cls"), "name"), ["cls", "name"])
    return found.groupBy("method", "overridden").agg(F.min("level").alias("level"))


def _dependents(frontier: DataFrame, edges: DataFrame, overriding: DataFrame | None) -> DataFrame:
    """relation, via, node: what calls or inherits from the frontier, or overrides one of it."""
    back = edges.where(F.col("type").isin("CALLS", "INHERITS")).select(F.col("type").alias("relation"), F.col("src").alias("node"), F.col("dst").alias("via"))
    out = back.join(frontier.select(F.col("node").alias("via")), "via")
    if overriding is not None:
        more = overriding.select(F.lit("OVERRIDES").alias("relation"), F.col("method").alias("node"), F.col("overridden").alias("via"))
        out = out.unionByName(more.join(frontier.select(F.col("node").alias("via")), "via").select(*out.columns))
    return out


def impact(symbols: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 3, max_symbols: int = 300, overriding: DataFrame | None = None) -> DataFrame:
    """Affected symbols: ord, hops, relation, via_filepath, via_name, filepath, qualified_name, type, truncated.

    A level is one step back along calls and inheritance; overriding methods count at the first level only, and a
    constructor's class is followed too, but not reported. A symbol reached twice in a level belongs to the first of
    (via, overrides first, relation). ``truncated``: more than ``max_symbols`` were reachable.
    """
    place = symbols.select("node", "filepath", "qualified_name", "type")
    named = targets.select("node").join(symbols.select("node", "qualified_name", "filepath"), "node")
    made = named.where(last_segment(F.regexp_replace("qualified_name", r"#\d+$", "")).isin(*CONSTRUCTORS))
    owners = made.select("filepath", owner_of(F.col("qualified_name")).alias("qualified_name")).join(symbols.where("type = 'class'"), ["filepath", "qualified_name"]).select("node")
    seen = materialize(targets.select("node").union(owners).distinct(), "impact")
    frontier, levels = seen, None
    for hop in range(1, depth + 1):
        step = _dependents(frontier, edges, overriding if hop == 1 else None).join(seen, "node", "left_anti")
        via = place.select(F.col("node").alias("via"), F.col("filepath").alias("via_filepath"), F.col("qualified_name").alias("via_name"))
        step = step.join(via, "via")
        first = F.struct("via_filepath", "via_name", (F.col("relation") != "OVERRIDES").alias("late"), "relation")
        level = step.groupBy("node").agg(F.min(first).alias("f")).select("node", "f.*", F.lit(hop).alias("hops"))
        level = materialize(level, "impact")
        frontier = level.select("node")
        seen = seen.unionByName(frontier)
        levels = level if levels is None else levels.unionByName(level)
    every = levels.join(place, "node")
    count = every.groupBy().agg(F.count("*").alias("total"))
    cut = every.orderBy("hops", "via_filepath", "via_name", "late", "relation", "filepath", "qualified_name").limit(max_symbols)
    order = W.partitionBy().orderBy("hops", "via_filepath", "via_name", "late", "relation", "filepath", "qualified_name")
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])[F.col("relation")], F.lower("relation"))
    out = cut.withColumn("ord", F.row_number().over(order)).withColumn("relation", label).withColumn("truncated", F.lit(count.select("total").scalar() > max_symbols))
    return out.select("ord", "hops", "relation", "via_filepath", "via_name", "filepath", "qualified_name", "type", "truncated")


def by_file(affected: DataFrame) -> DataFrame:
    """filepath, n, nearest_hops, symbols of each affected file."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hops", "qualified_name"))), lambda x: x["qualified_name"]), ",")
    return affected.groupBy("filepath").agg(F.count("*").alias("n"), F.min("hops").alias("nearest_hops"), listed.alias("symbols"))


def top_degree(symbols: DataFrame, edges: DataFrame, limit: int = 400) -> DataFrame:
    """node, qualified_name, degree of the best connected symbols (all types, both directions; none is 0)."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    out = symbols.join(ends, "node", "left").select("node", "qualified_name", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.orderBy(F.desc("degree"), "qualified_name").limit(limit)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def symbol_context(symbols: DataFrame, edges: DataFrame, anchors: DataFrame, depth: int = 3, fanout: int = 10) -> DataFrame:
    """What surrounds each anchor (node): callees, callers, owner, bases, subclasses, methods, overrides both ways.

    Lists are cut to ``fanout`` nearest first, but for bases and overridden methods; each is cut before it is gathered.
    """
    at = anchors.select("node").distinct()
    calls = of_type(edges, "CALLS")
    member, inherits = of_type(edges, "HAS_METHOD"), of_type(edges, "INHERITS")
    place = symbols.select("node", "filepath", "qualified_name", F.col("start_line").alias("line"), "name")

    def listed(rows: DataFrame, name: str, cut: int | None, hops: bool = False) -> DataFrame:
        """``name``: a list of rows (start, node, hops)."""
        order = W.partitionBy("start").orderBy("hops", "qualified_name", "filepath")
        r = rows.join(place, "node").withColumn("rn", F.row_number().over(order))
        r = r if cut is None else r.where(F.col("rn") <= cut)
        item = F.struct("rn", F.col("qualified_name").alias("name"), "filepath", "line", *(["hops"] if hops else []))
        return r.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rn")).alias(name))

    step = lambda pairs: pairs.join(at, pairs.src == at.node, "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("hops"))
    owned = member.select(F.col("src").alias("owner"), F.col("dst").alias("node"))
    over = overrides(owned.join(place.select("node", "name"), "node"), inherits)
    up = materialize(over.select(F.col("method").alias("src"), F.col("overridden").alias("dst"), "level"), "overrides")
    both = lambda a, b: up.select(F.col(a).alias("start"), F.col(b).alias("node"), F.col("level").alias("hops")).join(at.withColumnRenamed("node", "start"), "start", "left_semi")
    parts = [
        listed(reach(calls, at, depth), "calls", fanout, True), listed(reach(reversed_(calls), at, depth), "called_by", fanout, True),
        listed(step(inherits), "bases", None), listed(step(reversed_(inherits)), "subclasses", fanout), listed(step(member), "methods", fanout),
        listed(both("src", "dst"), "overrides", None), listed(both("dst", "src"), "overridden_by", fanout),
    ]
    owner = step(reversed_(member)).join(place, "node").groupBy("start").agg(F.min("qualified_name").alias("owner"))
    out = symbols.join(at, "node", "left_semi").select("node", "filepath", "qualified_name", "type", "start_line", "end_line")
    for part in [*parts, owner]:
        out = out.join(part.withColumnRenamed("start", "node"), "node", "left")
    return out


def in_out(edges: DataFrame, node: str) -> DataFrame:
    """direction, type, node: the direct neighbours of one symbol."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("node"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), "type", F.col("src").alias("node"))).distinct()


def payload(contexts: DataFrame) -> DataFrame:
    """source, target, type: the edges that symbol contexts show, each once."""
    pairs = {"calls": ("CALLS", True), "called_by": ("CALLS", False), "bases": ("INHERITS", True), "subclasses": ("INHERITS", False), "methods": ("HAS_METHOD", True), "overrides": ("OVERRIDES", True), "overridden_by": ("OVERRIDES", False)}
    rows = None
    for column, (kind, outward) in pairs.items():
        one = contexts.select(F.col("qualified_name").alias("here"), F.explode(column).alias("x")).select("here", F.col("x.name").alias("there"))
        one = one.select(F.col("here" if outward else "there").alias("source"), F.col("there" if outward else "here").alias("target"), F.lit(kind).alias("type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.distinct()
