"""Linking references to symbols: calls, base classes and membership, as equi-joins with counts of candidates.

``chunks`` is the table of extracted symbols with repo_url. A reference is resolved only if the rules leave one candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions.text import last_segment, owner_of
from symgraph.session import materialize

#: What a method calls its own object, files that stand for their folder, depth of the walk over bases.
SELF_NAMES = {"python": ["self", "cls"], "javascript": ["this"], "typescript": ["this"]}
PACKAGE_STEMS = ["__init__", "index"]
SUPER_DEPTH = 5


def module_name(path: Column) -> Column:
    """A file's stem, or its folder's name for files that stand for it."""
    file = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    parent = F.when(path.contains("/"), F.substring_index(F.regexp_replace(path, "/[^/]*$", ""), "/", -1)).otherwise("")
    return F.when(stem.isin(PACKAGE_STEMS), parent).otherwise(stem)


def unique_names(chunks: DataFrame, order: str) -> DataFrame:
    """Qualified names made unique within a file: the second and later get ``#n``."""
    n = F.row_number().over(W.partitionBy("file_path", "qualified_name").orderBy(order))
    return chunks.withColumn("_n", n).withColumn("qualified_name", F.when(F.col("_n") == 1, F.col("qualified_name")).otherwise(F.concat("qualified_name", F.lit("#"), F.col("_n").cast("string")))).drop("_n")


def has_method(chunks: DataFrame) -> DataFrame:
    """repo_url, src (class), dst (method), both with their file: a method's owner is its name without the last segment."""
    methods = chunks.where("type = 'method'").select("repo_url", "file_path", F.col("qualified_name").alias("dst_name"), owner_of(F.col("qualified_name")).alias("src_name"))
    owners = chunks.select("repo_url", "file_path", F.col("qualified_name").alias("src_name"))
    return methods.join(owners, ["repo_url", "file_path", "src_name"], "left_semi").select("repo_url", F.lit("HAS_METHOD").alias("type"), F.col("file_path").alias("src_file"), "src_name", F.col("file_path").alias("dst_file"), "dst_name")


def references(chunks: DataFrame) -> DataFrame:
    """One row a reference: where it stands, ``ref``, its segments, ``role`` (call or base), ``ord`` and ``branch``."""
    key = ["repo_url", "language", F.col("file_path").alias("src_file"), F.col("qualified_name").alias("src_name"), F.col("type").alias("src_type")]
    is_base = F.col("type") == "class"
    rows = chunks.where("type IS NOT NULL").select(*key, F.when(is_base, "base").otherwise("call").alias("role"), F.posexplode(F.when(is_base, F.col("bases")).otherwise(F.col("calls"))).alias("ord", "ref"))
    rows = rows.withColumn("parts", F.split("ref", r"\."))
    first, n = F.col("parts")[0], F.size("parts")
    own = F.lit(False)
    for language, names in SELF_NAMES.items():
        own = own | ((F.col("language") == language) & first.isin(names))
    branch = F.when((first == "super") & (n == 2), "super").when(n == 1, "bare").when(own & (n == 2), "self").otherwise("qualified")
    rows = rows.withColumn("branch", branch).withColumn("tail", F.element_at("parts", -1))
    return rows.withColumn("qualifier", F.when(n > 1, F.element_at("parts", -2))).drop("parts")


def enclosed(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``refs`` with ``owner``, the name of the nearest class around the place of the reference."""
    classes = chunks.where("type = 'class'").select("repo_url", F.col("file_path").alias("src_file"), F.col("qualified_name").alias("prefix"))
    parts = F.split("src_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    places = refs.where(F.col("branch").isin("self", "super")).select("repo_url", "src_file", "src_name").distinct()
    around = places.withColumn("prefix", F.explode(prefixes)).join(classes, ["repo_url", "src_file", "prefix"])
    nearest = around.groupBy("repo_url", "src_file", "src_name").agg(F.max_by("prefix", F.length("prefix")).alias("owner"))
    inner, rest = _parted(refs, "self", "super")  # all others have none, and are not shuffled for it
    return inner.join(nearest, ["repo_url", "src_file", "src_name"], "left").unionByName(rest.withColumn("owner", F.lit(None).cast("string")))


def _parted(refs: DataFrame, *branches: str) -> tuple[DataFrame, DataFrame]:
    """``refs`` of some branches, and all others."""
    among = F.col("branch").isin(*branches)
    return refs.where(among), refs.where(F.col("branch").isNull() | ~among)  # both are left to the reader of a written table


KEYS = ["repo_url", "src_file", "src_name", "src_type", "role", "ord", "ref", "branch"]
#: What edges do not tell; not written with references.
SPARED = ["src_type", "ref"]
#: What a candidate may count as: anything that is called, that less methods, methods, classes.
FLAGS = {"call": "c_type IN ('function', 'method', 'class')", "plain": "c_type IN ('function', 'class')", "method": "c_type = 'method'", "class": "c_type = 'class'"}


def _lookup(candidates: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """For each key, how many candidates there are of each flag, and the one if there is one."""
    target = F.struct(F.col("c_file").alias("file"), F.col("c_name").alias("name"))
    aggregates = [x for f, cond in FLAGS.items() for x in (F.count_if(F.expr(cond)).alias(f"{tag}_n_{f}"), F.max(F.when(F.expr(cond), target)).alias(f"{tag}_k_{f}"))]
    return candidates.groupBy(*keys).agg(*aggregates).select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], *[f"{tag}_{x}_{f}" for f in FLAGS for x in "nk"])


def candidates(chunks: DataFrame, *more: str) -> DataFrame:
    """Symbols as references may mean them: tail, c_type, c_file, c_name, and the qualifiers that they may be named by; ``more`` columns are kept."""
    return chunks.select(
        "repo_url", "language", F.col("name").alias("tail"), F.col("type").alias("c_type"), F.col("file_path").alias("c_file"), F.col("qualified_name").alias("c_name"),
        F.array_compact(F.array_distinct(F.array(last_segment(owner_of(F.col("qualified_name"))), module_name(F.col("file_path"))))).alias("qualifiers"), *more,
    )


def resolved(refs: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """KEYS (as far as ``refs`` has them), dst_file, dst_name of every reference (``super`` aside) for which the rules leave one candidate.

    Candidates are counted by name, by name and file, and by name and qualifier before references meet them, so a name
    that thousands of symbols share costs a reference one row and not thousands. What is asked for is looked up once,
    however many references ask: by name and qualifier, and, where their file has the name, by file. References themselves
    are joined with what was found, and are shuffled at most once for each of the two. ``chunks`` may be cut to symbols of the
    names that are referred to, if ``symbols`` has all.
    """
    c = candidates(chunks)
    q = c.withColumn("qualifier", F.explode("qualifiers"))
    name, asked = ["repo_url", "language", "tail"], ["repo_url", "language", "tail", "qualifier", "role", "branch"]
    refs = refs.where("branch <> 'super'")
    base, branch = F.col("role") == "base", F.col("branch")

    def met(out: DataFrame, rows: DataFrame, tag: str, more: list[str], how: str = "left") -> DataFrame:
        """``out`` with what is counted of each key of ``rows``."""
        table = _lookup(rows, [*name, *more], tag)
        same = F.lit(True)
        for k in [*name, *more]:
            same = same & (out["src_file" if k == "c_file" else k] == table[f"{tag}_{k}"])
        return out.join(table, same, how).drop(*[f"{tag}_{k}" for k in [*name, *more]])

    def pool(tag: str) -> Column:
        """The one candidate of the reference's pool, null unless there is exactly one."""
        one = lambda f: F.when(F.col(f"{tag}_n_{f}") == 1, F.col(f"{tag}_k_{f}"))
        calls = F.when(branch == "bare", one("plain")).when(branch == "self", one("method")).otherwise(one("call"))
        return F.when(base, F.when(branch != "self", one("class"))).otherwise(calls)

    def some(tag: str) -> Column:
        return F.coalesce(F.when(base, F.col(f"{tag}_n_class")).otherwise(F.col(f"{tag}_n_call")), F.lit(0)) > 0

    def joined(out: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
        """``out`` with the columns of ``table``, nulls of the keys being equal."""
        table = table.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & (out[k].eqNullSafe(table[f"_{k}"]) if k == "qualifier" else out[k] == table[f"_{k}"])
        return out.join(table, same, "left").drop(*[f"_{k}" for k in keys])

    anywhere = met(met(refs.select(*asked).distinct(), c, "a", [], "inner"), q, "x", ["qualifier"])
    anywhere = materialize(anywhere.where(some("a")).select(*asked, some("x").alias("exact"), pool("a").alias("of_name"), pool("x").alias("of_qualifier")), "asked-names")
    here = refs.select(*name, "src_file").distinct().join(c.select(*name, F.col("c_file").alias("src_file")), [*name, "src_file"], "left_semi")
    here = refs.select(*asked, "src_file").join(materialize(here, "asked-files"), [*name, "src_file"], "left_semi").distinct()
    here = met(met(here, c, "b", ["c_file"]), q, "y", ["qualifier", "c_file"])
    here = materialize(here.select(*asked, "src_file", pool("b").alias("in_file"), pool("y").alias("in_file_of_qualifier")), "asked-in-files")

    every = chunks if symbols is None else symbols
    own = every.select(F.col("repo_url").alias("_r"), F.col("file_path").alias("_f"), F.col("qualified_name").alias("_own")).distinct()
    mine = (F.col("repo_url") == F.col("_r")) & (F.col("src_file") == F.col("_f")) & (F.concat("owner", F.lit("."), "tail") == F.col("_own"))
    inner, rest = _parted(refs, "self")
    none = F.lit(None).cast("string")
    out = inner.join(own, mine, "left").drop("_r").unionByName(rest.withColumn("_f", none).withColumn("_own", none))
    out = joined(joined(out, anywhere, asked), here, [*asked, "src_file"])
    own_one = F.when(F.col("_own").isNotNull(), F.struct(F.col("_f").alias("file"), F.col("_own").alias("name")))
    by_name = F.coalesce("in_file", "of_name")
    chosen = F.coalesce(own_one, F.when((branch == "qualified") & F.col("exact"), F.coalesce("of_qualifier", "in_file_of_qualifier")).otherwise(by_name))
    out = out.where("exact IS NOT NULL").withColumn("target", chosen).where("target IS NOT NULL")  # without a symbol of the name there is none
    return out.select(*[k for k in KEYS if k in refs.columns], F.col("target.file").alias("dst_file"), F.col("target.name").alias("dst_name"))


def called(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols of the listed names (repo_url, language, tail)."""
    return chunks.join(names.withColumnRenamed("tail", "name"), ["repo_url", "language", "name"], "left_semi")


def found(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``resolved`` of ``refs`` (written, as they are read often, without owner): only symbols of the names that they refer to are counted."""
    symbols = chunks.select("repo_url", "language", "name", "type", "file_path", "qualified_name")
    named = materialize(called(symbols, refs.select("repo_url", "language", "tail").distinct()), "asked-symbols")
    return materialize(resolved(enclosed(refs, chunks), named, chunks).drop("branch"), "resolved")


def inherited(refs: DataFrame, bases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Targets of ``super.x``: the first class, breadth first over resolved bases in their order, that defines x."""
    asked = refs.where("branch = 'super' AND owner IS NOT NULL").select(*KEYS, "owner", "tail")
    walk = asked.select(*KEYS, "tail", F.col("src_file").alias("at_file"), F.col("owner").alias("at_name"), F.array().cast("array<int>").alias("path"), F.array(F.concat("src_file", F.lit("\n"), "owner")).alias("seen"))
    up = bases.select(F.col("repo_url").alias("_r"), F.col("src_file").alias("_f"), F.col("src_name").alias("_n"), F.col("ord").alias("step"), F.col("dst_file").alias("b_file"), F.col("dst_name").alias("b_name"))
    defined = chunks.select(F.col("repo_url").alias("_r"), F.col("file_path").alias("_f"), F.col("qualified_name").alias("_n")).distinct()
    found = None
    for level in range(1, SUPER_DEPTH + 1):
        nxt = walk.join(up, (F.col("repo_url") == F.col("_r")) & (F.col("at_file") == F.col("_f")) & (F.col("at_name") == F.col("_n")))
        nxt = nxt.select(*KEYS, "tail", F.col("b_file").alias("at_file"), F.col("b_name").alias("at_name"), F.concat("path", F.array("step")).alias("path"), "seen")
        nxt = nxt.where(~F.array_contains("seen", F.concat("at_file", F.lit("\n"), "at_name")))
        walk = materialize(nxt.withColumn("seen", F.concat("seen", F.array(F.concat("at_file", F.lit("\n"), "at_name")))), "super")
        hit = walk.withColumn("want", F.concat("at_name", F.lit("."), "tail")).join(defined, (F.col("repo_url") == F.col("_r")) & (F.col("at_file") == F.col("_f")) & (F.col("want") == F.col("_n")))
        hit = hit.select(*KEYS, F.lit(level).alias("level"), "path", F.col("at_file").alias("dst_file"), F.col("want").alias("dst_name"))
        found = hit if found is None else found.unionByName(hit)
        if walk.isEmpty():
            break
    best = found.groupBy(*KEYS).agg(F.min(F.struct("level", "path", "dst_file", "dst_name")).alias("b"))
    return best.select(*KEYS, "b.dst_file", "b.dst_name")


def edges_of(found: DataFrame) -> DataFrame:
    """Resolved references as edges, without loops of one symbol."""
    kind = F.when(F.col("role") == "base", "INHERITS").otherwise("CALLS")
    edges = found.where((F.col("src_file") != F.col("dst_file")) | (F.col("src_name") != F.col("dst_name")))
    return edges.select("repo_url", kind.alias("type"), "src_file", "src_name", "dst_file", "dst_name")


def link(chunks: DataFrame, written: bool = False) -> DataFrame:
    """All edges: repo_url, type, src_file, src_name, dst_file, dst_name; distinct, without loops of one symbol. ``written``: chunks are read from files."""
    chunks = chunks if written else materialize(chunks, "chunks")
    refs = materialize(references(chunks).drop(*SPARED), "refs")
    every = found(refs, chunks)
    if not refs.where("branch = 'super'").isEmpty():
        above = enclosed(references(chunks).where("branch = 'super'"), chunks)
        every = every.unionByName(inherited(above, every.where("role = 'base'"), chunks).select(every.columns))
    return edges_of(every).unionByName(has_method(chunks)).distinct()
