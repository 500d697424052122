"""Linking by change: edges are kept up to date by resolving again only the references that an edit can have changed.

A reference's outcome follows from whether there are none, one or more candidates of its name, in its file, by its qualifier
or by both, and if there is one, from which it is. So keys are compared before and after, not candidates: the thousand and first symbol of
a name changes no key, and none of the references to that name is looked at again. Symbols are compared, not files: only keys of
those that came or went, and that some reference names, are counted, in the new version alone, as what came and went tells how many
there were. References to ``self`` and ``super`` are resolved again in all files that differ, and ``super`` is followed from the
classes of such files down to those that inherit from them.

``relink`` returns the rows that ``resolve.link`` would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.operators import resolve
from symgraph.session import materialize

#: A symbol's place, and what else references find it by.
SYMBOL = ["repo_url", "file_path", "qualified_name", "language", "name", "type"]
_SOURCE = ["repo_url", "src_file", "src_name"]
_NAME = ["repo_url", "language", "tail"]


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """SYMBOL, more: the symbols that differ in what linking reads, and how many more there are now of each (0 if only calls or bases differ).

    Calls and bases are compared by the sum of a hash in two halves, which do not overflow; the 0 between tells calls from bases.
    """

    def marks(chunks: DataFrame, sign: int) -> DataFrame:
        mark = F.xxhash64("calls", F.lit(0), "bases")
        return chunks.select(*SYMBOL, F.lit(sign).cast("bigint").alias("more"), (F.shiftright(mark, 32) * sign).alias("high"), (mark.bitwiseAND(F.lit(0xFFFFFFFF)) * sign).alias("low"))

    sums = [F.sum(x).alias(x) for x in ("more", "high", "low")]
    return marks(old, -1).unionByName(marks(new, 1)).groupBy(*SYMBOL).agg(*sums).where("more <> 0 OR high <> 0 OR low <> 0").select(*SYMBOL, "more")


def _of_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files, ["repo_url", "file_path"], "left_semi")


def _of_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    return chunks.join(sources.select("repo_url", F.col("src_file").alias("file_path"), F.col("src_name").alias("qualified_name")), ["repo_url", "file_path", "qualified_name"], "left_semi")


def _sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("repo_url", F.col("file_path").alias("src_file"), F.col("qualified_name").alias("src_name"))


def _keys(file: Column, qualifiers: Column) -> Column:
    """What candidates are counted by, beside their name: nothing, their file, a qualifier, or both."""
    key = lambda kind, f, q: F.struct(F.lit(kind).alias("kind"), f.alias("in_file"), q.alias("by"))
    none = F.lit("")
    plain = F.array(key("name", none, none), key("file", file, none))
    return F.concat(plain, F.transform(qualifiers, lambda q: key("qualifier", none, q)), F.transform(qualifiers, lambda q: key("both", file, q)))


def changed_keys(touched: DataFrame, new: DataFrame) -> DataFrame:
    """_NAME, kind, in_file, by: where a reference finds something else among the symbols of ``new`` than before ``touched``
    (SYMBOL, more) came or went."""
    names = touched.select("repo_url", "language", F.col("name").alias("tail")).distinct()
    near = touched.select("repo_url", F.col("file_path").alias("c_file")).distinct().withColumn("near", F.lit(True))
    now = resolve.candidates(resolve.called(new, names)).join(near, ["repo_url", "c_file"], "left").withColumn("more", F.lit(None).cast("bigint"))
    rows = resolve.candidates(touched, "more").withColumn("near", F.lit(True)).unionByName(now)
    file = F.when(F.col("near"), F.col("c_file"))  # elsewhere no key within a file can have changed
    rows = rows.withColumn("key", F.explode(F.filter(_keys(file, F.col("qualifiers")), lambda k: k["in_file"].isNotNull())))
    counts, differs = [], F.lit(False)
    for flag, condition in resolve.FLAGS.items():
        here = F.coalesce(F.expr(condition), F.lit(False))
        gone = F.col("more").isNotNull()
        counts += [F.count_if(here & ~gone).alias(f"now {flag}"), F.sum(F.when(here & gone, F.col("more")).otherwise(F.lit(0))).alias(f"more {flag}"), F.count_if(here & gone).alias(f"touched {flag}")]
        n = F.col(f"now {flag}")
        was = n - F.col(f"more {flag}")
        # one before and one now is another one, or it were not touched
        differs = differs | ((F.col(f"touched {flag}") > 0) & ((F.least(was, F.lit(2)) != F.least(n, F.lit(2))) | (n == 1)))
    return rows.groupBy(*_NAME, "key").agg(*counts).where(differs).select(*_NAME, "key.*")


def _along(steps: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``starts`` (_SOURCE) and what ``steps`` (_SOURCE, to_file, to_name) lead to from there, ``depth`` times."""
    seen = frontier = materialize(starts.select(*_SOURCE).distinct(), "relink-along")
    for _ in range(depth):
        step = steps.join(frontier, _SOURCE, "left_semi").select("repo_url", F.col("to_file").alias("src_file"), F.col("to_name").alias("src_name"))
        frontier = materialize(step.distinct().join(seen, _SOURCE, "left_anti"), "relink-along")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _asking(refs: DataFrame, touched: DataFrame, keys: DataFrame) -> list[DataFrame]:
    """The places (_SOURCE) of ``refs`` that ask for changed ``keys``, by kind of key: no reference is copied for each of its keys, and
    those within a file are asked of the files that have ``touched`` symbols alone."""
    near = refs.join(touched.select("repo_url", F.col("file_path").alias("src_file")).distinct(), ["repo_url", "src_file"], "left_semi")
    out = []
    for kind, asked, more in (("name", refs, []), ("qualifier", refs, ["qualifier"]), ("file", near, ["src_file"]), ("both", near, ["src_file", "qualifier"])):
        of_kind = keys.where(F.col("kind") == kind).select(*_NAME, F.col("in_file").alias("src_file"), F.col("by").alias("qualifier"))
        out.append(asked.join(of_kind.select(*_NAME, *more), [*_NAME, *more], "left_semi").select(*_SOURCE))
    return out


def affected(old: DataFrame, new: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The differing files (repo_url, file_path), and the symbols (_SOURCE) whose references are to be resolved again: those that
    differ, before and after, those that ask for a changed key, and those that look a name up in a class of a differing file or its heirs."""
    changed = materialize(changed_symbols(old, new), "relink-symbols")
    files = materialize(changed.select("repo_url", "file_path").distinct(), "relink-files")
    refs = materialize(resolve.references(new).select(*_SOURCE, "language", "branch", "tail", "qualifier"), "relink-asked")
    touched = materialize(resolve.called(changed.where("more <> 0"), refs.select(*_NAME).distinct()).select(*SYMBOL, "more"), "relink-touched")
    keys = materialize(changed_keys(touched, new), "relink-keys")
    own = refs.where(F.col("branch").isin("self", "super")).join(files.withColumnRenamed("file_path", "src_file"), ["repo_url", "src_file"], "left_semi").select(*_SOURCE)
    found = materialize(reduce(DataFrame.unionByName, [_sources(changed), own, *_asking(refs, touched, keys)]).distinct(), "relink-sources")
    above = refs.where("branch = 'super'")
    if not above.isEmpty():
        down = edges.where("type = 'INHERITS'").select("repo_url", F.col("dst_file").alias("src_file"), F.col("dst_name").alias("src_name"), F.col("src_file").alias("to_file"), F.col("src_name").alias("to_name"))
        classes = [_sources(_of_files(x.where("type = 'class'"), files)) for x in (old, new)]  # a method that came or went changes its class
        below = _along(down, reduce(DataFrame.unionByName, [found, *classes]), resolve.SUPER_DEPTH).withColumnRenamed("src_name", "owner")
        more = resolve.enclosed(above, new).join(below, ["repo_url", "src_file", "owner"], "left_semi").select(*_SOURCE)
        found = materialize(found.unionByName(more).distinct(), "relink-sources")
    return files, found


def relink(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of ``new``, given ``edges`` as ``resolve.link`` or this function made them of ``old``.

    Both are tables of symbols with repo_url, of any number of repositories; either may be empty. Null names, calls and bases
    are no references. A symbol's edges are replaced as a whole, membership a file at a time.
    """
    files, sources = affected(old, new, edges)
    again = resolve.references(_of_sources(new, sources))
    refs = materialize(again.drop(*resolve.SPARED), "relink-refs")
    found = resolve.found(refs, new)
    kept = edges.where("type <> 'HAS_METHOD'").join(sources, _SOURCE, "left_anti")
    if not refs.where("branch = 'super'").isEmpty():
        asked = materialize(resolve.enclosed(again.where("branch = 'super'"), new).where("owner IS NOT NULL"), "relink-super")
        # edges do not tell in which order a class names its bases, so those on the way up are resolved again
        fresh = resolve.edges_of(found).where("type = 'INHERITS'")
        up = kept.where("type = 'INHERITS'").unionByName(fresh).select(*_SOURCE, F.col("dst_file").alias("to_file"), F.col("dst_name").alias("to_name"))
        classes = _along(up, asked.select("repo_url", "src_file", F.col("owner").alias("src_name")), resolve.SUPER_DEPTH - 1)
        bases = materialize(resolve.references(_of_sources(new, classes)).where("role = 'base'").drop(*resolve.SPARED), "relink-bases")
        found = found.unionByName(resolve.inherited(asked, resolve.found(bases, new), new).select(found.columns))
    members = edges.where("type = 'HAS_METHOD'").join(files.withColumnRenamed("file_path", "src_file"), ["repo_url", "src_file"], "left_anti")
    fresh = resolve.edges_of(found).unionByName(resolve.has_method(_of_files(new, files))).distinct()
    return kept.unionByName(members).unionByName(fresh)
