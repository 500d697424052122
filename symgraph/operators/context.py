"""What a model is shown, and checking what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions.text import lines, truncated

#: Extensions, longest first, and how a place in code is cited, as ``path:line`` or ``path:line-line``.
EXTENSIONS = ("jsx", "mjs", "cjs", "tsx", "mts", "cts", "py", "js", "ts")
CITATION = rf"([\w@.\-/]+\.(?:{'|'.join(EXTENSIONS)})):(\d+)(?:\s*[-–]\s*(\d+))?"
REQUEST = r"(?s)^[\s*_`>]*NEED\s*:\s*(.*)"
SNIPPET_LINES, REQUEST_ITEMS, ITEM_CHARS = 60, 5, 200
HISTORY, ANSWER_CHARS = 6, 1200


def without_nested(hits: DataFrame, max_lines: int = SNIPPET_LINES, group: str | None = None) -> DataFrame:
    """Hits that no other hit shows in full: one that is no class, is shown whole and spans strictly more."""
    on = [group, "filepath"] if group else ["filepath"]
    whole = hits.where((F.col("chunk_type") != "class") & (F.size(lines(F.coalesce("code_text", F.lit("")))) <= max_lines))
    whole = whole.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_{c}"))
    inside = (F.col("_s") <= F.col("start_line")) & (F.col("end_line") <= F.col("_e")) & ((F.col("_s") != F.col("start_line")) | (F.col("_e") != F.col("end_line")))
    return hits.join(whole, same & inside, "left_anti")


def snippets(hits: DataFrame, max_lines: int = SNIPPET_LINES) -> DataFrame:
    """Hits with ``shown``, the code that a prompt has of them."""
    return hits.withColumn("shown", truncated(F.col("code_text"), max_lines))


def formatted(hits: DataFrame, max_lines: int = SNIPPET_LINES) -> Column:
    """A hit as a prompt shows it."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.concat(
        F.lit("File: "), unknown("filepath"), F.lit(" (Lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
        F.lit(")\nSymbol: "), unknown("symbol"), F.lit("\nChunk Type: "), unknown("chunk_type"), F.lit("\nCode:\n```\n"), truncated(F.col("code_text"), max_lines), F.lit("\n```"),
    )


def snippet_spans(hits: DataFrame, max_lines: int = SNIPPET_LINES) -> DataFrame:
    """filepath, start, end, shown of code as a prompt shows it; without code, the span's own length counts."""
    n = F.size(lines(F.coalesce("code_text", F.lit(""))))
    length = F.when(n > 0, n).otherwise(F.col("end_line") - F.col("start_line") + 1)
    known = hits.where("filepath IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    return known.select("filepath", F.col("start_line").alias("start"), (F.col("start_line") + F.least(length, F.lit(max_lines)) - 1).alias("end"), F.lit(True).alias("shown"))


def citations(answers: DataFrame) -> DataFrame:
    """answer_id, ord, text, path, line, end_line: distinct citations of each answer, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(CITATION), F.lit(0))
    rows = answers.select("answer_id", F.posexplode(F.array_distinct(found)).alias("ord", "text"))
    part = lambda i: F.regexp_extract("text", f"^{CITATION}$", i)
    end = F.when(part(3) == "", part(2)).otherwise(part(3))
    return rows.select("answer_id", "ord", "text", part(1).alias("path"), part(2).cast("int").alias("line"), end.cast("int").alias("end_line"))


def check(cited: DataFrame, spans: DataFrame) -> DataFrame:
    """answer_id, ord, text, filepath, line, end_line, status of each citation (spans: filepath, start, end, shown).

    A cited path may leave out leading folders: paths meet by an equi-join on every suffix of the known ones.
    """
    parts = F.split("filepath", "/")
    suffixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    files = spans.select("filepath").distinct().select("filepath", F.explode(suffixes).alias("key"))
    keyed = cited.withColumn("key", F.regexp_replace("path", "^[./]+", ""))
    known = keyed.join(files, "key", "left")
    covering = known.join(spans.withColumnRenamed("filepath", "_f"), (F.col("filepath") == F.col("_f")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    out = covering.groupBy("answer_id", "ord", "text", "path", "line", "end_line").agg(
        F.min("filepath").alias("candidate"),
        F.min(F.when(F.col("shown"), F.col("_f"))).alias("shown_in"),
        F.min("_f").alias("covered_in"),
    )
    status = F.when(F.col("candidate").isNull(), "unknown_file").when(F.col("shown_in").isNotNull(), "verified").when(F.col("covered_in").isNotNull(), "graph").otherwise("wrong_line")
    return out.select("answer_id", "ord", "text", F.coalesce("shown_in", "covered_in", "candidate", "path").alias("filepath"), "line", "end_line", status.alias("status"))


def citation_summary(checked: DataFrame) -> DataFrame:
    """Counts by status for each answer."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checked.groupBy("answer_id").agg(F.count("*").alias("total"), *map(count, ("verified", "graph", "wrong_line", "unknown_file")))


def requested_items(reply: Column, most: int = REQUEST_ITEMS) -> Column:
    """The items of a ``NEED:`` reply; null if the text is an answer."""
    strip = lambda c, chars: F.btrim(c, F.lit(chars))
    blank = " \t\r\n\f\x0b"
    items = F.transform(F.split(F.regexp_extract(reply, REQUEST, 1), "[,;\n]"), lambda c: strip(F.rtrim(strip(c, blank), F.lit(".")), "`*_'\" "))
    kept = F.array_distinct(F.filter(items, lambda c: (c != "") & (F.length(c) <= ITEM_CHARS)))
    return F.when(reply.rlike(REQUEST), F.slice(kept, 1, most))


def history(turns: DataFrame, messages: int = HISTORY, chars: int = ANSWER_CHARS) -> DataFrame:
    """conv_id, turn, line: a conversation's last messages; what is not the user's is cut."""
    recent = turns.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("rn") <= messages)
    text = F.trim(F.coalesce("text", F.lit("")))
    user = F.col("role") == "user"
    cut = F.when(~user & (F.length(text) > chars), F.concat(F.substring(text, 1, chars), F.lit(" ..."))).otherwise(text)
    return recent.select("conv_id", "turn", F.concat(F.when(user, "User: ").otherwise("Assistant: "), cut).alias("line"))


def degraded(hits: DataFrame, most: int = 10) -> DataFrame:
    """Without a model: the located hits, as a list."""
    line = F.concat(F.lit("- `"), F.col("filepath"), F.lit(":"), F.col("start_line").cast("string"), F.lit("` "), F.coalesce("symbol", F.lit("")))
    return hits.where("filepath IS NOT NULL AND start_line IS NOT NULL").orderBy("rank").limit(most).select("rank", line.alias("line"))


def impact_lines(affected: DataFrame, most: int = 40) -> DataFrame:
    """ord, line: an impact report as a prompt lists it."""
    line = F.concat(F.lit("- "), F.col("qualified_name"), F.lit(" ("), F.col("filepath"), F.lit("): "), F.col("relation"), F.lit(" "), F.col("via_name"), F.lit(", "), F.col("hops").cast("string"), F.lit(" steps away"))
    return affected.where(F.col("ord") <= most).select("ord", line.alias("line"))
