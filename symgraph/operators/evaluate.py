"""Retrieval and answer quality over labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions.text import base_name

#: An abstention speaks of the context and of what it lacks, within the opening sentences.
ABOUT_CONTEXT = (
    r"(?i)\b(provided|given|shown|retrieved|available|supplied)\s+(context|code|snippets?|codebase|repository|graph)"
    r"|\b(the|this)\s+(context|snippets|codebase)\b"
)
LACKS = (
    r"(?i)\b(does|do|did)(n'?t| not)\s+(contain|include|show|mention|implement|define|provide|have|cover|describe)"
    r"|\bthere (is|are) no\b"
    r"|\bno (implementation|mention|code|information|logic|definition|evidence|reference)"
    r"|\b(is|are) not (implemented|present|included|shown|defined|mentioned|available|covered)"
    r"|\b(cannot|can'?t|unable to) (be )?(determine|answer|find|confirm)"
    r"|\bnot enough (information|context)"
)
OPENING = 2
LOWER_IS_BETTER = ("wrongly_abstained", "seconds", "asked_for_more", "chunks")


def gold_hits(gold: DataFrame, ranking: DataFrame) -> DataFrame:
    """case_id, name, rank: each gold symbol's best rank, null if not found. Gold without a file matches any file."""
    g = gold.select("case_id", F.col("name").alias("gold"), F.col("filepath").alias("gold_file"))
    r = ranking.select(F.col("case_id").alias("_c"), base_name(F.col("symbol")).alias("_n"), F.col("filepath").alias("_f"), "rank")
    same = (F.col("case_id") == F.col("_c")) & (F.col("gold") == F.col("_n")) & (F.col("gold_file").isNull() | (F.col("gold_file") == F.col("_f")))
    return g.join(r, same, "left").groupBy("case_id", "gold", "gold_file").agg(F.min("rank").alias("rank"))


def recall(hits: DataFrame) -> DataFrame:
    """case_id, gold, found, recall, first_rank, reciprocal_rank of each case."""
    out = hits.groupBy("case_id").agg(F.count("*").alias("gold"), F.count("rank").alias("found"), F.min("rank").alias("first_rank"))
    return out.withColumn("recall", F.col("found") / F.col("gold")).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def means(rows: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """Means of the metrics, nulls left out, rounded to four places."""
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in metrics])


def missing(hits: DataFrame) -> DataFrame:
    """Gold that no ranking has."""
    return hits.where("rank IS NULL").select("case_id", F.col("gold").alias("name"))


def mention_score(answer: Column, facts: Column) -> Column:
    """The share of facts (arrays of phrasings) that the answer states; null without facts."""
    text = F.lower(answer)
    stated = F.filter(facts, lambda fact: F.exists(fact, lambda p: F.contains(text, F.lower(p))))
    return F.when(F.size(facts) > 0, F.size(stated) / F.size(facts))


def abstained(answer: Column) -> Column:
    """Whether the answer opens by saying that the code is not in the context."""
    sentences = F.filter(F.split(F.trim(answer), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    return F.exists(F.slice(sentences, 1, OPENING), lambda s: s.rlike(ABOUT_CONTEXT) & s.rlike(LACKS))


def cites_gold(cited: DataFrame, spans: DataFrame) -> DataFrame:
    """answer_id, cites_gold: whether a citation lies inside a gold symbol (spans: answer_id, filepath, start_line, end_line)."""
    s = spans.select(F.col("answer_id").alias("_a"), F.col("filepath").alias("_f"), "start_line", "end_line")
    path = F.col("filepath")
    same = (F.col("answer_id") == F.col("_a")) & ((path == F.col("_f")) | F.endswith(F.col("_f"), F.concat(F.lit("/"), path)))
    hit = cited.join(s, same & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    return hit.groupBy("answer_id").agg(F.max(F.col("_a").isNotNull()).alias("cites_gold"))


def baseline_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """variant, metric, before, now, change, regression (variant, metric, value on both sides); for some metrics less is better."""
    both = now.withColumnRenamed("value", "now").join(before.withColumnRenamed("value", "before"), ["variant", "metric"])
    change = F.round(F.col("now") - F.col("before"), 4)
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), change > 0).otherwise(change < 0)
    return both.select("variant", "metric", "before", "now", change.alias("change"), worse.alias("regression"))


def rank_lists(rows: DataFrame, score: str) -> DataFrame:
    """rows with ``rank`` by descending score within each case."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc(score), "filepath", "symbol")))


def gold_spans(gold: DataFrame, symbols: DataFrame) -> DataFrame:
    """case_id, filepath, start_line, end_line of gold symbols, those numbered apart included (symbols: qualified_name, filepath, lines)."""
    s = symbols.select(base_name(F.col("qualified_name")).alias("_n"), F.col("filepath").alias("_f"), "start_line", "end_line")
    same = (F.col("name") == F.col("_n")) & (F.col("filepath").isNull() | (F.col("filepath") == F.col("_f")))
    return gold.join(s, same).select("case_id", F.col("_f").alias("filepath"), "start_line", "end_line")


def answer_scores(answers: DataFrame, checked: DataFrame, gold: DataFrame) -> DataFrame:
    """answer_id, citations, citation_validity, cites_gold, abstained of each answer (answers: answer_id, answer)."""
    counts = checked.groupBy("answer_id").agg(F.count("*").alias("citations"), F.count_if(F.col("status").isin("verified", "graph")).alias("backed"))
    out = answers.select("answer_id", abstained(F.col("answer")).alias("abstained")).join(counts, "answer_id", "left").join(cites_gold(checked, gold), "answer_id", "left")
    return out.select("answer_id", F.coalesce("citations", F.lit(0)).alias("citations"), (F.col("backed") / F.col("citations")).alias("citation_validity"), F.coalesce("cites_gold", F.lit(False)).alias("cites_gold"), "abstained")
