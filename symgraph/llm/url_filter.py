"""URL filter: a blocked Bloom filter of the listed keys, then an exact hash join. Built-in functions only.

A listed rule is (host, path, verdict). It fits its host and every subdomain of it, if the url's path starts with the
rule's path; the longest fitting rule wins. A rule's key is its host with its path up to the last slash; a url's
candidate keys are its host's suffixes at dots with its path's prefixes at slashes, none with more labels or slashes than the
longest listed key has, so a long url has no more than a short one. Candidates that the filter lets
through meet the rules in a hash join on the key itself, where the rest of the path is compared too, so a false positive of the
filter costs a row in that join and never a wrong verdict.

Scale: the filter has 16 bits a key up to MAX_BLOCKS blocks (2 MB), a proven bound on what each task gets; a longer list
only makes it pass more. Rows meet the filter where they are read: those without a possible hit are never shuffled. Of the others
distinct (host, path) pairs meet the rules, and the join back onto them is one that Spark can split where a url is hot.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty list allows all;
columns of the input stay, but for ones named host, path, rule or verdict, which are replaced;
duplicate rules count once, and of rules for the same host and path with both verdicts ``block`` holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A block has 256 bits, four words of 64; a key sets two bits in each.
WORDS, MAX_BLOCKS, BITS_A_KEY = 4, 1 << 16, 16
#: The verdict where no listed rule fits.
UNLISTED = "allow"
#: The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_AZ)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _key(host: Column, directory: Column) -> Column:
    return F.concat(host, F.lit("\n"), directory)


def _candidates(host: Column, path: Column, labels: Column, depth: Column) -> Column:
    """Keys of a url that a list may have whose hosts have ``labels`` labels and whose directories ``depth`` slashes at most."""
    last = lambda n: F.call_function("substring_index", host, F.lit("."), -n)
    cut = lambda n: F.call_function("substring_index", path, F.lit("/"), n)
    hosts = F.transform(F.sequence(F.lit(1), labels), lambda n: F.when((n == 1) | (F.length(last(n - 1)) < F.length(host)), last(n)))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda n: F.when(n == 0, F.lit("")).when(F.length(cut(n)) < F.length(path), F.concat(cut(n), F.lit("/"))))
    kept = lambda c: F.filter(c, lambda x: x.isNotNull())
    return F.flatten(F.transform(kept(hosts), lambda h: F.transform(kept(prefixes), lambda p: _key(h, p))))


def _block(key: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n)


def _mask(key: Column, word: int) -> Column:
    h = F.xxhash64(key, F.lit(1))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return one(12 * word).bitwiseOR(one(12 * word + 6))


def bloom_filter(keys: DataFrame) -> DataFrame:
    """One row: ``bits``, WORDS longs a block, over the distinct values of ``keys.key``."""
    spark = keys.sparkSession
    keys = keys.select("key").distinct()
    size = keys.agg(F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count("*") * BITS_A_KEY / (64 * WORDS)))).cast("long").alias("n"))
    blocks = spark.range(MAX_BLOCKS).where(F.col("id") < size.scalar()).select(F.col("id").alias("block"))
    words = [F.bit_or(_mask(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)]
    set_ = keys.groupBy(_block(F.col("key"), size.scalar()).alias("block")).agg(*words)
    filled = blocks.join(set_, "block", "left").select("block", F.array(*[F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")) for w in range(WORDS)]).alias("w"))
    # at most MAX_BLOCKS rows come together here, whatever the list's length
    return filled.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "w"))), lambda x: x["w"])).alias("bits"))


def might_contain(bits: Column, key: Column) -> Column:
    """Whether the filter lets a key through; false positives are possible, false negatives are not."""
    at = (_block(key, (F.size(bits) / WORDS).cast("long")) * WORDS).cast("int")
    found = F.lit(True)
    for w in range(WORDS):
        mask = _mask(key, w)
        found = found & (F.get(bits, at + w).bitwiseAND(mask) == mask)
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", unlisted: str = UNLISTED) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict. ``rules``: host, path, verdict."""
    listed = rules.select(F.translate("host", *_AZ).alias("r_host"), F.col("path").alias("r_path"), "verdict").groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    listed = listed.withColumn("key", _key(F.col("r_host"), _directory(F.col("r_path"))))
    parts = lambda c, by: F.size(F.split(c, by))
    longest = listed.agg(F.max(parts("r_host", r"\.")).alias("labels"), F.max(parts(_directory(F.col("r_path")), "/") - 1).alias("depth"))
    # one row, written once: what is read of it below is never computed again
    head = materialize(bloom_filter(listed).withColumns({"labels": F.coalesce(longest.select("labels").scalar(), F.lit(1)), "depth": F.coalesce(longest.select("depth").scalar(), F.lit(0))}), "url-filter")
    bits, (labels, depth) = head.select("bits").scalar(), head.select("labels", "depth").first()
    # the caller's columns are one struct here, so that no name can clash
    judged = pages.select(F.struct("*").alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # the filter is one row of at most 2 MB, sent to every task; both sides of this are plans without an exchange
    one = F.broadcast(head.select(F.col("bits").alias("_bits")))
    hit = (F.col("host") != "") & F.exists(_candidates(F.col("host"), F.col("path"), F.lit(labels), F.lit(depth)), lambda key: might_contain(F.col("_bits"), key))
    near, far = judged.join(one, hit, "left_semi"), judged.join(one, hit, "left_anti")
    pairs = near.select("host", "path").distinct()
    passed = pairs.select("host", "path", F.explode(_candidates(F.col("host"), F.col("path"), F.lit(labels), F.lit(depth))).alias("key")).where(might_contain(bits, F.col("key")))
    fits = passed.join(listed, "key").where(F.startswith(F.col("path"), F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best")
    )
    met = near.join(best, ["host", "path"], "left").select("page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"))
    out = met.unionByName(far.select("page", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict")))
    own = [F.col(f"page.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, "host", "path", "rule", "verdict")


def query(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = pages.sparkSession.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return judge_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """The query in DuckDB SQL."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {values}),
cut AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
best AS (SELECT c.host, c.path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules r
    ON (c.host = r_host OR ends_with(c.host, '.' || r_host)) AND starts_with(c.path, r_path)
  GROUP BY ALL)
SELECT page_id, cut.host, cut.path, rule, coalesce(verdict, '{UNLISTED}') AS verdict
FROM cut LEFT JOIN best ON cut.host = best.host AND cut.path = best.path"""
