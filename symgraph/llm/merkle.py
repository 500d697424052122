"""A Merkle manifest: a hash tree over every group's rows in order, a tree over the groups, and a proof for each row.

Leaves hash a row's columns, each with its length, so that no two rows share an encoding. Rows are put in order by ranges, and their
number in the group makes blocks of BLOCK consecutive leaves. A block is one row with an ordered array, which is collapsed level by level by higher-order
functions (sequence, transform, slice, aggregate) into one root; the roots of blocks are the leaves of the next round, until a group has one.
On the way down a row's proof is its siblings in its own block and those of its block in the rounds above. The groups' roots,
in the order of groups, are a tree of the same kind.

Scale: texts are read once and never shuffled; what is shuffled are hashes, once by ranges, once into blocks of a fixed
size, so a group that holds most rows is many blocks. Rounds follow the logarithm of the largest group, which is the one number the driver gets.
Every round is written, so lost executors repeat no order.

Defined cases: a null value hashes as ``-``; the null group and null order keys come first; rows of equal group and order key lie in the order of
their leaves, and rows that repeat as a whole are leaves each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

FANOUT, LEVELS = 8, 3
#: Leaves in a block: LEVELS levels of the tree.
BLOCK = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    """Lowercase hex of the sha256."""
    return F.sha2(value, 256)


def leaf_of(*columns: Column) -> Column:
    """The hash of values in order: ``-`` for null, else the number of bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _run(nodes: Column, number: Column) -> Column:
    """The run of FANOUT nodes of that number, counted from 0."""
    return F.slice(nodes, number * FANOUT + 1, F.lit(FANOUT))


def _collapsed(nodes: Column) -> Column:
    """The level above ``nodes``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda j: digest(F.array_join(_run(nodes, j), "")))


def _tiers(nodes: Column, total: Column) -> Column:
    """The levels of one block, its leaves first: LEVELS above them if its tree has more blocks, else up to the one root."""
    height = F.lit(0)
    for level in range(LEVELS):
        height = height + F.when(total > FANOUT**level, 1).otherwise(0)
    start = F.array(nodes).cast("array<array<string>>")
    return F.aggregate(F.slice(F.array(*map(F.lit, range(1, LEVELS + 1))), F.lit(1), height), start, lambda tiers, _: F.concat(tiers, F.array(_collapsed(F.element_at(tiers, -1)))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _path(tiers: Column, place: Column) -> Column:
    """The siblings of the leaf at ``place`` (from 0) on each level below the root, left and right of it."""

    def step(level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FANOUT), level - 1)).cast("int")
        own = at % FANOUT
        sides = lambda run: F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, F.lit(FANOUT)), "").alias("right"))
        return _let(_run(F.element_at(tiers, level), F.floor(at / FANOUT).cast("int")), sides)

    return F.transform(F.slice(F.array(*map(F.lit, range(1, LEVELS + 1))), F.lit(1), F.size(tiers) - 1), step)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (key, ...) with ``pos``, their number within the key in the order given, from 0, and ``total``, the key's rows."""
    rows = materialize(rows, "merkle-leaves")  # ranges are drawn from a sample, which would compute the hashes twice
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-ranges")
    runs = ranged.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row a range, and one more a key
    by_key = W.partitionBy("key")
    before = F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by_key).alias("total"))
    return ranged.join(materialize(runs, "merkle-runs"), ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _tree(nodes: DataFrame, carry: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over ``nodes`` (key, pos, total, hash and what is carried), and key, root."""
    nodes = materialize(nodes, "merkle-placed")
    most, rounds = nodes.agg(F.max("total")).first()[0] or 0, []
    while not rounds or most > 1:
        block = F.floor(F.col("pos") / BLOCK).alias("block")
        item = F.struct("pos", "hash", *(carry if not rounds else []))
        blocks = nodes.groupBy("key", block, "total").agg(F.array_sort(F.collect_list(item)).alias("items"))
        blocks = materialize(blocks, "merkle-blocks")
        rounds.append(blocks)
        root = F.element_at(F.element_at(_tiers(F.col("items.hash"), F.col("total")), -1), 1)
        nodes = blocks.select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), root.alias("hash"))
        most = -(-most // BLOCK)
    return rounds, nodes.select("key", F.col("hash").alias("root"))


def _proofs(rounds: list[DataFrame], above: DataFrame, constants: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """hash, carried columns, path and ``constants`` of every leaf; ``above``: key, path above the key's root, constants."""
    upper = above.withColumn("block", F.lit(0).cast("bigint"))
    for number in range(len(rounds) - 1, -1, -1):
        kept = ["hash", *carry] if number == 0 else ["pos"]
        joined = rounds[number].join(upper, ["key", "block"])
        item = lambda tiers: F.transform(
            F.col("items"), lambda x, i: F.struct(*[x[c].alias(c) for c in kept], F.concat(_path(tiers, i), F.col("path")).cast(_PATH).alias("path"))
        )
        each = joined.select("key", *constants, F.explode(_let(_tiers(F.col("items.hash"), F.col("total")), item)).alias("x")).select("key", *constants, "x.*")
        upper = materialize(each.withColumnRenamed("pos", "block"), "merkle-paths") if number else each
    return upper


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """group and order column, leaf, what ``carry`` computes from a row, path (siblings from the leaf up to the root, left and right), subroot, root."""
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key")  # keeps the order of groups, the null group first
    names = {f"c{i}": name for i, name in enumerate((group, order, *carry))}
    values = [F.col(group), F.col(order), *carry.values()]
    leaves = rows.select(key, leaf.alias("hash"), *[v.alias(c) for c, v in zip(names, values, strict=True)])
    rounds, roots = _tree(_placed(leaves, ["c1", "hash"]), list(names))
    groups = materialize(roots.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("hash")), "merkle-groups")
    top, root = _tree(_placed(groups, ["group"]), ["group"])
    none = F.array().cast(_PATH).alias("path")
    above = _proofs(top, root.select("key", none, F.col("root")), ["root"], ["group"])
    above = materialize(above.select(F.col("group").alias("key"), "path", F.col("hash").alias("subroot"), "root"), "merkle-above")
    every = _proofs(rounds, above, ["subroot", "root"], list(names))
    return every.select(*[F.col(c).alias(name) for c, name in names.items()], F.col("hash").alias("leaf"), "path", "subroot", "root")


def lowered(text: Column) -> Column:
    """The text with A-Z as a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query(docs: DataFrame) -> DataFrame:
    """The manifest of all documents, and whether each, or a changed copy of it, still folds to the root; every third id by crc32 is changed."""
    one, other = ([lowered(F.col(c)) if change and c == "text" else F.col(c) for c in COLUMNS] for change in (False, True))
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, leaf_of(*one), carry={"changed": F.when(changed, leaf_of(*other))})
    out = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    proof = digest(proof_text(F.col("path"))).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql(levels: int = 8) -> str:
    """The same rows in DuckDB SQL, a level of the tree at a time, for groups of up to FANOUT**levels rows."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda low: "sha256(" + " || ".join(value("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if low and c == "text" else c) for c in COLUMNS) + ")"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda s: ord(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    ctes = [f"leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf(False)} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(True)} ELSE {leaf(False)} END AS other FROM documents)"]

    def tree(tag: str, start: str) -> None:
        """``tag``0 holds nodes (grp, pos, n, node); ``tag``_steps for each node of a level its run's other nodes."""
        ctes.append(f"{tag}0 AS MATERIALIZED ({start})")
        for i in range(levels):
            run = f"(PARTITION BY grp, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
            ctes.append(f"{tag}_s{i} AS MATERIALIZED (SELECT grp, pos, coalesce(string_agg(node, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(node, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {tag}{i} WHERE n > 1)")
            ctes.append(f"{tag}{i + 1} AS MATERIALIZED (SELECT grp, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node FROM {tag}{i} GROUP BY grp, pos // {FANOUT})")

    tree("t", "SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, leaf AS node FROM leaves")
    tree("g", f"SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n, node FROM t{levels}")
    ctes.append(f"places AS MATERIALIZED (SELECT l.*, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, g.pos AS gpos, g.node AS subroot FROM leaves l JOIN (SELECT t.grp, t.node, row_number() OVER (ORDER BY encode(t.grp)) - 1 AS pos FROM t{levels} t) g USING (grp))")
    ctes.append("f0 AS MATERIALIZED (SELECT *, other AS node, '' AS proof FROM places)")
    step = "SELECT f.* EXCLUDE (node, proof), CASE WHEN s.lft IS NULL THEN f.node ELSE sha256(s.lft || f.node || s.rgt) END AS node, f.proof || coalesce(s.lft || s.rgt, '') AS proof FROM f{0} f LEFT JOIN {1} s ON {2}"
    for i in range(levels):
        ctes.append(f"f{i + 1} AS MATERIALIZED (" + step.format(i, f"t_s{i}", f"s.grp = f.grp AND s.pos = f.pos // {FANOUT**i}") + ")")
    for i in range(levels):
        ctes.append(f"f{levels + i + 1} AS MATERIALIZED (" + step.format(levels + i, f"g_s{i}", f"s.pos = f.gpos // {FANOUT**i}") + ")")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified FROM f{2 * levels} f, g{levels} r"
