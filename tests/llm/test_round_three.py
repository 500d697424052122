"""Infilling, the Merkle manifest and byte pairs against plain versions, a library and SQL, and on odd input."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from symgraph.llm import byte_pairs, infilling, merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, key string, path string, form string, n string"


def rows():
    rnd = random.Random(5)
    texts = [None, "", "\n", "one line", "a\nb", "a\nb\n", "\n\n\n", "has <P> inside\nx", "<S>", "end <\nM>", "<\n<S\n>x", "É\nß😀\n\tZ", "A" * 5000, "Ab\n" * 3000, "x <|endoftext|> y", "\x00\x85  ﻿"]
    texts += ["\n".join("".join(rnd.choice("aB cé") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30))) for _ in range(160)]
    out = [(i, t, rnd.choice(["hot", "hot", "en", None, "-", "É"]), rnd.choice(["s", None]), rnd.choice([None, 3])) for i, t in enumerate(texts)]
    out += [out[9], out[9], (None, "Null ID", "en", "s", 1), (None, None, None, None, None), (-7, "Negative", "alone", "s", 1), (50, "Same id, other text", out[50][2], "t", 2)]
    return [(*r, "x", "y", "z", "w", "v") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


def sql_rows(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    return sorted(map(str, con.sql(sql).fetchall()))


# Infilling


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infilling_cuts_as_a_list_of_units_would_and_is_undone(docs):
    rows_ = infilling.fill_in_middle(docs).withColumn("again", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = [(r[0], *plain_cut(r[0], r[1])) for r in rows()]
    assert sorted(map(str, [tuple(r)[:6] for r in rows_])) == sorted(map(str, want))
    assert sorted(r.again for r in rows_) == sorted(r[1] or "" for r in rows())
    assert {r.form for r in rows_} == {"plain", "psm", "spm"}
    mine = infilling.query(docs)
    assert sorted(map(str, [tuple(r) for r in mine.collect()])) == sql_rows(docs, infilling.sql())
    assert infilling.query(docs.limit(0)).count() == 0


def test_infilling_of_other_units_rates_and_sentinels(spark):
    docs = spark.createDataFrame([(i, "ab cd  ef<P>") for i in range(200)], "doc_id int, text string")
    marks = ("[p]", "[s]", "[m]")
    got = infilling.fill_in_middle(docs, unit=r"\s*\S+", sentinels=marks, rate=50, spm_rate=0, seed=3).collect()
    assert {r.n for r in got} == {3} and {r.form for r in got} == {"plain", "psm"} and 60 < sum(r.form == "psm" for r in got) < 140
    assert all(r.output.startswith("[p]") for r in got if r.form == "psm")
    for bad in (("<a>", "<a>b", "<c>"), ("aba", "<s>", "<m>"), ("", "<s>", "<m>"), ("xy", "yz", "<m>"), ("<s>", "<s>", "<m>")):
        with pytest.raises(ValueError):
            infilling.fill_in_middle(docs, sentinels=bad)


def test_infilling_holds_no_list_of_units():
    import tracemalloc

    text = "x\n" * 1_000_000
    unit = regex.compile(infilling.UNIT)
    tracemalloc.start()
    n, _, first, _, output = infilling.cut(text, 11, unit, ("<P>", "<S>", "<M>"), 100, 50, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_000 and first % 2 == 0 and len(output) == len(text) + 9
    assert peak < 5 * len(text)  # pieces and the output, but no million matches


# Merkle manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and the siblings of each leaf, level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = range(p // 8 * 8, min(p // 8 * 8 + 8, len(nodes)))
            proofs[i] += [nodes[j] for j in run if j != p]
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], proofs


def plain_manifest(docs):
    def leaf(r, low=False):
        text = r[1] if r[1] is None or not low else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    groups = {}
    for r in docs:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order, out = sorted(groups, key=str.encode), []
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = plain_tree([trees[g][0] for g in order])
    for number, g in enumerate(order):
        for x, proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            same = not (x[0] and zlib.crc32(str(x[1]).encode()) % 3 == 0 and leaf(x[3], True) != x[2])
            out.append((x[3][0], x[2], trees[g][0], root, H(*proof, *above[number]), same))
    return out


def test_manifest_is_the_plain_tree(docs):
    want = plain_manifest(rows())
    got = merkle.query(docs).collect()
    assert sorted(map(str, [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got])) == sorted(map(str, want))
    assert all((r.folded_root == r.root) == r.verified for r in got) and {r.verified for r in got} == {True, False}
    assert sorted(map(str, [tuple(r) for r in got])) == sql_rows(docs, merkle.sql())
    assert merkle.query(docs.limit(0)).count() == 0
    assert merkle.query(docs.limit(1)).select("leaf", "subroot", "root").distinct().collect()[0].leaf == merkle.query(docs.limit(1)).first().root


def test_manifest_of_many_rounds_and_many_groups(spark, monkeypatch):
    """Sizes on both sides of every power of the fan-out and of the block; more groups than a block holds."""
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 4097, *[1] * 700]
    data = [(g * 10_000 + i, None, f"g{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(7)
    got = merkle.query(docs).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == sorted(plain_manifest(data))


def test_a_proof_is_checked_apart_from_the_manifest(docs):
    rows_ = merkle.manifest(docs, merkle.leaf_of(F.col("text")), group="source", order="n_chars")
    checked = rows_.withColumn("same", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("other", merkle.folded(F.sha2(F.lit("x"), 256), F.col("path")))
    assert checked.where("same = root AND other <> root").count() == len(rows())
    assert rows_.columns == ["source", "n_chars", "leaf", "path", "subroot", "root"]


# Byte pairs


def plain_merge(piece, ranks):
    """Merge the leftmost pair of the lowest rank until there is none."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_pairs.read_ranks(byte_pairs.path_of(byte_pairs.RANKS))
    encoding = tiktoken.Encoding("own", pat_str=byte_pairs.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()


def test_ids_are_the_librarys(library):
    rnd = random.Random(2)
    letters = ["ab", "aaab", "abcdefghijklmnopqrstuvwxyz", " \n\t", "é😀a1 '", "".join(map(chr, range(0x20, 0x250))), "'sreml d"]
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in letters for n in (0, 1, 2, 3, 9, 60, 2000) for _ in range(8)]
    texts += ["a" * 20_000, "the" * 7000, "\n" * 9999, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))]
    coder = byte_pairs.BytePairs()
    got = coder.encode(texts)
    assert got == [library(t) for t in texts]
    assert [coder.decode(x) for x in got] == [t.encode() for t in texts]


def test_any_rank_file_merges_as_the_plain_rule_does():
    """Files whose ranks follow no training, where a merge often makes a pair of a lower rank."""
    rnd = random.Random(8)
    for number in range(30):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))) for _ in range(rnd.choice([5, 60, 300]))}
        ids = rnd.sample(range(6000), len(tokens))
        ranks = dict(zip(sorted(tokens), ids, strict=True))
        pieces = [bytes(rnd.choice(b"abc" if number % 2 else b"aab") for _ in range(rnd.choice([0, 1, 2, 5, 30, 200]))) for _ in range(40)]
        ids, sizes = byte_pairs.Merges(ranks).merge([p for p in pieces if p not in ranks])
        assert ids.tolist() == [i for p in pieces if p not in ranks for i in plain_merge(p, ranks) if p]
        assert sizes.tolist() == [len(plain_merge(p, ranks)) if p else 0 for p in pieces if p not in ranks]


def test_rank_queue_gives_the_lowest_first():
    rnd, queue, held = random.Random(1), byte_pairs.RankQueue(300_000), {}
    for _ in range(3000):
        if held and rnd.random() < 0.45:
            rank, places = queue.pop()
            assert rank == min(held) and places.tolist() == sorted(held.pop(rank))
        else:
            rank, place = rnd.randrange(300_000) if rnd.random() < 0.7 else rnd.randrange(70), rnd.randrange(1 << 20)
            queue.push(rank, np.array([place]))
            held.setdefault(rank, set()).add(place)
    assert bool(queue.top) == bool(held)


def test_windows_and_fresh_starts_change_nothing(library, monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 900))) for _ in range(60)] + ["".join(rnd.choice("abé") for _ in range(9000))]
    want = [library(t) for t in texts]
    for name, value in (("IN_TURN", 3), ("PIECE", 50), ("TOGETHER", 40), ("GROUP", 700), ("REMEMBER", 30), ("GATHERED", 7)):
        monkeypatch.setattr(byte_pairs, name, value)
    assert "".join(byte_pairs.pieces(texts[0], 50)) == texts[0]
    coder = byte_pairs.BytePairs()
    for at in range(0, len(texts), 10):
        assert coder.encode(texts[at : at + 10]) == want[at : at + 10]
    assert [coder.decode(x) for x in want] == [t.encode() for t in texts]


def test_very_long_pre_tokens_take_linear_time(library):
    rnd, coder = random.Random(6), byte_pairs.BytePairs()
    coder.encode(["warm"])
    for text in ("".join(rnd.choice("abcdefghijklmnop") for _ in range(1_000_000)), "a" * 1_000_000, "ab" * 500_000):
        began = time.perf_counter()
        ids = coder.encode([text])[0]
        assert time.perf_counter() - began < 30
        assert ids == library(text)


def test_documents_round_trip(spark, docs, library, tmp_path):
    got = byte_pairs.decode(byte_pairs.encode(docs)).withColumn("text", byte_pairs.text_from(F.col("decoded"))).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(r[0]), library(r[1] or "")) for r in rows())
    assert all(r.n_tokens * 4 == len(r.ids) for r in got) and sorted(r.text for r in got) == sorted(r[1] or "" for r in rows())
    assert byte_pairs.query(docs.limit(0)).count() == 0
    own = tmp_path / "own.tiktoken"
    own.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    assert byte_pairs.encode(docs.where("doc_id = 4"), ranks=str(own)).first().n_tokens == 3
    (tmp_path / "bad.tiktoken").write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError):
        byte_pairs.BytePairs(str(tmp_path / "bad.tiktoken")).encode(["ab"])


def test_every_document_of_the_data_is_the_librarys(spark, sf_dir, library):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in byte_pairs.query(table).collect()}
    for r in table.select("doc_id", "text").collect():
        ids = library(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[r.doc_id].n_tokens * 4 == len(ids)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_a_pair_is_made_in_few_of_the_lists_that_it_shares(spark):
    """Texts that share most of their rare shingles once made their pair in each of these lists."""
    from pyspark.sql import functions as F

    from symgraph.llm import set_join

    r = np.random.default_rng(7)
    rows = []
    for group in range(4):
        base = [f"w{group}x{i}" for i in range(300)]
        for i in range(8):
            words = list(base)
            for at in r.integers(0, 300, 4 * i % 13):
                words[at] = f"edit{group}n{i}n{at}"
            rows.append((group * 8 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = set_join.set_rows(docs, 0.8, 5).select("node", "n", "prefix").distinct()
    postings = set_join._met(set_join._dealt(sets), 0.8, 64)
    none = spark.createDataFrame([], "node binary, root binary")
    made = [(bytes(p.a), bytes(p.b)) for p in set_join._round(postings, none, 0, 64, 0.8, 64).where(F.col("a").isNotNull()).collect()]
    found = {set_join.node_of(s): set(s.tolist()) for s in (set_join.shingle_set(t, 5) for _, t in rows)}
    names = sorted(found)
    alike = {(a, b) for a in names for b in names if a < b and len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b])}
    assert len(alike) > 20 and alike <= set(made)
    assert len(made) <= 4 * len(set(made))
