"""Each operator against a brute-force version, and on odd input: nulls, empty texts and tables, ties, repeats, other columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from symgraph.llm.labelled import sample as labelled_rows
from symgraph.llm import components, html_text, mixing, neighbours, packing, pii, quality, simhash, sketches, tokens, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, bucket string, score string"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abdegiklmnorstu") for _ in range(rnd.randint(1, 4))) for _ in range(n))


def rows(seed=1, n=120):
    rnd = random.Random(seed)
    base = prose(rnd, 300)
    out = [(None, "an id that is null", "en", "s1"), (1, None, "en", "s1"), (2, "", "en", None), (3, " \t\n", "en", "s2"), (4, "one", "en", "s2")]
    out += [(5, base, "en", "hot"), (6, base, "fr", "hot"), (7, base.replace(base.split()[150], "changed"), "en", "hot"), (8, base.upper(), "en", "s2")]
    out += [(9, prose(rnd, 20_000), "en", "s1")]
    out += [(i, prose(rnd, rnd.randint(1, 200)), "en", rnd.choice(["hot", "hot", "s1", "s2", "é"])) for i in range(10, n)]
    out += [out[20], out[20], (n + 1, "write to a.b@c.de or 4111 1111 1111 1111", "en", "s3")]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", "z") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# PII


def brute_spans(t):
    t = t or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(d):
        return not sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_has_the_base_spans_and_checks_others(spark):
    rnd = random.Random(7)
    bits = ["1", "25", "255", "256", ".", ".", "@", "a", "Z", "-", " ", "+", "(", ")", "é", "\U0001f600", "_", "4111111111111111", "10.0.0.1", "x@y.z", "+1 (234) 555-0199", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "1 " * 3000, "a" * 9000, "1." * 3000, "a@b." * 2000, "+1" * 3000, "9" * 9000, "1.1.1.1 " * 700]
    texts += ["my iban: GB82 WEST 1234 5698 7654 32.", "my iban: GB83 WEST 1234 5698 7654 32.", "visa card 378282246310005", "nr 378282246310005"]
    got = {r.doc_id: r for r in pii.query(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t)
        assert ",".join(x for x in got[i].spans.split(",") if x.split(":")[0] in pii.BASE_KINDS) == base
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].n_email == base.count("email:") and got[i].n_card == base.count("card:")
    n = len(texts)
    assert [got[i].spans for i in range(n - 4, n)] == ["iban:9:36", "", "short_card:10:25", ""]
    masked = pii.mask_personal_data(spark.createDataFrame([("to x@y.zz, +1 (234) 555-0199; 4111111111111111 and 4111111111111112",), (None,)], "text string")).collect()
    assert [r.text for r in masked] == ["to <EMAIL>, <PHONE>; <CARD> and 4111111111111112", ""]


def test_pii_of_no_rows_and_of_repeated_rows(spark):
    rows = [(1, "mail a.b@example.org or +49 30 1234567"), (1, "mail a.b@example.org or +49 30 1234567"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_email, r.n_phone, r.base_sha256) for r in pii.query(docs).collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one, none = (1, 1, 1, digest("email:5:20,phone:24:38")), digest("")
    assert sorted(got, key=str) == sorted([one, one, (None, 0, 0, none), (2, 0, 0, none)], key=str)
    assert pii.query(docs.limit(0)).count() == 0


def test_ibans_are_cut_to_their_country_and_context_counts_on_both_sides(spark):
    texts = [
        "AT611904300234573201 BANK", "GB82 WEST 1234 5698 7654 32 IS MINE AND", "GB82WEST12345698765432X", "DE89370400440532013000", "XX89370400440532013000",
        "378282246310005 is my card", "serial 378282246310005 card", "card 378282246310005", "barcode DE89370400440532013000", "my bank: DE89370400440532013000 (barcode)", "x@y.zz is my mail",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.query(frame).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["iban:0:20", "iban:0:27", "", "iban:0:22", "", "short_card:0:15", "", "short_card:5:20", "", "iban:9:31", "email:0:6"]
    assert [got[i][1] for i in (0, 3, 5, 9, 10)] == ["0.8", "0.6", "0.6", "0.6", "1.0"]
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(frame).collect()}
    assert [masked[i] for i in (0, 1, 5, 6)] == ["<IBAN> BANK", "<IBAN> IS MINE AND", "<SHORT_CARD> is my card", texts[6]]


# URL filter


def test_urls_are_judged_as_sql_does_and_long_lists_lose_nothing(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com/en", "http://a.example.com/en/?x#y", "a://b://example.com/en/", "x://com/\nz", "http://net/es/"]
    pages = spark.createDataFrame(list(enumerate(odd)) + [(99, odd[4]), (99, odd[4])], "page_id bigint, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    mine = sorted(map(str, [tuple(r) for r in url_filter.query(pages).select("page_id", "host", "path", "rule", "verdict").collect()]))
    assert mine == sorted(map(str, con.sql(url_filter.sql()).fetchall()))
    rules = spark.range(3000).selectExpr("concat('h', id, '.example') AS host", "concat('/p', id) AS path", "'block' AS verdict")
    urls = spark.range(6000).selectExpr("id AS page_id", "concat('http://www.h', id, '.example/p', id, '/x') AS url")
    assert url_filter.judge_urls(urls, rules).where("verdict = 'block'").count() == 3000
    assert url_filter.judge_urls(urls.limit(5), rules.limit(0)).where("verdict = 'allow'").count() == 5
    assert url_filter.query(pages.limit(0)).count() == 0


def test_urls_without_a_possible_hit_are_not_shuffled(spark, tmp_path):
    spark.range(2000).selectExpr("id AS page_id", "concat('http://h', id, '.org/p/', id) AS url").write.parquet(str(tmp_path / "pages"))
    got = url_filter.query(spark.read.parquet(str(tmp_path / "pages")))
    assert got.count() == 2000 and got.where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan
    # of the two branches the one for rows without a hit has no exchange but that of the filter itself
    far = got._jdf.queryExecution().sparkPlan().children().apply(1).toString()
    assert "BroadcastNestedLoopJoin" in far and "hashpartitioning" not in far and "SortMergeJoin" not in far


def test_very_long_urls_and_listed_depths(spark):
    long = "http://a.b.c.d.example.com/en/" + "s/" * 60_000 + "end"
    rules = [("com", "/", "allow"), ("example.com", "/en/s/s/s/x", "block"), ("d.example.com", "/en/s/s/s/s", "block"), ("example.com", "/en/s", "allow"), ("EXAMPLE.com", "", "block"), ("org", "", "block")]
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = [long, "http://example.com", "http://example.com/", "http://org?x", "x://d.example.com/en/s/s/s/ss", "http://" + "w." * 5000 + "org/", "http://.com/", "http://com./"]
    pages = spark.createDataFrame([(u, f"r{i}", "p") for i, u in enumerate(urls)], "url string, rule string, page string")
    got = {r.url: (r.rule, r.verdict, r.page) for r in url_filter.judge_urls(pages, rules).collect()}
    assert [got[u][:2] for u in urls] == [
        ("d.example.com/en/s/s/s/s", "block"), ("example.com", "block"), ("example.com", "block"), ("org", "block"), ("d.example.com/en/s/s/s/s", "block"), ("org", "block"), ("com/", "allow"), (None, "allow"),
    ]
    assert {p for *_, p in got.values()} == {"p"}


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_meets_its_targets(spark, docs, none):
    got = mixing.query(docs).collect()
    texts = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.size) for r in got) == texts
    by_id = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[by_id[r.doc_id]] += r.size
        taken[by_id[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(want[by_id[r.doc_id]])
    for s in want:
        assert abs(taken[s] - want[s]) <= max(60, 0.02 * want[s])
    again = {(r.doc_id, r.taken) for r in mixing.query(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.query(none).count() == 0
    wordless = mixing.query(docs.where("doc_id IN (1, 2, 3)")).collect()
    assert [(r.size, r.target, r.taken) for r in wordless] == [(0, 0.0, 0)] * 3
    assert set(mixing.repeated(docs).columns) == set(docs.columns)


# SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_simhash_groups_are_exact(docs, none):
    got = simhash.query(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = components_of(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert simhash.query(none).count() == 0


def clustered(n, seed):
    """Fingerprints around a few centres, some within three bits, all alike in their first quarter."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) & ~0xFFFF | 0x1234 for _ in range(n // 6)]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(16, 64)
        out.add(x)
    return sorted(out)


def _int(fp):
    return int.from_bytes(fp, "big")


@pytest.mark.parametrize(("n", "search"), [(900, simhash.Search(leaf=60)), (1000, simhash.EXACT), (900, simhash.Search(bands=1, leaf=60)), (900, simhash.Search(bands=4, radius=5)), (900, simhash.Search(sample=200, leaf=20))])
def test_trees_lose_no_link(spark, n, search):
    """Every close pair meets in a shard that the trees deal to, at any size of sample, and the links join what is close."""
    fps = clustered(n, 3)
    classes = spark.createDataFrame([(bytearray(x.to_bytes(8, "big")),) for x in fps], "fp binary").repartition(3)
    trees = simhash.grow(classes, search)
    assert len(trees) == search.bands and max(t.leaves for t in trees) >= 3
    shards = {}
    for r in simhash.deal(classes, trees).collect():
        shards.setdefault(_int(r.fp), set()).add(r.shard)
    sizes = Counter(s for own in shards.values() for s in own)
    assert len(shards) == n and min(max(size for s, size in sizes.items() if s >> 48 == b) for b in range(search.bands)) < n
    x = np.array(fps, dtype=np.uint64)
    near = {(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= search.radius) if i < j}
    assert near and all(shards[a] & shards[b] for a, b in near)
    links = {(min(_int(r.a), _int(r.b)), max(_int(r.a), _int(r.b))) for r in simhash.links(classes, search).collect()}
    assert links <= near
    assert components_of(fps, lambda a, b: (a, b) in near) == components_of(fps, lambda a, b: (a, b) in links)


def test_shards_stay_even_as_fingerprints_grow():
    rng = np.random.default_rng(2)
    largest = {}
    for n in (20_000, 200_000):
        points = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        sample = points[: 1 << 14]
        tree = simhash.Tree(sample, len(sample) / n, simhash.mask_of(0, 2), 1, 256)
        sizes = [len(at) for at, _ in tree.route(points)]
        largest[n] = max(sizes)
        assert max(sizes) < 8 * np.mean(sizes) and sum(sizes) < 12 * n
    assert largest[200_000] < 0.02 * 200_000


def test_points_that_no_split_tells_apart_are_searched():
    fps = np.unique(np.array([0] + [(1 << i) | (1 << j) for i in range(40) for j in range(40)], dtype=np.uint64))
    a, b = (np.concatenate(x) for x in zip(*simhash.links_within(fps, simhash.mask_of(0, 1), 3, 3), strict=True))
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 3 for i, j in zip(a, b, strict=True))
    pairs = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert set(components_of(range(len(fps)), lambda i, j: (i, j) in pairs).values()) == {0}


def test_deduplicated_keeps_one_of_each_group(docs, none):
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert 5 in kept and not kept & {6, 7, 8} and len(kept & {1, 2, 3}) == 1 and kept >= {4, 9, 30}
    assert simhash.deduplicated(docs).columns == docs.columns and simhash.deduplicated(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)} | {201: 200}


# Sketches


def test_fingerprints_and_edits(spark, docs, none):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = sorted((r.doc_id, r.text or "") for r in unique.collect())
    for bucket in (2048, 7):
        got = {r.doc_id: r for r in sketches.fingerprint_documents(unique, bucket).collect()}
        assert len(got) == len(want)
        for (i, t), (_, nxt) in zip(want, want[1:] + want[:1], strict=True):
            n = len(t) // 4
            changed = t[: len(t) - n] + nxt[:n]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
            assert r.fingerprint == sketches.written(sketches.sketch(t)) and r.edited_fingerprint == sketches.written(sketches.sketch(changed))
            assert r.near_next == sketches.containment(sketches.sketch(t), sketches.sketch(nxt)) and 0 <= r.near_edited <= 1
    assert got[5].near_next == 1.0 and got[5].fingerprint == got[8].fingerprint
    t, nxt = dict(want)[9], dict(want)[10]
    a, b = (set(simhash.shingles(simhash.words(x), 5)) for x in (t, sketches.edited(t, nxt)))
    assert abs(got[9].near_edited - len(a & b) / min(len(a), len(b))) < 0.03
    assert sketches.query(docs).count() == docs.count() and sketches.query(none).count() == 0
    big = [(None, "no id"), *[((1 << 62) + i, f"text number {i} of a few words more") for i in range(40)]]
    huge = sketches.fingerprint_documents(spark.createDataFrame(big, "doc_id bigint, text string"), 3).collect()
    assert {r.doc_id for r in huge} == {i for i, _ in big}
    a, b = sketches.sketch(want[8][1]), sketches.sketch(want[-1][1])
    assert sketches.containment(a, sketches.merged(a, b)) == 1.0


def brute_sketch(text):
    """The rule again, on Python sets and big integers."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    values = sorted({xxhash.xxh64_intdigest(s.encode(), 5) >> 32 for s in found})
    below = [v for v in values if v < 2**30]
    return below if len(below) >= 16 else values[:16]


def test_sketches_follow_their_rule_and_likeness_stays_within_one():
    rnd = random.Random(12)
    texts = ["", "one", "One two", *[prose(rnd, n) for n in (3, 9, 20, 21, 60, 70, 500, 3000)]]
    for t in texts:
        assert sketches.sketch(t).tolist() == brute_sketch(t)
    for i, x in enumerate(texts):
        for y in texts[i:]:
            both = set(brute_sketch(x + " # # # # # " + y))
            assert 0 <= sketches.containment(sketches.sketch(x), sketches.sketch(y)) <= 1
            assert both >= {v for v in sketches.merged(sketches.sketch(x), sketches.sketch(y)).tolist() if v < 2**30} or not x or not y or len(x.split()) < 5 or len(y.split()) < 5
    a, b = prose(rnd, 12), prose(rnd, 3)
    assert sketches.containment(sketches.sketch(a), sketches.sketch(a + " " + b)) == 1.0
    long = " ".join(map(str, np.random.default_rng(1).integers(0, 1 << 40, 2_000_000)))
    kept = sketches.sketch(long)
    assert len(np.unique(kept)) == len(kept) > 490_000 and sketches.containment(kept, kept) == 1.0


def test_neighbours_of_equal_ids_follow_their_texts(spark):
    texts = [f"text {i} of many under one id " * 3 for i in range(300)]
    rows = [(7, t) for t in texts] + [(None, t) for t in texts[:50]] + [(8, "the last")] * 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sketches.fingerprint_documents(frame, 20).collect()
    th = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, th[r[1]]))
    sha = Counter((i, hashlib.sha256(sketches.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(want, want[1:] + want[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == sha


# Neighbours


def test_neighbours_are_the_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 20)) + rng.normal(size=(10, 20))[rng.integers(0, 10, 1500)] * 2
    x[51], x[52] = x[50], x[50] * 3
    data = [(i, [float(c) for c in v], "extra") for i, v in enumerate(x)]
    data += [(1501, None, ""), (1502, [0.0] * 20, ""), (1503, [float("nan")] * 20, ""), (1504, [1.0] * 19 + [None], ""), (1550, [1.0, 2.0], ""), (None, [1.0] * 20, "")]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, score string").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for block, cell in ((4096, 1 << 15), (8, 400)):
        found = neighbours.nearest(table, F.col("id") % 50 == 0, block=block, cell=cell).collect()
        assert Counter(r.query_id for r in found) == {q: 5 for q in range(0, 1500, 50)}
        for q in range(0, 1500, 50):
            c = unit @ unit[q]
            c[q] = -9
            mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
            hits += len({m[1] for m in mine} & set(np.argsort(-c, kind="stable")[:5].tolist()))
            assert all(abs(s - c[v]) < 1e-12 for _, v, s in mine)
    assert hits >= 0.97 * 300
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 50][:2] == [51, 52]
    assert neighbours.query(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.query(few).collect()) == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]


def test_recall_over_all_rows_and_reruns(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.query(table).collect()}
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        c = unit @ unit[at]
        c[ids == ids[at]] = -9
        fifth = np.sort(c)[-5]
        mine = [found[ids[at], n] for n in range(1, 6)]
        hits += sum(s >= fifth - 1e-12 for _, s in mine)
        total += 5
    assert hits >= 0.99 * total > 0
    again = neighbours.nearest(table.repartition(7).select("vec_id", "embedding", F.lit(1).alias("id"), F.lit(2).alias("score")), F.col("id") % 50 == 0, block=16, cell=300)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in again.collect()} == found


def test_repeated_query_ids_ask_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 60, [float(c) for c in rng.normal(size=70)]) for i in range(300)]
    got = neighbours.query(spark.createDataFrame(rows + rows, "vec_id bigint, embedding array<double>").repartition(5)).collect()
    assert Counter(r.query_id for r in got) == {0: 5, 50: 5} and all(r.vec_id != r.query_id for r in got)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(r.query_id, r["rank"], r.vec_id) for r in neighbours.query(spark.createDataFrame(rows[::-1] + rows, "vec_id bigint, embedding array<double>")).collect()}


def test_bounds_hold_the_cosine():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(4000, 100)), rng.normal(size=(30, 100))
    centre, turn = np.full(100, 0.01), neighbours.rotation(100)
    codes, scalars = neighbours.encode(x, centre, turn)
    asked = neighbours.Asked(q, centre, turn)
    estimate, error = asked.bounds(codes, scalars, slice(0, 30))
    true = neighbours._unit(q)[0] @ neighbours._unit(x)[0].T
    assert np.mean(np.abs(estimate - true) <= error) > 0.99 and np.abs(estimate - true).mean() < 0.1


# Packing


def test_tokens_equal_the_tokenizers_own():
    t = tokens.WordTokenizer()
    rnd = random.Random(2)
    letters = [chr(c) for c in range(0x180)] + ["\x1c", "İ", "Σ", "\u0301", "中", "\U0001f600", "'s", "'ll", " ", " ", "<|endoftext|>", "don't "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + [prose(rnd, 3000)]
    for text, ids in zip(texts, t.ids(texts), strict=True):
        assert ids.tolist() == t.whole(text)


def test_packing_is_a_partition_with_little_padding(docs, none):
    got = packing.pack(docs, with_ids=True).collect()
    t = tokens.WordTokenizer()
    want = Counter((r.doc_id, tuple(t.whole(r.text or "") + [2])) for r in docs.collect())
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    by_doc = {k[0]: k[1] for k in want}
    for r in got:
        if want[r.doc_id, by_doc[r.doc_id]] == 1:
            ids = by_doc[r.doc_id][r.start : r.start + r.length]
            assert tuple(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes()) and r.doc_tokens == len(by_doc[r.doc_id])
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in ends.values()) and sorted(ends) == list(range(len(ends)))
    assert packing.query(none).count() == 0


def test_round_robin_keeps_to_its_shares():
    from collections import deque

    rnd = random.Random(4)
    queues = {s: deque((f"{s}{i}", rnd.randint(1, 3000)) for i in range(n)) for s, n in (("a", 300), ("b", 100), ("c", 20))}
    total = {s: sum(n for _, n in q) for s, q in queues.items()}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    served, at = Counter(), 0
    for row, _, n in packing.round_robin(queues, {}, share):
        served[row[0]] += n
        at += n
        assert all(abs(served[s] - share[s] * at) <= 4096 + 2 * 1024 for s in share)
    assert dict(served) == total


# Classifiers


def labelled(spark, n=600):
    rnd = random.Random(9)
    docs, labels = [(0, None), (1, "")], []
    for i in range(2, n):
        toxic, bad = rnd.random() < 0.2, rnd.random() < 0.3
        words = prose(rnd, rnd.randint(5, 150)).split()
        if toxic:
            words[rnd.randrange(len(words))] = "grobian" + rnd.choice(["", "isch", "o"])
        docs.append((i, (" %%% ".join(words) if bad else " ".join(words))))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.7)])
def test_classifiers_learn_from_the_other_rows_only(spark, module, label, cut):
    docs, labels = labelled(spark)
    got = module.query(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    n, rest = module.HELD_OUT
    right = [(r.predicted == truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(right) >= 0.93 * len(right) > 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest)
    held = {r.doc_id for r in got if r.held_out}
    flipped = labels.withColumn(label, F.when(F.col("doc_id").isin(list(held)), 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.query(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    assert max(r.score for r in module.query(docs, labels.limit(0)).collect()) < 0.001  # the prior
    assert module.query(docs.limit(0), labels).count() == 0


def pairs_of_words(kind, n, seed=3):
    """Texts with two marked words or not, and a label that follows from both."""
    rnd = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        a, b = (rnd.random() < 0.3, rnd.random() < 0.1) if kind == "group" else (rnd.random() < 0.5, rnd.random() < 0.5)
        words = prose(rnd, 20 if kind == "group" else 5).split() + ["mob"] * a + ["folk"] * b
        texts.append(" ".join(words))
        label = int(a != b) if kind == "either" else int(a and b)
        y.append(1 - label if kind == "group" and rnd.random() < 0.02 else label)
    return texts, np.array(y)


@pytest.mark.parametrize(("kind", "n"), [("both", 1500), ("either", 3000), ("group", 8000)])
def test_factor_terms_tell_pairs(kind, n):
    """Two words that are harmless alone and toxic together; toxic alone and harmless together (no word tells anything by itself);
    a neutral word that many texts have beside a rarer one, with wrong labels among the right ones."""
    texts, y = pairs_of_words(kind, n)
    terms = toxicity.Terms()
    model = toxicity.fit([terms.of(t) for t in texts], y)
    score = lambda t: model.score(terms.of("aba ode gil tor " + t))
    single, both = (score("mob"), score("folk")), score("mob folk")
    assert both > 0.5 > max(single) if kind != "either" else both < 0.5 < min(single)
    assert score("") < 0.5


def test_machine_scores_as_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    model = toxicity.FactorizationMachine(-0.3, rng.normal(0, 1, toxicity.TABLE), rng.normal(0, 1, (toxicity.TABLE, toxicity.FACTORS)))
    for text in ("", "one", "You are a walrus, a WALRUS and a Überwalross", prose(random.Random(1), 40)):
        rows = sorted({zlib.crc32(k) % toxicity.TABLE for w in re.findall(r"\w+", text.lower()) for k in [b"w" + w.encode()] + [b"s" + w[:n].encode() for n in (4, 5) if len(w) > n]})
        x = (1 + len(rows) / 512) ** -0.5
        z = -0.3 + sum(model.weights[i] * x for i in rows)
        z += sum(float(model.factors[i] @ model.factors[j]) * x * x for k, i in enumerate(rows) for j in rows[:k])
        assert toxicity.Terms().of(text).tolist() == rows
        assert model.score(np.array(rows, dtype=np.uint16)) == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_a_labelled_id_is_one_document(spark):
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(2, "other"), (3, None)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    rows = labelled_rows(docs, labels, "toxic", F.lit(True), {1: 1, 0: 1}, 3).collect()
    assert sorted(r.label for r in rows) == [0, 1] and {r.doc_id for r in rows if r.label} == {1}


def test_long_texts_repeats_and_other_columns_of_the_classifiers(spark):
    docs, labels = labelled(spark, 200)
    more = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(900, "word " * 400_000), (None, "no id")], "doc_id bigint, text string"))
    for module in (toxicity, quality):
        got = module.query(more.withColumns({"score": F.lit("x"), "label": F.lit("y"), "held_out": F.lit(1)}), labels).collect()
        assert len(got) == more.count() and all(0 <= r.score <= 1 for r in got)
    mine = toxicity.without_toxic(more.withColumn("_toxicity", F.lit("mine")), labels)
    assert mine.columns == ["doc_id", "text", "_toxicity"] and {r[2] for r in mine.collect()} == {"mine"}


def plain_score(params, text):
    """The network again: a loop over places, no pieces."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(2, -(-len(raw) // 256))
    data = np.concatenate((raw, np.zeros(n * 256 + 4 - len(raw), dtype=np.uint8)))
    values = np.array([sum(params["tables"][j][data[i + j]] for j in range(5)) for i in range(n * 256)])
    chunks = np.maximum(np.array([values[c * 256 : c * 256 + 512].max(axis=0) for c in range(n - 1)]) + params["shift"], 0)
    size = max(1, len(raw.tobytes().rstrip(b"\0")))
    z = np.concatenate((chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0), [np.log2(size) / 10, min(1.0, size / 512)]))
    out = np.tanh(z @ params["w1"] + params["b1"]) @ params["w2"] + params["b2"][0]
    return 1 / (1 + np.exp(-out))


def test_network_scores_as_a_plain_convolution():
    params = quality._start(np.random.default_rng(3))
    params["shift"] = params["shift"] + 0.1
    for text in ("", "a", "é" * 200, prose(random.Random(5), 300)):
        assert quality.ByteNetwork(params).score(text) == pytest.approx(plain_score(params, text), abs=1e-5)


def test_whole_texts_count():
    model = quality.fit(["good words here " * 40, "%%% " * 200] * 40, np.array([1, 0] * 40))
    long = "good words here " * 4000
    assert model.score(long) > 0.5 and model.score(long) != model.score(long + "%%% " * 2000)


# Pages


def test_page_text():
    field = html_text.default_field()
    wrong = sum(field.text(page) != "\n\n".join(texts) for page, texts in html_text.labelled_pages(150, seed=99))
    assert wrong <= 20
    page = (
        "<!DOCTYPE html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></ul></nav><div class='ad'>Buy this now please.</div>"
        "<article><h1>A title of it</h1><p>One &amp; two\n  three.<p><b>Bold words here.<br><p>Last &#233;&nbsp;one.<section class='comments'><p>Nice post you have.</p></section></article><aside class=sidebar>More to read.</aside><footer>&copy; site</footer>"
    )
    assert field.text(page) == "A title of it\n\nOne & two three.\n\nBold words here.\n\nLast é one."
    for odd in (None, "", "<", "<p", "<!--", "<script>", "</div></p>", "&#x110000;", "<a><p></a>x", "<p>" * 3000, "<div>" * 500 + "x"):
        field.text(odd)


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<article><p>Words of a text.</p></article>", "t")], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_text.query(pages.drop("text")).collect() if r.url) + [r.text for r in html_text.extract(pages).where("page_id = 2").collect()]
    assert got == [(1, "u", "", 0), (1, "u", "", 0), "Words of a text."]
    assert html_text.query(pages.limit(0)).count() == 0


def test_columns_of_the_same_names_do_not_clash(spark, docs):
    more = docs.withColumns({c: F.lit("mine") for c in ("size", "taken", "target", "th", "root", "component_id", "lane", "pii_spans", "best", "rank", "h", "ids", "n")})
    assert mixing.repeated(more).columns == more.columns and {r.taken for r in mixing.repeated(more).collect()} == {"mine"}
    assert simhash.deduplicated(more).columns == more.columns
    assert pii.mask_personal_data(more).columns == more.columns
    assert packing.pack(more).count() == packing.pack(docs).count()
    pages = spark.createDataFrame([(1, "http://example.com/en/", "x", "y")], "page_id bigint, url string, best string, r_path string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    row = url_filter.judge_urls(pages, rules).first()
    assert (row.best, row.r_path, row.rule, row.verdict) == ("x", "y", "example.com/en/", "block")


# Near-duplicates of the pipeline


def sets_of(texts, k=5):
    return {i: set(simhash.shingles(simhash.words(t or ""), k)) for i, t in texts.items()}


def kept_by_brute_force(texts):
    sets = sets_of(texts)
    return set(components_of(sorted(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])).values())


def kept(spark, texts):
    return {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string").repartition(4)).collect()}


def test_texts_of_one_fingerprint_are_checked(spark):
    rnd = random.Random(4)
    filler = "0 " * 4000
    texts = {i: filler + prose(rnd, 120) for i in range(1, 7)} | {7: ". " * 3000, 8: ". " * 3000 + prose(rnd, 90)}
    texts |= {9: texts[3], 10: texts[4] + " " + prose(rnd, 4), 11: texts[7].replace(". ", ".\n"), 12: "0 " * 9000 + texts[5].removeprefix(filler)}
    assert len({simhash.fingerprint(texts[i], 3) for i in range(1, 7)}) == 1
    assert kept(spark, texts) == kept_by_brute_force(texts) == set(range(1, 9))


def test_every_pair_on_a_shared_template_is_checked(spark):
    rnd = random.Random(8)
    template = prose(rnd, 240).split()
    texts = {}
    for i in range(1, 91):  # most pairs lie a little under 0.8, some above: a tree of the nearest has links that fail
        words = list(template)
        for at in rnd.sample(range(0, 240, 6), 5 if i % 3 else 4):
            words[at] = f"w{rnd.randrange(8)}"
        texts[i] = " ".join(words)
    want = kept_by_brute_force(texts)
    assert 5 < len(want) < 80 and kept(spark, texts) == want


def test_no_pair_is_passed_over_at_the_exact_setting(spark):
    from symgraph.llm import set_join

    far = np.array([0, (1 << 40) - 1], dtype=np.uint64)  # 40 bits apart
    i, j, n, at = np.array([0]), np.array([1]), np.array([100, 100]), np.array([0, 0])
    assert not set_join._may(i, j, n, at, far, 0.8)[0] and set_join._may(i, j, n, at, far, 0.8, 64)[0]
    rnd = random.Random(12)
    texts = []
    for _ in range(12):
        words = prose(rnd, 120).split()
        texts.append(" ".join(words))
        words[60] = "other"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = [{r.doc_id: r.component_id for r in set_join.similar_groups(docs, 0.8, 5, apart=apart).collect()} for apart in (set_join.APART, 64)]
    assert groups[0] == groups[1] == {d: d - d % 2 for d in range(24)}


def test_blocks_ends_and_repeats_are_found_as_scattered_edits_are(spark):
    rnd = random.Random(6)
    texts, kind = {}, {}
    for i in range(0, 720, 2):
        base = prose(rnd, 204).split()  # 200 shingles
        kind[i] = ("block", "cut", "added", "repeat")[i // 2 % 4]
        if kind[i] == "block":  # 22 shingles lost of each: 178 of 222 shared
            other = base[:90] + prose(rnd, 18).split() + base[108:]
        elif kind[i] == "cut":
            other = base[:-40]
        elif kind[i] == "added":
            other = base + prose(rnd, 49).split()
        else:
            other = base + base[:12] * 30
        texts[i], texts[i + 1] = " ".join(base), " ".join(other)
    assert kept(spark, texts) == kept_by_brute_force(texts) == set(range(0, 720, 2))


def test_scripts_end_at_their_own_tag_and_whole_blocks_are_read():
    article = "<article><p>First words of the article.</p><p>More words of it.</p></article>"
    for code in ("<script>for(i=0;i<n;i++){f()}</script>", "<script>if(a<b){s='it\"s'}</SCRIPT >", "<style>/* <x ' */</style>", "<select><option>a</select>", "<svg><title>t</title>"):
        texts = [b.text for b in html_text.leaf_blocks(f"<body>{code}{article}</body>")]
        assert texts[-2:] == ["First words of the article.", "More words of it."] and "f()" not in " ".join(texts)
    for tag in ("math", "object", "noscript"):
        page = f"<body><{tag}><p>Inside it.</p></{tag}><p>After it.</p>"
        assert [b.text for b in html_text.leaf_blocks(page)] == ["Inside it.", "After it."]
        assert [b.text for b in html_text.leaf_blocks(page.replace(f"</{tag}>", ""))] == ["Inside it.", "After it."]
    late = html_text.leaf_blocks("<p>" + "word " * 200 + "all rights reserved")
    assert "notice" in html_text.features(late)[0]


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, labels, seed: seen.update(zip(texts, labels.tolist(), strict=True)))
    texts = {i: f"text {i} " + "some words " * 3000 + f"end {i % 2}" for i in range(1, 9)} | {9: "short"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, quality int"))
    assert seen == {t: i % 2 for i, t in texts.items()}


def test_gradient_in_pieces_is_that_of_the_whole(monkeypatch):
    params = quality._start(np.random.default_rng(1))
    docs = [quality.blocks_of(prose(random.Random(i), 2000)) for i in range(4)]
    y, weight = np.array([0, 1, 0, 1]), np.ones(4)
    whole = quality._gradient(params, docs, y, weight)
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    pieces = quality._gradient(params, docs, y, weight)
    assert all(np.allclose(whole[k], pieces[k], atol=1e-6) for k in whole)


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        blocks = html_text.leaf_blocks("".join(f"<{t} class='c{i % 3}'>{'word ' * int(rng.integers(1, 9))}</{t}>" for i, t in enumerate(rng.choice(["p", "div", "li", "nav"], n))))
        found = html_text.features(blocks)
        field = html_text.Field({f: float(rng.normal()) for fs in found for f in fs}, rng.normal(size=(2, 2)))
        main = [sum(field.weights[f] for f in fs) for fs in found]

        def total(ys, main=main, field=field):
            return sum(m * y for m, y in zip(main, ys, strict=True)) + sum(field.moves[a, b] for a, b in zip(ys, ys[1:], strict=False))

        best = max(product((0, 1), repeat=n), key=total)
        assert total(tuple(map(int, field.decode(blocks)))) == pytest.approx(total(best))


def test_pages_of_another_make():
    """Written by hand, none by the generator of the training pages."""
    field = html_text.default_field()
    blog = """<html lang=en><head><meta charset=utf-8><title>My blog</title><script>if (a<b && c>d) { document.write("<p>no</p>"); }</script></head>
<body class="post-template"><div id="page"><header id="masthead"><h1><a href="/">My blog</a></h1><nav class="main-navigation"><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav></header>
<main id="main"><article class="post hentry"><h1 class="entry-title">How to bake bread</h1><div class="entry-content"><p>Flour, water and salt are all that you need.</p>
<p>Knead the dough for <em>ten</em> minutes, then let it rest &mdash; overnight if you can.</p><ul><li>500 g of flour</li><li>350 g of water</li></ul><p>Bake it hot.</p></div></article>
<section id="comments" class="comments-area"><h2>Two replies</h2><ol><li class="comment"><p>Great recipe, thank you!</p></li></ol></section></main>
<aside class="widget-area"><h2>Recent posts</h2><ul><li><a href="/c">How to cook rice</a></li></ul></aside><footer id="colophon">&copy; 2021 My blog. All rights reserved.</footer></div></body></html>"""
    assert field.text(blog) == "\n\n".join(["How to bake bread", "Flour, water and salt are all that you need.", "Knead the dough for ten minutes, then let it rest — overnight if you can.", "500 g of flour", "350 g of water", "Bake it hot."])
    news = """<body><div class=cookie-banner><p>We use cookies to improve this site.</p><button>Accept</button></div><div class=topnav><a href=/w>World</a> <a href=/s>Sport</a></div>
<div class=story-body><h1>Bridge opens after long delay</h1><p>The new bridge over the river opened on Monday, two years late.</p><div class=ad><p>Buy one, get one free!</p></div>
<p>Engineers said that the delay was caused by floods.</p></div><div class=footer><p>Contact us</p></div>"""
    assert field.text(news) == "\n\n".join(["Bridge opens after long delay", "The new bridge over the river opened on Monday, two years late.", "Engineers said that the delay was caused by floods."])


def test_deep_pages_take_linear_time():
    import time

    field, spent = html_text.default_field(), []
    for n in (10_000, 50_000):
        page = "".join(f"<div class=k{i}>x" for i in range(n)) + "<p>The end of it.</p>"
        began = time.perf_counter()
        assert len(html_text.leaf_blocks(page, field.known)) == n + 1
        field.text(page)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * spent[0] + 1


_A, _B = "The council met on Tuesday to discuss the new bridge over the river.", "Work will begin in spring, and traffic will be led around the old town."
_MENU = '<a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>x</title><div><article><p>{_A}</p><p>{_B}</p></article></div>", [_A, _B]),
        (f"<html><head><title>x</title>{_A}<article><p>{_B}</p></article>", [_A, _B]),
        (f"<body><div><p>{_A}</p><p>{_B}</p></div>", [_A, _B]),
        (f"<body><div>{_MENU}</div><div><p>{_A}</p><p>{_B}</p></div>", [_A, _B]),
        (f"<body><div><div><a href=/>Home</a></div><div><a href=/x>About us</a></div></div><div><p>{_A}</p><p>{_B}</p></div><div>&copy; 2020 Town News</div>", [_A, _B]),
        (f"<body><div class=row><div class=col-8><h1>A new bridge</h1><p>{_A}</p><p>{_B}</p></div></div>", ["A new bridge", _A, _B]),
        (f"<body><div class=container><div class=row><div class=col-4><ul><li><a href=/>Home</a><li><a href=/x>About</a></ul></div><div class=col-8><p>{_A}</p><p>{_B}</p></div></div></div>", [_A, _B]),
        (f"<body><div>{_A}<br><br>{_B}</div>", [_A + " " + _B]),
        (f"<body><table><tr><td>{_MENU}</td><td><p>{_A}</p><p>{_B}</p></td></tr></table>", [_A, _B]),
        (f"<body><table><tr><td>{_MENU}</td><td>{_A} {_B}</td></tr></table>", [_A + " " + _B]),
        (f"<body><table width=100%><tr><td colspan=2>{_MENU}</td></tr><tr><td><h1>A new bridge</h1>{_A}<br>{_B}</td></tr><tr><td>Copyright 2003 Town News. All rights reserved.</td></tr></table>", ["A new bridge", _A + " " + _B]),
        (f"<body><article><p>{_A}</p><p hidden>{_B}</p></article>", [_A, _B]),
        (f"<body><div style='display:none' class=cookie-notice><p>We use cookies.</p></div><article><p>{_A}</p><p>{_B}</p></article>", [_A, _B]),
        (f"<body><article><p title=it's>{_A}</p><p \">{_B}</p></article>", [_A, _B]),
        (f"<body><article><p title='a > b' data-x=a=\"b>{_A}</p><p>{_B}</p></article>", [_A, _B]),
    ],
)
def test_articles_without_names_are_found(page, want):
    assert html_text.default_field().text(page).split("\n\n") == want


@pytest.mark.parametrize("part", ['<a "', "<a x='", "<p title=", '<!-"', "<a =", "<title", '<p class="'])
def test_bad_markup_takes_linear_time(part):
    import time

    spent = []
    for size in (1 << 17, 1 << 20):
        began = time.perf_counter()
        html_text.leaf_blocks(part * (size // len(part)) + "'")
        spent.append(time.perf_counter() - began)
    assert spent[1] < 16 * spent[0] + 2


def test_tags_end_where_a_plain_walk_ends_them():
    def plain(page, at):
        value, quote = None, None
        while at < len(page):
            c = page[at]
            if quote:
                quote = None if c == quote else quote
            elif value == "before" and c in "\"'" and c in page[at + 1 :]:
                quote, value = c, None
            elif c == ">":
                return at
            elif c == "=" and value is None:
                value = "before"
            elif c.isspace():
                value = value if value == "before" else None
            else:
                value = "in" if value == "before" else value
            at += 1
        return at

    rnd = random.Random(8)
    for _ in range(5000):
        page = "".join(rnd.choice("a =\"'>") for _ in range(rnd.randint(0, 14)))
        assert html_text._Tags(page).end(0) == plain(page, 0), page


def test_repeated_rows_go_to_many_lanes(spark, monkeypatch):
    monkeypatch.setattr(packing, "LANE_TOKENS", 4096)
    docs = spark.range(0, 20_000, 1, 6).selectExpr("IF(id % 10 < 9, NULL, id) AS doc_id", "IF(id % 10 < 9, 'the same text again', concat('text ', id)) AS text", "IF(id % 10 < 9, NULL, 's') AS source")
    tokens_ = packing.tokenized(docs).withColumn("lane", F.pmod(F.xxhash64("h", "copy"), F.lit(25)))
    sizes = [r["count"] for r in tokens_.groupBy("lane").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 3 * min(sizes)
    got = packing.query(docs).select("doc_id", "length", "sequence_id", "offset").collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in ends.values())


@pytest.mark.parametrize("sources", [1, 3, 20, 400])
def test_every_window_has_its_mixture(sources):
    from collections import deque

    rnd = random.Random(sources)
    weight = [rnd.random() ** 3 + 0.002 for _ in range(sources)]
    queues = {s: deque(((s, i), rnd.randint(1, 3000)) for i in range(1 + int(20_000 / sources * w))) for s, w in enumerate(weight)}
    left = {s: sum(n for _, n in q) for s, q in queues.items()}
    sizes = {row: n for q in queues.values() for row, n in q}
    share = {s: w / sum(weight) for s, w in enumerate(weight)}
    at, by, out_at = 1000, {}, None
    pieces = {}
    for row, start, n in packing.round_robin(queues, {}, share, at):
        assert start == pieces.get(row, 0)
        pieces[row] = start + n
        for sequence, _, k in packing.cut(at, n, 1 << 60):
            by.setdefault(sequence, Counter())[row[0]] += k
            at += k
        left[row[0]] -= n
        if not left[row[0]] and out_at is None:
            out_at = at // 4096
    assert pieces == sizes
    for sequence in range(1, out_at - 1 if sources > 1 else at // 4096):  # while all queues last
        assert sum(by[sequence].values()) == 4096
        assert all(abs(by[sequence][s] - share[s] * 4096) <= 16 + 1 + 0.05 * 4096 * share[s] * (sources > 100) for s in share), sequence


def test_windows_of_documents_have_their_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = packing.pack(docs).select("source", "length", "sequence_id").collect()
    by, total = {}, Counter()
    for r in got:
        by.setdefault(r.sequence_id, Counter())[r.source] += r.length
        total[r.source] += r.length
    whole = sum(total.values())
    off = sorted(max(abs(c[s] / 4096 - total[s] / whole) for s in total) for c in by.values() if sum(c.values()) == 4096)
    assert off[len(off) // 2] <= 0.02, off


def test_windows_of_all_lanes_keep_to_the_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "LANE_TOKENS", 1 << 15)
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randint(1, 400)), "abbccccc"[i % 8]) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("source", "length", "sequence_id").collect()
    total, by = Counter(), {}
    for r in got:
        total[r.source] += r.length
        by.setdefault(r.sequence_id, Counter())[r.source] += r.length
    whole, served, at = sum(total.values()), Counter(), 0
    for sequence in sorted(by):  # deficits carry over windows and lanes: what each source had so far stays near its share
        served.update(by[sequence])
        at += sum(by[sequence].values())
        assert all(abs(served[s] - total[s] / whole * at) <= 3 * 4096 for s in total)


def test_many_sources_are_mixed_without_one_task(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id % 7 as int)) AS text", "concat('s', id % 20000) AS source")
    targets = mixing.source_targets(mixing.sized(docs))
    want = brute_targets({r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()})
    got = {r.source: r.target for r in targets.collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    mixed = mixing.query(docs)
    assert mixed.count() == 40_000 and mixed.where("taken > 2 * size").count() == 0


def test_rows_of_lists_reach_all_that_may_be_similar():
    from symgraph.llm import set_join

    r = np.random.default_rng(1)
    for _ in range(200):
        m, span = int(r.integers(1, 60)), int(r.integers(0, 8))
        s, n = np.sort(r.integers(0, 4, m)), r.integers(1, 60, m)
        order = np.lexsort((n, s))
        s, n = s[order], n[order]
        at = np.array([int(r.integers(0, x - int(set_join._least(x, 0.8)) + 1)) for x in n], dtype=np.int32)
        end, left = set_join._reach(s, n, at, span, 0.8)
        for i in range(m):
            for j in range(i + 1, m):
                if s[i] == s[j] and set_join._may(np.array([i]), np.array([j]), n, at, np.zeros(m, dtype=np.uint64), 0.8)[0]:
                    assert j < end[i] and (j - i <= span or (left[i] and left[j]))
