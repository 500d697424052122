"""The engine's queries over the adapter views, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import text as tx
from symgraph.operators import ann, context, evaluate, explore, fusion, graph, incremental, lexical, relink, resolve, segments, vector
from symgraph.plans import fixtures, indexes
from symgraph.plans.views import SQL, Views
from symgraph.session import materialize

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: What the search queries ask for: terms, symbols, vectors.
TERMS = ["the", "of", "that", "idiot", "von", "licensed", "under", "que"]
SYMBOL_TERMS = ["doc_17", "doc_42", "doc_101"]
VECTOR_IDS = (3, 11, 19)
_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: lower(t))"


def _query(sql: str | None = None, views: bool = True, recursive: bool = False) -> Callable:
    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            head = ("WITH RECURSIVE " if recursive else "WITH ") + SQL.strip()
            _SQL[f.__name__] = f"{head}\n{sql}" if views else sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, sf_dir) -> DataFrame."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL."""
    return dict(_SQL)


def _literal(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# Scans and text


@_query("SELECT repo_url, filepath, symbol, chunk_type, start_line, end_line, length(code_text) AS chars FROM chunks_v WHERE repo_url = 'src1'")
def scan_chunks_by_repo(v: Views) -> DataFrame:
    return v.chunks().where("repo_url = 'src1'").select("repo_url", "filepath", "symbol", "chunk_type", "start_line", "end_line", F.length("code_text").alias("chars"))


@_query(
    rf"""SELECT item_id, coalesce(string_agg(term, ' ' ORDER BY first_at) FILTER (WHERE rn <= {tx.MOST_TERMS}), '') AS terms FROM (
  SELECT item_id, term, min(i) AS first_at, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS rn FROM (
    SELECT item_id, unnest({_TOKENS.format("text")}) AS term, generate_subscripts({_TOKENS.format("text")}, 1) AS i FROM benchmark)
  WHERE length(term) >= 2 AND term NOT IN {_literal(tx.STOPWORDS)} GROUP BY item_id, term) GROUP BY item_id""",
    views=False,
)
def extract_terms(v: Views) -> DataFrame:
    rows = v.table("benchmark").select("item_id", tx.search_terms(F.array("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("item_id", F.array_join("t", " ").alias("terms"))


@_query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOKENS.format('code_text')}) AS term FROM chunks_v) GROUP BY term")
def tokenize_counts(v: Views) -> DataFrame:
    rows = v.chunks().select("doc_id", F.explode(tx.tokens(F.col("code_text"))).alias("term"))
    # count a document's terms first: what is shuffled twice is one row a term and document, not one a token
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@_query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', ''), '/+$', '') AS address FROM pages", views=False)
def normalize_urls(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", tx.repository_address(F.col("url")).alias("address"))


@_query("SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS sha FROM documents", views=False)
def blob_sha(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", tx.blob_sha(F.col("text")).alias("sha"))


@_query(" SELECT r.ord, c.filepath, c.symbol, length(c.code_text) AS chars FROM (SELECT item_id AS ord, item_id * 3 AS doc_id FROM benchmark) r JOIN chunks_v c ON c.doc_id = r.doc_id")
def chunk_points(v: Views) -> DataFrame:
    refs = v.table("benchmark").select(F.col("item_id").alias("ord"), (F.col("item_id") * 3).alias("doc_id"))
    return refs.join(v.chunks(), "doc_id").select("ord", "filepath", "symbol", F.length("code_text").alias("chars"))


@_query(" SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS first, round(embedding[24]::DOUBLE, 4) AS last FROM embeddings")
def vector_fingerprint(v: Views) -> DataFrame:
    kept = vector.fingerprint(F.col("embedding"))
    return v.table("embeddings").select("vec_id", F.get(kept, F.lit(0)).alias("first"), F.get(kept, F.lit(23)).alias("last"))


# Search


_POSTINGS = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, unnest({_TOKENS.format(f)}) AS term FROM chunks_v" for f in lexical.FIELDS)


@_query(f", p AS (SELECT doc_id, field, term, count(*) AS tf FROM ({_POSTINGS}) GROUP BY ALL) SELECT field, count(*) AS postings, sum(tf)::BIGINT AS tokens, count(DISTINCT term) AS terms FROM p GROUP BY field")
def inverted_index(v: Views) -> DataFrame:
    # count by term first: partial counts leave a task as its vocabulary, not its postings
    terms = lexical.indexed(v.chunks()).groupBy("field", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    return terms.groupBy("field").agg(F.sum("n").alias("postings"), F.sum("tf").alias("tokens"), F.count("*").alias("terms"))


@_query(f" SELECT filepath, {' + '.join(f'len({_TOKENS.format(f)})' for f in lexical.FIELDS)} AS dl FROM chunks_v")
def document_lengths(v: Views) -> DataFrame:
    return v.chunks().select("filepath", lexical.length().alias("dl"))


_INDEXES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _bm25(v: Views, terms: list[str], fields: tuple[str, ...] = tuple(lexical.FIELDS)) -> DataFrame:
    """BM25 over the persisted index of a data folder: written once a session, then only its terms' postings are read."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.written(v.chunks())
    return lexical.bm25(*_INDEXES[key], terms, fields)


def _bm25_sql(terms: list[str], fields: tuple[str, ...], name: str = "bm25") -> str:
    each = " UNION ALL ".join(f"SELECT filepath, symbol, start_line, {lexical.FIELDS[f]} AS w, unnest({_TOKENS.format(f)}) AS term FROM chunks_v" for f in fields)
    dl = " + ".join(f"len({_TOKENS.format(f)})" for f in lexical.FIELDS)
    return f"""
{name}_len AS (SELECT filepath, symbol, start_line, {dl} AS dl FROM chunks_v),
{name}_stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len),
{name}_tf AS (SELECT filepath, symbol, start_line, term, sum(w) AS tf FROM ({each}) WHERE term IN {_literal(terms)} GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_top AS (SELECT filepath, symbol, start_line, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * dl / avgdl))), 9) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_len USING (filepath, symbol, start_line), {name}_stat GROUP BY ALL ORDER BY score DESC, filepath, symbol, start_line LIMIT {lexical.LIMIT}),
{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, filepath, symbol, start_line) AS rank FROM {name}_top)"""


_ALL = tuple(lexical.FIELDS)


@_query("," + _bm25_sql(TERMS, _ALL) + " SELECT filepath, symbol, start_line, round(score, 6) AS score, rank FROM bm25")
def bm25_search(v: Views) -> DataFrame:
    return _bm25(v, TERMS).withColumn("score", F.round("score", 6))


@_query("," + _bm25_sql(SYMBOL_TERMS, ("symbol",)) + " SELECT filepath, symbol, start_line, round(score, 6) AS score, rank FROM bm25")
def bm25_symbol_field(v: Views) -> DataFrame:
    return _bm25(v, SYMBOL_TERMS, ("symbol",)).withColumn("score", F.round("score", 6))


_MIXED = [*SYMBOL_TERMS, *TERMS[:4]]


@_query(
    "," + _bm25_sql(_MIXED, _ALL) + f""" SELECT filepath, symbol, start_line, round(score, 6) AS score, symbol IN {_literal(_MIXED)} AS is_exact,
  row_number() OVER (ORDER BY symbol IN {_literal(_MIXED)} DESC, rank) AS rank FROM bm25"""
)
def bm25_exact_symbol_first(v: Views) -> DataFrame:
    return lexical.exact_first(_bm25(v, _MIXED), _MIXED).withColumn("score", F.round("score", 6))


def _segments(v: Views, edited: bool) -> segments.SegmentedIndex:
    """The segmented index of a data folder: of all chunks by one run, or of the stored files by one run and what has changed since by another."""

    def build(path: str) -> None:
        index, chunks = segments.SegmentedIndex(v.spark, path), v.chunks()
        none = chunks.select("repo_url", "filepath").limit(0)
        if not edited:
            index.apply(chunks, none)
            return
        index.apply(chunks.where("doc_id % 10 <> 0"), none)
        now, then = v.file_state()
        changes = materialize(incremental.plan_changes(now, then).where("change <> 'unchanged'").withColumnRenamed("path", "filepath"), "edits")
        text = F.when(F.col("doc_id") % 7 == 0, F.concat("code_text", F.lit(" changed"))).otherwise(F.col("code_text"))
        fresh = chunks.withColumn("code_text", text).join(changes.where("change <> 'deleted'"), "filepath", "left_semi")
        index.apply(fresh, changes.join(chunks, "filepath").select("repo_url", "filepath"))

    name = "segments-edited" if edited else "segments"
    path = indexes.kept(v.spark, name, [v.table("documents")], lambda path: (build(f"{path}/index"), v.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/built")), "built")
    return segments.SegmentedIndex(v.spark, f"{path}/index")


@_query("," + _bm25_sql(TERMS, _ALL) + " SELECT filepath, symbol, start_line, round(score, 6) AS score, rank FROM bm25")
def bm25_block_max(v: Views) -> DataFrame:
    return _segments(v, edited=False).search(TERMS).withColumn("score", F.round("score", 6))


_EDITED = ", edited_v AS (SELECT c.* REPLACE (u.body AS code_text) FROM chunks_v c JOIN current_v u ON u.path = c.filepath)"


@_query(_EDITED + "," + _bm25_sql([*_MIXED, "changed"], _ALL).replace("chunks_v", "edited_v") + " SELECT filepath, symbol, start_line, round(score, 6) AS score, rank FROM bm25")
def bm25_after_edits(v: Views) -> DataFrame:
    return _segments(v, edited=True).search([*_MIXED, "changed"]).withColumn("score", F.round("score", 6))


_COS = "round(list_dot_product(p.vector::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9)"


def _vector_sql(ids: tuple[int, ...], limit: int = vector.LIMIT, where: str = "TRUE", name: str = "vec") -> str:
    return f"""
{name}_all AS (SELECT q.vec_id AS query_id, p.filepath, p.symbol, p.start_line, {_COS} AS score FROM points_v p, embeddings q WHERE q.vec_id IN ({", ".join(map(str, ids))}) AND {where}),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filepath, symbol, start_line) AS rank FROM {name}_all),
{name} AS (SELECT * FROM {name}_rank WHERE rank <= {limit})"""


_HIT = "filepath, symbol, start_line, round(score, 6) AS score, rank"


@_query("," + _vector_sql((7,)) + f" SELECT {_HIT} FROM vec")
def vector_topk(v: Views) -> DataFrame:
    return vector.search(v.points(), v.query_vectors(7)).select("filepath", "symbol", "start_line", F.round("score", 6).alias("score"), "rank")


@_query("," + _vector_sql((7,), where="repo_url = 'src7'").replace("SELECT * FROM vec_rank WHERE", f"SELECT * FROM vec_rank WHERE score >= {vector.THRESHOLD} AND") + f" SELECT {_HIT} FROM vec")
def vector_topk_threshold(v: Views) -> DataFrame:
    hits = vector.search(v.points(), v.query_vectors(7), repo_url="src7", threshold=vector.THRESHOLD)
    return hits.select("filepath", "symbol", "start_line", F.round("score", 6).alias("score"), "rank")


@_query("," + _vector_sql(VECTOR_IDS) + f" SELECT query_id, {_HIT} FROM vec")
def vector_multi_query(v: Views) -> DataFrame:
    return vector.search(v.points(), v.query_vectors(*VECTOR_IDS)).select("query_id", "filepath", "symbol", "start_line", F.round("score", 6).alias("score"), "rank")


def _vector_index(v: Views) -> str:
    """The ANN index of the vectors of a data folder; built again when a file of theirs changes."""
    return indexes.kept(v.spark, "vectors", [v.table("embeddings"), v.table("documents")], lambda path: ann.build(v.points(), path), "model")


@_query()
def vector_index_topk(v: Views) -> DataFrame:
    """The nearest points of every fiftieth vector by the index; without SQL, as it may miss some (tested: 95 of 100 are found)."""
    asked = v.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.search(v.spark, _vector_index(v), asked).select("query_id", "filepath", "symbol", "start_line", F.round("score", 6).alias("score"), "rank")


@_query("," + _vector_sql(VECTOR_IDS) + f" SELECT query_id, {_HIT} FROM vec")
def vector_index_certain(v: Views) -> DataFrame:
    hits = ann.search(v.spark, _vector_index(v), v.query_vectors(*VECTOR_IDS), certain=True)
    return hits.select("query_id", "filepath", "symbol", "start_line", F.round("score", 6).alias("score"), "rank")


def _lists(v: Views) -> DataFrame:
    key = ["filepath", "symbol", "start_line", "rank", "score"]
    number = F.create_map(*[F.lit(x) for i, q in enumerate(VECTOR_IDS) for x in (q, i)])
    a = vector.search(v.points(), v.query_vectors(*VECTOR_IDS)).select(number[F.col("query_id").cast("int")].alias("list_id"), F.lit("vector").alias("source"), *key)
    b = _bm25(v, TERMS).select(F.lit(len(VECTOR_IDS)).alias("list_id"), F.lit("bm25").alias("source"), *key)
    return a.unionByName(b)


_N_LISTS = len(VECTOR_IDS) + 1
_CASE = " ".join(f"WHEN {q} THEN {i}" for i, q in enumerate(VECTOR_IDS))
_RRF = f""",{_vector_sql(VECTOR_IDS)},{_bm25_sql(TERMS, _ALL)},
lists AS (SELECT CASE query_id {_CASE} END AS list_id, 'vector' AS source, filepath, symbol, start_line, rank, score FROM vec
  UNION ALL SELECT {len(VECTOR_IDS)}, 'bm25', filepath, symbol, start_line, rank, score FROM bm25),
fused AS (SELECT filepath, symbol, start_line, round(sum(1.0::DOUBLE / ({fusion.RRF_K} + rank)), 12) AS rrf_score, min(list_id * 1000 + rank) AS first_at,
    CASE WHEN min(list_id) FILTER (WHERE source = 'vector') IS NULL THEN 'bm25' WHEN min(list_id) FILTER (WHERE source = 'bm25') IS NULL THEN 'vector' ELSE 'vector,bm25' END AS sources,
    max(score) FILTER (WHERE source = 'vector') AS vector_score, max(score) FILTER (WHERE source = 'bm25') AS bm25_score FROM lists GROUP BY ALL),
hybrid AS (SELECT * EXCLUDE (first_at), rrf_score / ({_N_LISTS} / {fusion.RRF_K + 1}.0::DOUBLE) AS score, row_number() OVER (ORDER BY rrf_score DESC, first_at) AS rank FROM fused)"""
_FUSED = "filepath, symbol, start_line, round(rrf_score, 6) AS rrf_score, round(score, 6) AS score, sources, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, rank"


def _fused(lists: DataFrame) -> DataFrame:
    return fusion.reciprocal_rank_fusion(lists, _N_LISTS).withColumn("sources", F.array_join("sources", ","))


def _shown(df: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return df.select("filepath", "symbol", "start_line", r("rrf_score"), r("score"), "sources", r("vector_score"), r("bm25_score"), "rank")


@_query(_RRF + f" SELECT {_FUSED} FROM hybrid")
def rrf_fuse(v: Views) -> DataFrame:
    return _shown(_fused(_lists(v)))


@_query(_RRF + f" SELECT {_FUSED} FROM hybrid WHERE rank <= {fusion.CANDIDATES}")
def hybrid_search(v: Views) -> DataFrame:
    return _shown(_fused(_lists(v)).where(F.col("rank") <= fusion.CANDIDATES))


_QUESTION = "the licensed text of idiot von"
_OVERLAP = "(" + " + ".join(f"CASE WHEN contains(lower(c.symbol || ' (' || c.chunk_type || ') in ' || c.filepath || chr(10) || array_to_string(list_slice(string_split(rtrim(c.code_text, chr(10)), chr(10)), 1, {fusion.PASSAGE_LINES}), chr(10))), '{w}') THEN 1.0::DOUBLE ELSE 0 END" for w in sorted(set(_QUESTION.split()))) + f") / {len(set(_QUESTION.split()))}"
_RERANK = f"""{_RRF}, cand AS (SELECT h.*, {_OVERLAP} AS rerank_score FROM hybrid h JOIN chunks_v c USING (filepath, symbol, start_line) WHERE h.rank <= {fusion.CANDIDATES}),
reranked AS (SELECT filepath, symbol, start_line, rank AS retrieval_rank, score AS retrieval_score, rerank_score, round({fusion.RERANK_WEIGHT} * rerank_score + {1 - fusion.RERANK_WEIGHT} * score, 9) AS score FROM cand),
kept AS (SELECT *, row_number() OVER (ORDER BY score DESC, retrieval_rank) AS rank FROM reranked)"""


def _reranked(v: Views, fused: DataFrame, top_k: int) -> DataFrame:
    top = fused.where(F.col("rank") <= fusion.CANDIDATES)
    code = v.chunks().select("filepath", "symbol", "start_line", "chunk_type", "code_text")
    hits = code.join(F.broadcast(top), ["filepath", "symbol", "start_line"])  # 24 hits: texts are fetched only for them
    passage = fusion.passage(F.col("symbol"), F.col("chunk_type"), F.col("filepath"), F.col("code_text"))
    return fusion.rerank(hits, fusion.word_overlap(_QUESTION)(passage), top_k)


@_query(_RERANK + f" SELECT filepath, symbol, retrieval_rank, round(rerank_score, 6) AS rerank_score, round(score, 6) AS score, rank FROM kept WHERE rank <= {fusion.KEPT}")
def rerank_blend(v: Views) -> DataFrame:
    return _reranked(v, _fused(_lists(v)), fusion.KEPT).select("filepath", "symbol", "retrieval_rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"), "rank")


@_query(
    _RERANK
    + f""" SELECT 'candidates' AS stage, count(*) AS hits FROM lists UNION ALL SELECT 'fused', count(*) FROM hybrid
  UNION ALL SELECT 'reranked', count(*) FROM kept UNION ALL SELECT 'kept', count(*) FROM kept WHERE rank <= {fusion.KEPT}"""
)
def candidate_funnel(v: Views) -> DataFrame:
    stage = lambda name, df: df.agg(F.lit(name).alias("stage"), F.count("*").alias("hits"))
    lists = materialize(_lists(v), "lists")  # a few dozen rows, as what follows from them: each step is made once and counted
    fused = materialize(_fused(lists), "fused")
    last = materialize(_reranked(v, fused, fusion.CANDIDATES), "reranked")
    out = stage("candidates", lists).unionByName(stage("fused", fused)).unionByName(stage("reranked", last))
    return out.unionByName(stage("kept", last.where(F.col("rank") <= fusion.KEPT)))


@_query(
    """SELECT conv_id, ord, query FROM (SELECT conv_id, query, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) AS ord FROM (
  SELECT conv_id, arg_min(trim(text, ' '), turn) AS query, min(turn) AS first_at FROM conversations WHERE role = 'user' AND length(trim(text, ' ')) > 0 GROUP BY conv_id, lower(trim(text, ' ')))) WHERE ord <= 3""",
    views=False,
)
def search_queries_merge(v: Views) -> DataFrame:
    return fusion.merged_queries(v.table("conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("ord"), F.col("text").alias("query")))


_TYPES = ["symbol_lookup", "implementation", "call_flow", "impact", "dependency", "architecture", "bug_analysis", "general"]


@_query(
    f"SELECT strategy, count(*) AS n FROM (SELECT CASE t WHEN 0 THEN 'vector' WHEN 1 THEN 'vector' WHEN 2 THEN 'graph' WHEN 3 THEN 'graph' WHEN 7 THEN 'vector' ELSE 'hybrid' END AS strategy FROM (SELECT (conv_id + turn) % {len(_TYPES)} AS t FROM conversations)) GROUP BY strategy",
    views=False,
)
def retrieval_router(v: Views) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), ((F.col("conv_id") + F.col("turn")) % len(_TYPES) + 1).cast("int"))
    return v.table("conversations").select(fusion.strategy(kind).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


# Symbols and the graph

_SYMBOL = "filepath, qualified_name, name, type, start_line, end_line"


@_query(f"SELECT {_SYMBOL} FROM symbols_v WHERE name = 'Brand#23' OR qualified_name = 'Brand#23' ORDER BY filepath, qualified_name LIMIT 10")
def find_symbols_bare(v: Views) -> DataFrame:
    return graph.find(v.symbols(), "Brand#23").select(*_SYMBOL.split(", "))


@_query(f"SELECT {_SYMBOL} FROM symbols_v WHERE qualified_name = (SELECT max(qualified_name) FROM methods_v WHERE owner = 'c7')")
def find_symbols_qualified(v: Views) -> DataFrame:
    name = v.methods().where("owner = 'c7'").agg(F.max("qualified_name")).first()[0] or "none.none"
    return graph.find(v.symbols(), name).select(*_SYMBOL.split(", "))


@_query(
    """SELECT filepath, line, qualified_name, type FROM (SELECT p.filepath, p.line, s.qualified_name, s.type,
  row_number() OVER (PARTITION BY p.filepath, p.line ORDER BY s.end_line - s.start_line, s.start_line DESC, s.qualified_name) AS rn
  FROM (SELECT 'cls_' || s_suppkey || '.py' AS filepath, (s_suppkey * 100 + 3 + s_suppkey % 50)::INT AS line FROM supplier) p
  JOIN symbols_v s ON p.filepath = s.filepath AND p.line BETWEEN s.start_line AND s.end_line) WHERE rn = 1"""
)
def symbol_at_line(v: Views) -> DataFrame:
    key = F.col("s_suppkey")
    places = v.table("supplier").select(F.concat(F.lit("cls_"), key.cast("string"), F.lit(".py")).alias("filepath"), (key * 100 + 3 + key % 50).cast("int").alias("line"))
    return graph.at_line(v.symbols(), places).select("filepath", "line", "qualified_name", "type")


def _bfs_sql(edges: str, start: str, depth: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f""", walk(start, node, hops) AS (SELECT {a}, {b}, 1 FROM {edges} WHERE {a} IN {start} UNION SELECT w.start, e.{b}, w.hops + 1 FROM walk w JOIN {edges} e ON e.{a} = w.node WHERE w.hops < {depth}),
reached AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY start, node)"""


_STARTS = ["f17", "f3", "f100"]


@_query(_bfs_sql("calls_v", _literal(_STARTS), 3) + " SELECT * FROM reached", recursive=True)
def callees_depth3(v: Views) -> DataFrame:
    starts = v.symbols().where(F.col("node").isin(_STARTS)).select("node")
    return graph.reach(graph.of_type(v.calls(), "CALLS"), starts, 3)


@_query(_bfs_sql("calls_v", _literal(_STARTS), 3, True) + " SELECT * FROM reached", recursive=True)
def callers_depth3(v: Views) -> DataFrame:
    starts = v.symbols().where(F.col("node").isin(_STARTS)).select("node")
    return graph.reach(graph.reversed_(graph.of_type(v.calls(), "CALLS")), starts, 3)


@_query(
    _bfs_sql("calls_v", _literal(_STARTS), 2)
    + """ SELECT start, hops, filepath, qualified_name, rn, total FROM (SELECT r.*, s.filepath, s.qualified_name, count(*) OVER (PARTITION BY start) AS total,
  row_number() OVER (PARTITION BY start ORDER BY hops, s.filepath, s.qualified_name) AS rn FROM reached r JOIN symbols_v s USING (node)) WHERE rn <= 15""",
    recursive=True,
)
def neighbours_with_total(v: Views) -> DataFrame:
    matches = v.symbols().where(F.col("node").isin(_STARTS))
    return graph.neighbours(v.symbols(), graph.of_type(v.calls(), "CALLS"), matches, 2, 15).select("start", "hops", "filepath", "qualified_name", "rn", "total")


@_query(
    _bfs_sql("calls_v", "(SELECT node FROM symbols_v WHERE type = 'function' AND filepath = 'mod_7.py')", 2)
    + """, cut AS (SELECT * FROM (SELECT r.start, r.hops, s.qualified_name, row_number() OVER (PARTITION BY r.start ORDER BY r.hops, s.qualified_name, s.filepath) AS rn FROM reached r JOIN symbols_v s USING (node)) WHERE rn <= 10),
anchors AS (SELECT * FROM symbols_v WHERE type = 'function' AND filepath = 'mod_7.py' ORDER BY filepath, qualified_name LIMIT 15)
SELECT a.qualified_name, a.filepath, a.type, coalesce(string_agg(c.qualified_name || ':' || c.hops, ',' ORDER BY c.rn), '') AS calls FROM anchors a LEFT JOIN cut c ON c.start = a.node GROUP BY ALL""",
    recursive=True,
)
def symbol_context(v: Views) -> DataFrame:
    anchors = v.symbols().where("type = 'function' AND filepath = 'mod_7.py'").orderBy("filepath", "qualified_name").limit(15)
    found = graph.neighbours(v.symbols(), graph.of_type(v.calls(), "CALLS"), anchors, 2, 10, ("hops", "qualified_name", "filepath"))
    # at most ten neighbours of each anchor are listed
    listed = F.transform(F.array_sort(F.collect_list(F.struct("hops", "qualified_name", "filepath"))), lambda x: F.concat(x["qualified_name"], F.lit(":"), x["hops"].cast("string")))
    calls = found.groupBy("start").agg(F.array_join(listed, ",").alias("calls"))
    return anchors.join(calls, anchors.node == calls.start, "left").select("qualified_name", "filepath", "type", F.coalesce("calls", F.lit("")).alias("calls"))


@_query("SELECT owner, count(*) AS methods, min(qualified_name) AS first_method, count(DISTINCT name) AS names FROM methods_v GROUP BY owner")
def class_members(v: Views) -> DataFrame:
    return v.methods().groupBy("owner").agg(F.count("*").alias("methods"), F.min("qualified_name").alias("first_method"), F.countDistinct("name").alias("names"))


@_query(
    """SELECT s.node, s.qualified_name, coalesce(b.bases, '') AS bases, coalesce(c.subclasses, '') AS subclasses FROM symbols_v s
  LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS bases FROM inherits_v GROUP BY src) b ON b.src = s.node
  LEFT JOIN (SELECT dst, string_agg(src, ',' ORDER BY src) FILTER (WHERE rn <= 10) AS subclasses FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM inherits_v) GROUP BY dst) c ON c.dst = s.node
WHERE s.type = 'class'"""
)
def bases_and_subclasses(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    up = v.inherits()
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    bases = up.groupBy("src").agg(joined("dst").alias("bases"))
    few = up.withColumn("rn", F.row_number().over(W.partitionBy("dst").orderBy("src"))).where("rn <= 10")
    subs = few.groupBy("dst").agg(joined("src").alias("subclasses"))
    s = v.symbols().where("type = 'class'")
    out = s.join(bases, s.node == bases.src, "left").join(subs, s.node == subs.dst, "left")
    return out.select("node", "qualified_name", F.coalesce("bases", F.lit("")).alias("bases"), F.coalesce("subclasses", F.lit("")).alias("subclasses"))


_CLOSURE = """, up(cls, ancestor, level) AS (SELECT src, dst, 1 FROM inherits_v UNION ALL SELECT u.cls, i.dst, u.level + 1 FROM up u JOIN inherits_v i ON i.src = u.ancestor WHERE u.level < 5),
over_v AS (SELECT a.node AS method, b.node AS overridden, min(level) AS level FROM methods_v a JOIN up ON up.cls = a.owner JOIN methods_v b ON b.owner = up.ancestor AND b.name = a.name GROUP BY ALL)"""


@_query(_CLOSURE + " SELECT method, overridden, level FROM over_v", recursive=True)
def overrides(v: Views) -> DataFrame:
    return graph.overrides(v.methods(), graph.of_type(v.inherits(), "INHERITS"))


@_query(_CLOSURE + " SELECT overridden, method, level FROM (SELECT *, row_number() OVER (PARTITION BY overridden ORDER BY level, method) AS rn FROM over_v) WHERE rn <= 10", recursive=True)
def overridden_by(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    found = graph.overrides(v.methods(), graph.of_type(v.inherits(), "INHERITS"))
    order = W.partitionBy("overridden").orderBy("level", "method")
    return found.withColumn("rn", F.row_number().over(order)).where("rn <= 10").select("overridden", "method", "level")


def _impact_sql(targets: str, depth: int, most: int, over: bool = False) -> str:
    """The level-by-level search, a pair of table expressions a level."""
    parts = [f", seen0 AS (SELECT node FROM ({targets}))"]
    labels = "CASE relation WHEN 'CALLS' THEN 'calls' WHEN 'INHERITS' THEN 'subclasses' ELSE 'overrides' END"
    for h in range(1, depth + 1):
        seen = " UNION ALL ".join(["SELECT node FROM seen0", *[f"SELECT node FROM lv{i}" for i in range(1, h)]])
        before = "seen0" if h == 1 else f"lv{h - 1}"
        more = " UNION ALL SELECT 'OVERRIDES', method, overridden FROM over_v" if over and h == 1 else ""
        parts.append(f"""lv{h} AS (SELECT node, relation, via_filepath, via_name, late, {h} AS hops FROM (
  SELECT d.node, d.relation, v.filepath AS via_filepath, v.qualified_name AS via_name, d.relation <> 'OVERRIDES' AS late,
    row_number() OVER (PARTITION BY d.node ORDER BY v.filepath, v.qualified_name, d.relation <> 'OVERRIDES', d.relation) AS rn
  FROM (SELECT type AS relation, src AS node, dst AS via FROM edges_v WHERE type IN ('CALLS', 'INHERITS'){more}) d JOIN {before} b ON b.node = d.via JOIN symbols_v v ON v.node = d.via
  WHERE d.node NOT IN ({seen})) WHERE rn = 1)""")
    union = " UNION ALL ".join(f"SELECT * FROM lv{h}" for h in range(1, depth + 1))
    parts.append(f"every AS (SELECT l.*, s.filepath, s.qualified_name, s.type FROM ({union}) l JOIN symbols_v s USING (node))")
    parts.append(f"""affected AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY hops, via_filepath, via_name, late, relation, filepath, qualified_name) AS ord, hops, {labels} AS relation,
  via_filepath, via_name, filepath, qualified_name, type, (SELECT count(*) FROM every) > {most} AS truncated FROM every) WHERE ord <= {most})""")
    return ",\n".join(parts)


def _tables(v: Views) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges, written once as an engine's tables are: a search reads them at every level."""
    return materialize(v.symbols(), "symbols"), materialize(v.edges(), "edges")


def _impact(v: Views, targets: DataFrame, most: int, overriding: DataFrame | None = None) -> DataFrame:
    return graph.impact(*_tables(v), targets.select("node"), 3, most, overriding)


_TARGET = "SELECT node FROM symbols_v WHERE qualified_name = 'fn_17'"


@_query(_impact_sql(_TARGET, 3, 300) + " SELECT * FROM affected")
def impact_blast_radius(v: Views) -> DataFrame:
    return _impact(v, graph.find(v.symbols(), "fn_17"), 300)


@_query(_impact_sql(_TARGET, 3, 300) + " SELECT filepath, count(*) AS n, min(hops) AS nearest_hops, string_agg(qualified_name, ',' ORDER BY hops, qualified_name) AS symbols FROM affected GROUP BY filepath")
def impact_by_file(v: Views) -> DataFrame:
    return graph.by_file(_impact(v, graph.find(v.symbols(), "fn_17"), 300))


@_query(_impact_sql(_TARGET, 3, 5) + " SELECT * FROM affected")
def impact_truncated(v: Views) -> DataFrame:
    return _impact(v, graph.find(v.symbols(), "fn_17"), 5)


_METHODS = "SELECT node FROM (SELECT node FROM methods_v WHERE owner = 'c3' ORDER BY qualified_name LIMIT 3) UNION ALL SELECT 'c3'"


@_query(_CLOSURE + _impact_sql(_METHODS, 3, 300, over=True) + " SELECT * FROM affected", recursive=True)
def constructor_impact(v: Views) -> DataFrame:
    some = v.methods().where("owner = 'c3'").orderBy("qualified_name").limit(3).select("node")
    owner = v.symbols().where("node = 'c3'").select("node")
    targets = materialize(some.union(owner), "targets")
    return _impact(v, targets, 300, graph.overriding(targets, v.methods(), graph.of_type(v.inherits(), "INHERITS")))


_TOP = """, ends AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges_v UNION ALL SELECT dst FROM edges_v) GROUP BY node),
top AS (SELECT s.node, s.qualified_name, coalesce(degree, 0) AS degree FROM symbols_v s LEFT JOIN ends USING (node) ORDER BY degree DESC, s.qualified_name LIMIT 50)"""


@_query(_TOP + " SELECT * FROM top")
def repo_graph_nodes(v: Views) -> DataFrame:
    return graph.top_degree(v.symbols(), v.edges(), 50)


@_query(_TOP + " SELECT type, src, dst FROM edges_v WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def repo_graph_edges(v: Views) -> DataFrame:
    return graph.within(v.edges(), graph.top_degree(v.symbols(), v.edges(), 50)).select("type", "src", "dst")


@_query("SELECT repo_url, count(*) AS symbols, max(doc_id) AS last_indexed FROM chunks_v GROUP BY repo_url")
def list_repositories(v: Views) -> DataFrame:
    return v.chunks().groupBy("repo_url").agg(F.count("*").alias("symbols"), F.max("doc_id").alias("last_indexed"))


@_query("SELECT (SELECT count(*) FROM symbols_v) AS symbols, (SELECT count(*) FROM calls_v) AS calls, (SELECT count(*) FROM inherits_v) AS inherits")
def count_repository(v: Views) -> DataFrame:
    n = lambda df: df.agg(F.count("*")).scalar()
    return v.spark.range(1).select(n(v.symbols()).alias("symbols"), n(v.calls()).alias("calls"), n(v.inherits()).alias("inherits"))


@_query("SELECT type, src, dst FROM edges_v WHERE src IN ('c1', 'c2', 'f17', 'f3') OR dst IN ('c1', 'c2', 'f17', 'f3')")
def graph_payload_edges(v: Views) -> DataFrame:
    some = ["c1", "c2", "f17", "f3"]
    return v.edges().where(F.col("src").isin(some) | F.col("dst").isin(some)).dropDuplicates(["src", "dst", "type"]).select("type", "src", "dst")


@_query("SELECT src, dst FROM has_method_v")
def has_method_edges(v: Views) -> DataFrame:
    return v.has_method().select("src", "dst")


# Each line item refers to a method of the part it is about, unqualified by a name that few parts share (brand, size and type), or by
# brand and qualified by the class of the supplier that it names.
_REFS = "SELECT DISTINCT 'f' || (l_orderkey % 50) AS src, 'Class_' || l_suppkey AS qualifier, p_brand AS tail, p_brand || '_' || p_size || '_' || p_type AS full_name FROM lineitem JOIN part ON l_partkey = p_partkey"


def _refs(v: Views, name: str) -> DataFrame:
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    tail = F.col("p_brand") if name == "brand" else _full_name()
    return rows.select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string")).alias("src_name"), F.concat(F.lit("Class_"), F.col("l_suppkey").cast("string")).alias("qualifier"), tail.alias("tail")
    ).distinct()


def _full_name() -> Column:
    return F.concat_ws("_", "p_brand", F.col("p_size").cast("string"), "p_type")


def _call_rows(refs: DataFrame, qualified: bool) -> DataFrame:
    ref = F.concat("qualifier", F.lit("."), "tail") if qualified else F.col("tail")
    return refs.select(
        F.lit("r").alias("repo_url"), F.lit("python").alias("language"), F.lit("main.py").alias("src_file"), "src_name", F.lit("function").alias("src_type"), F.lit("call").alias("role"), F.lit(0).alias("ord"), ref.alias("ref"),
        "tail", F.col("qualifier") if qualified else F.lit(None).cast("string").alias("qualifier"), F.lit("qualified" if qualified else "self").alias("branch"), F.lit(None).cast("string").alias("owner"),
    ).distinct()


def _method_chunks(v: Views, name: str) -> DataFrame:
    rows = v.methods()
    if name != "brand":
        rows = rows.drop("name").join(v.table("part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("node"), _full_name().alias("name")), "node")
    return rows.select(F.lit("r").alias("repo_url"), F.lit("python").alias("language"), "name", F.lit("method").alias("type"), F.col("filepath").alias("file_path"), F.concat(F.regexp_extract("qualified_name", r"^[^.]*", 0), F.lit("."), "node").alias("qualified_name"))


@_query(f", refs AS (SELECT DISTINCT src, full_name FROM ({_REFS})), named AS (SELECT m.*, p_brand || '_' || p_size || '_' || p_type AS full_name FROM methods_v m JOIN part ON m.node = 'm' || p_partkey), found AS (SELECT r.src, r.full_name, count(*) AS n, max(m.filepath || ':' || split_part(m.qualified_name, '.', 1) || '.' || m.node) AS k FROM refs r JOIN named m USING (full_name) GROUP BY ALL) SELECT src AS src_name, full_name AS ref, k AS target FROM found WHERE n = 1")
def resolve_unique_candidates(v: Views) -> DataFrame:
    out = resolve.resolved(_call_rows(_refs(v, "full"), False), _method_chunks(v, "full"))
    return out.select("src_name", "ref", F.concat("dst_file", F.lit(":"), "dst_name").alias("target"))


@_query(
    f""", refs AS (SELECT DISTINCT src, qualifier, tail FROM ({_REFS})), found AS (SELECT r.src, r.qualifier, r.tail, count(*) AS n, count(*) FILTER (WHERE split_part(m.qualified_name, '.', 1) = r.qualifier) AS n_exact,
  max(m.filepath || ':' || split_part(m.qualified_name, '.', 1) || '.' || m.node) AS k, max(m.filepath || ':' || split_part(m.qualified_name, '.', 1) || '.' || m.node) FILTER (WHERE split_part(m.qualified_name, '.', 1) = r.qualifier) AS k_exact
  FROM refs r JOIN methods_v m ON m.name = r.tail GROUP BY ALL)
SELECT src AS src_name, qualifier || '.' || tail AS ref, CASE WHEN n_exact = 1 THEN k_exact ELSE k END AS target FROM found WHERE n_exact = 1 OR (n_exact = 0 AND n = 1)"""
)
def resolve_qualified(v: Views) -> DataFrame:
    out = resolve.resolved(_call_rows(_refs(v, "brand"), True), _method_chunks(v, "brand"))
    return out.select("src_name", "ref", F.concat("dst_file", F.lit(":"), "dst_name").alias("target"))


def _order_calls(v: Views) -> DataFrame:
    """l_orderkey, calls: what an order's line items refer to."""
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    calls = F.array_sort(F.collect_set(F.concat(F.lit("Class_"), F.col("l_suppkey").cast("string"), F.lit("."), "p_brand")))  # as many as an order has items
    return rows.groupBy("l_orderkey").agg(calls.alias("calls"))


def _linked_chunks(v: Views, orders: DataFrame, before: bool) -> DataFrame:
    """Suppliers as classes, parts as methods, orders as functions that call methods of their line items' parts. ``before``: as it was
    before an edit that renamed a tenth of the parts, gave some orders their calls, and added or removed others."""
    text = lambda p, k, q="": F.concat(F.lit(p), k.cast("string"), F.lit(q))
    s, o, none = F.col("s_suppkey"), F.col("l_orderkey"), F.array().cast("array<string>")
    bases = F.when(s >= 2, F.array(text("Class_", F.floor(s / 2)))).otherwise(none)
    classes = v.table("supplier").select(text("Class_", s).alias("qualified_name"), text("Class_", s).alias("name"), F.lit("class").alias("type"), text("cls_", s, ".py").alias("file_path"), none.alias("calls"), bases.alias("bases"))
    name = F.when(F.substring("node", 2, 20).cast("bigint") % 10 == 0, "Former").otherwise(F.col("name")) if before else F.col("name")
    methods = _method_chunks(v, "brand").withColumn("node", F.substring_index("qualified_name", ".", -1)).select("qualified_name", name.alias("name"), "type", "file_path", none.alias("calls"), none.alias("bases"))
    if before:
        gone = orders.where(o % 17 == 3).select((-o).alias("l_orderkey"), "calls")
        orders = orders.where(o % 13 != 5).withColumn("calls", F.when(o % 11 == 0, none).otherwise(F.col("calls"))).unionByName(gone)
    functions = orders.select(text("f", o).alias("qualified_name"), text("f", o).alias("name"), F.lit("function").alias("type"), text("orders_", F.floor(F.abs(o) / 100), ".py").alias("file_path"), "calls", none.alias("bases"))
    every = classes.unionByName(methods).unionByName(functions)
    return every.select(F.lit("r").alias("repo_url"), F.lit("python").alias("language"), "*")


@_query(
    """, refs AS (SELECT DISTINCT 'f' || l_orderkey AS src, 'Class_' || l_suppkey AS qualifier, p_brand AS tail FROM lineitem JOIN part ON l_partkey = p_partkey),
found AS (SELECT r.src, r.qualifier, r.tail, count(*) AS n, count(*) FILTER (WHERE split_part(m.qualified_name, '.', 1) = r.qualifier) AS n_exact, max(split_part(m.qualified_name, '.', 1) || '.' || m.node) AS k,
  max(split_part(m.qualified_name, '.', 1) || '.' || m.node) FILTER (WHERE split_part(m.qualified_name, '.', 1) = r.qualifier) AS k_exact FROM refs r JOIN methods_v m ON m.name = r.tail GROUP BY ALL)
SELECT DISTINCT 'CALLS' AS type, src AS src_name, CASE WHEN n_exact = 1 THEN k_exact ELSE k END AS dst_name FROM found WHERE n_exact = 1 OR (n_exact = 0 AND n = 1)
UNION ALL SELECT 'INHERITS', 'Class_' || s_suppkey, 'Class_' || (s_suppkey // 2) FROM supplier WHERE s_suppkey >= 2 AND s_suppkey // 2 IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'HAS_METHOD', split_part(qualified_name, '.', 1), split_part(qualified_name, '.', 1) || '.' || node FROM methods_v WHERE owner IN (SELECT 'c' || s_suppkey FROM supplier)"""
)
def relink_after_edits(v: Views) -> DataFrame:
    orders = materialize(_order_calls(v), "orders")
    old, new = (materialize(_linked_chunks(v, orders, before), "linked") for before in (True, False))
    edges = materialize(resolve.link(old, written=True), "edges")
    return relink.relink(old, new, edges).select("type", "src_name", "dst_name")


@_query("SELECT p_partkey, CASE WHEN rn = 1 THEN p_brand ELSE p_brand || '#' || rn END AS qualified_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS rn FROM part)", views=False)
def dedupe_qualified_names(v: Views) -> DataFrame:
    rows = v.table("part").select("p_partkey", F.col("p_size").alias("file_path"), F.col("p_brand").alias("qualified_name"))
    return resolve.unique_names(rows, "p_partkey").select("p_partkey", "qualified_name")


# Incremental maintenance

_CHANGES = """SELECT coalesce(c.path, s.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'added' WHEN c.body = s.body THEN 'unchanged' ELSE 'modified' END AS change
  FROM current_v c FULL JOIN stored_v s ON c.path = s.path"""


@_query(" " + _CHANGES)
def plan_changes(v: Views) -> DataFrame:
    return incremental.plan_changes(*v.file_state())


@_query(f", ch AS ({_CHANGES}) SELECT count(*) FILTER (WHERE change <> 'unchanged') AS differing, count(*) FILTER (WHERE change <> 'unchanged') = 0 AS up_to_date FROM ch")
def up_to_date_check(v: Views) -> DataFrame:
    return incremental.up_to_date(*v.file_state())


@_query(f", ch AS ({_CHANGES}) SELECT repo_url, filepath, symbol FROM chunks_v WHERE filepath NOT IN (SELECT path FROM ch WHERE change IN ('deleted', 'modified'))")
def delete_files(v: Views) -> DataFrame:
    gone = incremental.plan_changes(*v.file_state()).where("change IN ('deleted', 'modified')")
    return incremental.delete_files(v.chunks(), gone).select("repo_url", "filepath", "symbol")


@_query(
    """ SELECT filepath, symbol, length(code_text) AS chars, 'stored' AS version FROM chunks_v WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0
UNION ALL SELECT filepath, symbol, length(code_text) + 8, 'fresh' FROM chunks_v WHERE doc_id % 7 = 0"""
)
def upsert_replace(v: Views) -> DataFrame:
    c = v.chunks()
    stored = c.where("doc_id % 10 <> 0").select("filepath", "symbol", F.length("code_text").alias("chars"), F.lit("stored").alias("version"))
    fresh = c.where("doc_id % 7 = 0").select("filepath", "symbol", (F.length("code_text") + 8).alias("chars"), F.lit("fresh").alias("version"))
    return incremental.upsert(stored, fresh, ["filepath", "symbol"])


_KEYED = "'emb:v1:hashed:64:passage:' || sha256(code_text)"


@_query(f" SELECT {_KEYED} AS key, length(min(code_text)) AS chars, count(*) AS uses FROM chunks_v GROUP BY 1")
def embedding_dedupe(v: Views) -> DataFrame:
    return vector.distinct_texts(v.chunks(), "hashed", 64).select("key", F.length("text").alias("chars"), "uses")


@_query(f" SELECT DISTINCT {_KEYED} AS key FROM chunks_v WHERE {_KEYED} NOT IN (SELECT {_KEYED} FROM chunks_v WHERE doc_id % 3 = 0)")
def embedding_cache_misses(v: Views) -> DataFrame:
    cached = vector.distinct_texts(v.chunks().where("doc_id % 3 = 0"), "hashed", 64).select("key", F.lit(None).alias("vector"))
    return vector.cache_misses(vector.distinct_texts(v.chunks(), "hashed", 64), cached).select("key")


# Context and citations


@_query(
    """, l AS (SELECT filepath, code_text, CASE WHEN code_text = '' THEN [] ELSE string_split(CASE WHEN ends_with(code_text, chr(10)) THEN left(code_text, length(code_text) - 1) ELSE code_text END, chr(10)) END AS ls FROM chunks_v)
SELECT filepath, CASE WHEN len(ls) <= 5 THEN code_text ELSE array_to_string(ls[1:5], chr(10)) || chr(10) || '# ... ' || (len(ls) - 5) || ' more lines not shown' END AS shown FROM l"""
)
def truncate_snippets(v: Views) -> DataFrame:
    return context.snippets(v.chunks(), 5).select("filepath", "shown")


@_query(
    """, hits AS (SELECT filepath, start_line, end_line, qualified_name, type FROM symbols_v WHERE type <> 'function'
  UNION ALL SELECT filepath, start_line - 1, end_line + 1, qualified_name || '.outer', 'function' FROM symbols_v WHERE type = 'method' AND start_line % 5 = 0)
SELECT qualified_name, start_line, end_line FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits c WHERE c.type <> 'class' AND c.filepath = h.filepath AND c.start_line <= h.start_line AND h.end_line <= c.end_line AND (c.start_line <> h.start_line OR c.end_line <> h.end_line))"""
)
def drop_nested_hits(v: Views) -> DataFrame:
    s = v.symbols().withColumnRenamed("type", "chunk_type").withColumn("code_text", F.lit("x"))
    columns = ["filepath", "start_line", "end_line", "qualified_name", "chunk_type", "code_text"]
    outer = s.where("chunk_type = 'method' AND start_line % 5 = 0").select("filepath", (F.col("start_line") - 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), F.concat("qualified_name", F.lit(".outer")).alias("qualified_name"), F.lit("function").alias("chunk_type"), "code_text")
    return context.without_nested(s.where("chunk_type <> 'function'").select(*columns).unionByName(outer)).select("qualified_name", "start_line", "end_line")


_ANSWER = "text || ' see cls_' || (conv_id % 12) || '.py:' || (conv_id % 12 * 100 + turn * 40) || ' and src/mod_' || (turn % 30) || '.py:12-20, then mod_' || (turn % 3) || '.py:7.'"
_SPANS = """ (SELECT filepath, start_line AS s, end_line AS e, type = 'method' AS shown FROM symbols_v)"""
_CITED = rf""", ans AS (SELECT conv_id * 1000 + turn AS answer_id, {_ANSWER} AS answer FROM conversations WHERE role <> 'user'),
raw AS (SELECT answer_id, unnest(regexp_extract_all(answer, '{context.CITATION}', 0)) AS text, generate_subscripts(regexp_extract_all(answer, '{context.CITATION}', 0), 1) AS i FROM ans),
one AS (SELECT answer_id, text, min(i) AS i FROM raw GROUP BY ALL),
cited AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS ord, text, regexp_extract(text, '{context.CITATION}', 1) AS path, regexp_extract(text, '{context.CITATION}', 2)::INT AS line,
  CASE WHEN regexp_extract(text, '{context.CITATION}', 3) = '' THEN regexp_extract(text, '{context.CITATION}', 2)::INT ELSE regexp_extract(text, '{context.CITATION}', 3)::INT END AS end_line FROM one),
sp AS {_SPANS},
files AS (SELECT DISTINCT filepath FROM sp),
cand AS (SELECT c.*, f.filepath FROM cited c LEFT JOIN files f ON f.filepath = regexp_replace(c.path, '^[./]+', '') OR ends_with(f.filepath, '/' || regexp_replace(c.path, '^[./]+', ''))),
res AS (SELECT answer_id, ord, text, path, line, end_line, min(cand.filepath) AS candidate, min(sp.filepath) FILTER (WHERE sp.shown) AS shown_in, min(sp.filepath) AS covered_in
  FROM cand LEFT JOIN sp ON sp.filepath = cand.filepath AND cand.line BETWEEN sp.s AND sp.e GROUP BY ALL),
checked AS (SELECT answer_id, ord, text, coalesce(shown_in, covered_in, candidate, path) AS filepath, line, end_line,
  CASE WHEN candidate IS NULL THEN 'unknown_file' WHEN shown_in IS NOT NULL THEN 'verified' WHEN covered_in IS NOT NULL THEN 'graph' ELSE 'wrong_line' END AS status FROM res)"""


def _cited(v: Views) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    s = lambda c: c.cast("string")
    answer = F.concat(
        "text", F.lit(" see cls_"), s(conv % 12), F.lit(".py:"), s(conv % 12 * 100 + turn * 40), F.lit(" and src/mod_"), s(turn % 30), F.lit(".py:12-20, then mod_"), s(turn % 3), F.lit(".py:7.")
    )
    rows = v.table("conversations").where("role <> 'user'").select((conv * 1000 + turn).alias("answer_id"), answer.alias("answer"))
    return context.citations(rows)


def _checked(v: Views) -> DataFrame:
    spans = v.symbols().select("filepath", F.col("start_line").alias("start"), F.col("end_line").alias("end"), (F.col("type") == "method").alias("shown"))
    return context.check(_cited(v), spans)


@_query(_CITED + " SELECT answer_id, ord, text, path, line, end_line FROM cited")
def citation_extract(v: Views) -> DataFrame:
    return _cited(v)


@_query(_CITED + " SELECT * FROM checked")
def citation_check(v: Views) -> DataFrame:
    return _checked(v)


@_query(_CITED + " SELECT answer_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("verified", "graph", "wrong_line", "unknown_file")) + " FROM checked GROUP BY answer_id")
def citation_summary(v: Views) -> DataFrame:
    return context.citation_summary(_checked(v))


@_query(
    r"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'NEED: `' ELSE 'No: ' END || replace(text, ' ', ', ') AS reply FROM conversations),
items AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_extract(reply, '(?s)^[\s*_`>]*NEED\s*:\s*(.*)', 1), '[,;\n]')) AS raw, generate_subscripts(regexp_split_to_array(regexp_extract(reply, '(?s)^[\s*_`>]*NEED\s*:\s*(.*)', 1), '[,;\n]'), 1) AS i
  FROM r WHERE regexp_matches(reply, '(?s)^[\s*_`>]*NEED\s*:\s*(.*)')),
clean AS (SELECT conv_id, turn, i, trim(rtrim(trim(raw, E' \t\r\n\f\x0b'), '.'), '`*_''" ') AS item FROM items),
one AS (SELECT conv_id, turn, item, min(i) AS i FROM clean WHERE item <> '' AND length(item) <= 200 GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rn FROM one)
SELECT conv_id, turn, string_agg(item, '|' ORDER BY i) AS items FROM cut WHERE rn <= 5 GROUP BY conv_id, turn""",
    views=False,
)
def parse_need_request(v: Views) -> DataFrame:
    reply = F.concat(F.when(F.col("turn") % 2 == 0, "NEED: `").otherwise("No: "), F.replace("text", F.lit(" "), F.lit(", ")))
    rows = v.table("conversations").select("conv_id", "turn", context.requested_items(reply).alias("t")).where("t IS NOT NULL AND size(t) > 0")
    return rows.select("conv_id", "turn", F.array_join("t", "|").alias("items"))


@_query(
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN role <> 'user' AND length(t) > 40 THEN left(t, 40) || ' ...' ELSE t END AS line
  FROM (SELECT conv_id, turn, role, trim(coalesce(text, ''), ' ') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6""",
    views=False,
)
def history_window(v: Views) -> DataFrame:
    return context.history(v.table("conversations"), chars=40)


# Evaluation: documents of good quality are gold for their source; rankings go by length, or by id.

_RANKED = """, gold AS (SELECT c.repo_url AS case_id, c.symbol AS name, CASE WHEN l.doc_id % 2 = 0 THEN c.filepath END AS filepath FROM labels l JOIN chunks_v c USING (doc_id) WHERE l.quality = 1),
ranking AS (SELECT repo_url AS case_id, filepath, symbol, row_number() OVER (PARTITION BY repo_url ORDER BY end_line DESC, filepath, symbol) AS rank FROM chunks_v),
hits AS (SELECT g.case_id, g.name, g.filepath, min(r.rank) AS rank FROM gold g LEFT JOIN (SELECT * FROM ranking WHERE rank <= 24) r ON r.case_id = g.case_id AND r.symbol = g.name AND (g.filepath IS NULL OR g.filepath = r.filepath) GROUP BY ALL),
scored AS (SELECT case_id, count(*) AS gold, count(rank) AS found, min(rank) AS first_rank, count(rank) / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS reciprocal_rank FROM hits GROUP BY case_id)"""


def _gold(v: Views) -> tuple[DataFrame, DataFrame]:
    c = v.chunks()
    gold = v.table("labels").where("quality = 1").join(c, "doc_id").select(F.col("repo_url").alias("case_id"), F.col("symbol").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("filepath")).alias("filepath"))
    return gold, evaluate.rank_lists(c.select(F.col("repo_url").alias("case_id"), "filepath", "symbol", "end_line"), "end_line").where("rank <= 24")


def _recall(v: Views) -> DataFrame:
    return evaluate.recall(evaluate.gold_hits(*_gold(v)))


@_query(_RANKED + " SELECT case_id, gold, found, round(recall, 6) AS recall FROM scored")
def eval_recall(v: Views) -> DataFrame:
    return _recall(v).select("case_id", "gold", "found", F.round("recall", 6).alias("recall"))


@_query(_RANKED + " SELECT case_id, first_rank, round(reciprocal_rank, 6) AS reciprocal_rank FROM scored")
def eval_mrr(v: Views) -> DataFrame:
    return _recall(v).select("case_id", "first_rank", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@_query(_RANKED + " SELECT 'kind' || (length(case_id) % 2) AS kind, count(*) AS cases, round(avg(recall), 4) AS recall, round(avg(reciprocal_rank), 4) AS reciprocal_rank FROM scored GROUP BY 1")
def eval_by_kind(v: Views) -> DataFrame:
    rows = _recall(v).withColumn("kind", F.concat(F.lit("kind"), (F.length("case_id") % 2).cast("string")))
    return evaluate.means(rows, ["recall", "reciprocal_rank"], "kind")


@_query(_RANKED + " SELECT case_id, name FROM hits WHERE rank IS NULL")
def missing_gold(v: Views) -> DataFrame:
    return evaluate.missing(evaluate.gold_hits(*_gold(v)))


_DIFF = """, m AS (SELECT case_id AS variant, unnest(['recall', 'seconds']) AS metric, unnest([round(recall, 4), round(reciprocal_rank, 4)]) AS value FROM scored),
b AS (SELECT variant, metric, round(value * 0.9 + 0.05, 4) AS value FROM m)"""


@_query(_RANKED + _DIFF + " SELECT variant, metric, b.value AS before, m.value AS now, round(m.value - b.value, 4) AS change, CASE WHEN metric = 'seconds' THEN round(m.value - b.value, 4) > 0 ELSE round(m.value - b.value, 4) < 0 END AS regression FROM m JOIN b USING (variant, metric)")
def baseline_diff(v: Views) -> DataFrame:
    rows = _recall(v)
    now = rows.select(F.col("case_id").alias("variant"), F.explode(F.array(F.struct(F.lit("recall").alias("metric"), F.round("recall", 4).alias("value")), F.struct(F.lit("seconds").alias("metric"), F.round("reciprocal_rank", 4).alias("value")))).alias("x")).select("variant", "x.*")
    return evaluate.baseline_diff(now, now.withColumn("value", F.round(F.col("value") * 0.9 + 0.05, 4)))


@_query(" SELECT conv_id, turn, round((CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 1 ELSE 0 END) / 2, 6) AS mention FROM conversations WHERE role <> 'user'")
def mention_score(v: Views) -> DataFrame:
    facts = F.array(F.array(F.lit("the"), F.lit("Der")), F.array(F.lit("and")))
    return v.table("conversations").where("role <> 'user'").select("conv_id", "turn", F.round(evaluate.mention_score(F.col("text"), facts), 6).alias("mention"))


_OPENINGS = ["Based on the provided context, there is no such code. ", "It is here. The given code does not show it. ", "", "One. Two. The context does not contain it. "]


@_query(" SELECT conv_id, turn, turn % 4 IN (0, 1) AS abstained FROM conversations WHERE role <> 'user'")
def abstained(v: Views) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("turn") % 4 + 1).cast("int"))
    return v.table("conversations").where("role <> 'user'").select("conv_id", "turn", evaluate.abstained(F.concat(opening, "text")).alias("abstained"))


@_query(_CITED + ", g AS (SELECT answer_id, 'cls_' || (answer_id // 1000 % 12) || '.py' AS filepath, (answer_id // 1000 % 12 * 100 + 1) AS s, (answer_id // 1000 % 12 * 100 + 60) AS e FROM ans) SELECT c.answer_id, max(g.answer_id IS NOT NULL) AS cites_gold FROM cited c LEFT JOIN g ON g.answer_id = c.answer_id AND (c.path = g.filepath OR ends_with(g.filepath, '/' || c.path)) AND c.line BETWEEN g.s AND g.e GROUP BY c.answer_id")
def cites_gold(v: Views) -> DataFrame:
    cited = _cited(v).select("answer_id", F.col("path").alias("filepath"), "line")
    n = F.floor(F.col("answer_id") / 1000) % 12
    spans = cited.select("answer_id").distinct().select("answer_id", F.concat(F.lit("cls_"), n.cast("string"), F.lit(".py")).alias("filepath"), (n * 100 + 1).alias("start_line"), (n * 100 + 60).alias("end_line"))
    return evaluate.cites_gold(cited, spans)


# Explorer


@_query(
    r"""WITH p AS (SELECT rtrim(regexp_extract(url, '://([^?#]*)', 1), '/') AS path FROM pages), s AS (SELECT string_split(path, '/') AS parts FROM p),
x AS (SELECT array_to_string(parts[1:i], '/') AS prefix, i AS depth FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS i FROM s))
SELECT prefix, count(*) AS symbols, depth FROM x GROUP BY prefix, depth""",
    views=False,
)
def file_tree_counts(v: Views) -> DataFrame:
    return explore.tree_counts(v.paths())


@_query(" SELECT 'n' || c_nationkey AS district, sum(1 + c_custkey % 9)::BIGINT AS symbols, round(sum((c_custkey % 40) * (1 + c_custkey % 9)) / sum(1 + c_custkey % 9), 6) AS x, round(sum((c_custkey % 17) * (1 + c_custkey % 9)) / sum(1 + c_custkey % 9), 6) AS y FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def district_centroids(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    rows = v.table("customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("district"), (k % 40).alias("x"), (k % 17).alias("y"), (1 + k % 9).alias("symbols"))
    return explore.districts(rows)


@_query(" SELECT type, count(*) AS n FROM symbols_v GROUP BY type")
def kind_counts(v: Views) -> DataFrame:
    return explore.kind_counts(v.symbols())


_CONTEXT = _CLOSURE + """, anchors AS (SELECT * FROM symbols_v WHERE node IN ('c1', 'c2', 'c5', 'm4', 'm9', 'f17', 'f3')),
w AS (SELECT 'calls' AS k, src AS start, dst AS node, 1 AS hops FROM calls_v UNION ALL SELECT 'called_by', dst, src, 1 FROM calls_v UNION ALL SELECT 'bases', src, dst, 1 FROM inherits_v UNION ALL SELECT 'subclasses', dst, src, 1 FROM inherits_v
  UNION ALL SELECT 'methods', src, dst, 1 FROM has_method_v UNION ALL SELECT 'overrides', o.method, o.overridden, level FROM over_v o JOIN has_method_v h ON h.dst = o.method JOIN has_method_v g ON g.dst = o.overridden
  UNION ALL SELECT 'overridden_by', o.overridden, o.method, level FROM over_v o JOIN has_method_v h ON h.dst = o.method JOIN has_method_v g ON g.dst = o.overridden),
r AS (SELECT w.k, w.start, s.qualified_name, row_number() OVER (PARTITION BY w.k, w.start ORDER BY w.hops, s.qualified_name, s.filepath) AS rn FROM w JOIN symbols_v s ON s.node = w.node JOIN anchors a ON a.node = w.start)"""
_KINDS = ("calls", "called_by", "bases", "subclasses", "methods", "overrides", "overridden_by")


def _context(v: Views) -> DataFrame:
    anchors = v.symbols().where(F.col("node").isin("c1", "c2", "c5", "m4", "m9", "f17", "f3"))
    return graph.symbol_context(*_tables(v), anchors, 1, 10)


@_query(
    _CONTEXT + " SELECT a.node, " + ", ".join(f"(SELECT string_agg(qualified_name, ',' ORDER BY rn) FROM r WHERE r.start = a.node AND k = '{k}'" + ("" if k in ("bases", "overrides") else " AND rn <= 10") + f") AS {k}" for k in _KINDS)
    + ", (SELECT min(s.qualified_name) FROM has_method_v h JOIN symbols_v s ON s.node = h.src WHERE h.dst = a.node) AS owner FROM anchors a",
    recursive=True,
)
def symbol_context_lists(v: Views) -> DataFrame:
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c)
    return _context(v).select("node", *map(names, _KINDS), "owner")


_SHOWN = {"calls": ("CALLS", True), "called_by": ("CALLS", False), "bases": ("INHERITS", True), "subclasses": ("INHERITS", False), "methods": ("HAS_METHOD", True), "overrides": ("OVERRIDES", True), "overridden_by": ("OVERRIDES", False)}


@_query(
    _CONTEXT + " " + " UNION ".join(
        f"SELECT {'a.qualified_name' if out else 'r.qualified_name'} AS source, {'r.qualified_name' if out else 'a.qualified_name'} AS target, '{kind}' AS type FROM r JOIN anchors a ON a.node = r.start WHERE k = '{k}'" + ("" if k in ("bases", "overrides") else " AND rn <= 10")
        for k, (kind, out) in _SHOWN.items()
    ),
    recursive=True,
)
def symbol_context_payload(v: Views) -> DataFrame:
    return graph.payload(_context(v))


@_query(" SELECT DISTINCT * FROM (SELECT 'out' AS direction, type, dst AS node FROM edges_v WHERE src = 'c2' UNION ALL SELECT 'in', type, src FROM edges_v WHERE dst = 'c2')")
def neighbours_in_out(v: Views) -> DataFrame:
    return graph.in_out(v.edges(), "c2")


@_query(_impact_sql(_TARGET, 3, 300) + " SELECT ord, '- ' || qualified_name || ' (' || filepath || '): ' || relation || ' ' || via_name || ', ' || hops || ' steps away' AS line FROM affected WHERE ord <= 4")
def impact_lines(v: Views) -> DataFrame:
    return context.impact_lines(_impact(v, graph.find(v.symbols(), "fn_17"), 300), 4)


@_query(_RANKED + " SELECT g.case_id, s.filepath, s.start_line, s.end_line FROM gold g JOIN chunks_v s ON g.name = s.symbol AND (g.filepath IS NULL OR g.filepath = s.filepath)")
def gold_spans(v: Views) -> DataFrame:
    return evaluate.gold_spans(_gold(v)[0], v.chunks().withColumnRenamed("symbol", "qualified_name"))


@_query(" SELECT filepath, qualified_name FROM symbols_v WHERE (filepath = 'cls_7.py' OR starts_with(filepath, 'cls_7.py/')) AND contains(lower(name), 'brand#1')")
def select_symbols(v: Views) -> DataFrame:
    return explore.select_symbols(v.symbols(), "cls_7.py", "Brand#1").select("filepath", "qualified_name")


@_query(" SELECT coalesce(a.url, b.url) AS url, b.last_indexed, b.symbols, coalesce(a.state, 'indexed') AS state FROM (SELECT DISTINCT repo_url AS url, 'pending' AS state FROM chunks_v WHERE doc_id % 2 = 0) a FULL JOIN (SELECT repo_url AS url, max(doc_id) AS last_indexed, count(*) AS symbols FROM chunks_v WHERE doc_id % 3 = 0 GROUP BY repo_url) b ON a.url = b.url")
def merge_repositories(v: Views) -> DataFrame:
    c = v.chunks()
    local = c.where("doc_id % 2 = 0").select(F.col("repo_url").alias("url"), F.lit("pending").alias("state")).distinct()
    server = c.where("doc_id % 3 = 0").groupBy(F.col("repo_url").alias("url")).agg(F.max("doc_id").alias("last_indexed"), F.count("*").alias("symbols"))
    return explore.merge_repositories(local, server)


@_query(_RERANK + f" SELECT filepath, symbol, retrieval_rank - rank AS rank_change FROM kept WHERE rank <= {fusion.KEPT}")
def rank_change(v: Views) -> DataFrame:
    return explore.rank_change(_reranked(v, _fused(_lists(v)), fusion.KEPT)).select("filepath", "symbol", "rank_change")


@_query(" SELECT DISTINCT filepath AS path FROM symbols_v")
def indexed_paths(v: Views) -> DataFrame:
    return v.symbols().select(F.col("filepath").alias("path")).distinct()


# Parsing and linking, over source fixtures: what they give is known, row by row


_PARSED = "file_path, qualified_name, name, type, start_line, end_line, docstring, calls, bases"


@_query(fixtures.expected(fixtures.PYTHON_SYMBOLS, _PARSED), views=False)
def parse_python_symbols(v: Views) -> DataFrame:
    return _parsed(v, "python")


@_query(fixtures.expected(fixtures.SCRIPT_SYMBOLS, _PARSED), views=False)
def parse_script_symbols(v: Views) -> DataFrame:
    return _parsed(v, "typescript")


def _parsed(v: Views, language: str) -> DataFrame:
    joined = lambda c: F.array_join(c, " ").alias(c)
    return fixtures.chunks(v.spark, language).select("file_path", "qualified_name", "name", "type", "start_line", "end_line", F.coalesce("docstring", F.lit("")).alias("docstring"), joined("calls"), joined("bases"))


@_query(fixtures.expected(fixtures.EDGES, "type, src_file, src_name, dst_file, dst_name"), views=False)
def link_python_repo(v: Views) -> DataFrame:
    return resolve.link(fixtures.chunks(v.spark)).drop("repo_url")
