"""The engine: index repositories, then ask about them. Every answer is a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import repository_address
from symgraph.operators import ann, fusion, graph, incremental, lexical, relink, resolve, segments, vector
from symgraph.plans import indexes
from symgraph.schemas import INDEX_VERSION
from symgraph.session import materialize, share_code
from symgraph.sources.parse import parse_files
from symgraph.sources.store import SCHEMAS, Store

DIMS = 64
DEPTHS, LIMITS = (1, 5), (1, 1000)


def _clamped(value: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], value))


def _named(chunks: DataFrame) -> DataFrame:
    """Chunks by the names that searches use."""
    return chunks.select("repo_url", F.col("file_path").alias("filepath"), F.col("qualified_name").alias("symbol"), F.col("type").alias("chunk_type"), "start_line", "end_line", F.col("source_code").alias("code_text"))


class Engine:
    """Tables below ``root``. ``embedder`` turns texts into vectors of ``dims``; the default hashes words."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, dims: int = DIMS, model: str = "hashed") -> None:
        self.spark, self.store = share_code(spark), Store(spark, root)
        self.embedder, self.dims, self.model = embedder or vector.hashed_words(dims), dims, model

    # Indexing

    def index(self, files: DataFrame, commit: str | None = None, full: bool = False, now: int | None = None) -> DataFrame:
        """Bring a repository's tables up to date with its ``files`` (repo_url, path, language, sha, content); one summary row.

        All files are parsed, as linking needs them; only chunks of changed files are embedded, equal texts once, and only
        references that the changes concern are resolved again. A file that cannot be read or embedded keeps its old rows and
        its old hash, so the next run tries it again. While tables are written, the repository's row has version 0: a run that
        ends early leaves it so, and the next one trusts nothing of what is stored.
        """
        files = materialize(files, "files")
        repo = files.select("repo_url").first()
        if repo is None:
            raise ValueError("no supported files")
        if files.where(~F.col("repo_url").eqNullSafe(F.lit(repo[0]))).take(1):
            raise ValueError("files of more than one repository")
        url, now = repo[0], now or int(time.time() * 1000)
        known = self.store.read("repositories", url).first()
        state = self.store.read("file_state", url)
        full = incremental.needs_full(state, known.index_version if known else None, full)
        current = files.select("path", "sha")
        changes = materialize(incremental.plan_changes(current, state.select("path", "sha"), full), "changes")
        if known and known.commit == commit and not full and not changes.where("change <> 'unchanged'").take(1):
            return incremental.summary(changes, changes.where("false")).withColumn("status", F.lit("up_to_date"))
        chunks = materialize(parse_files(files), "chunks")
        changed = changes.where("change IN ('added', 'modified')").select("path")
        fresh = chunks.join(changed, F.col("file_path") == F.col("path"), "left_semi")
        unread = files.where("content IS NULL").select("path")
        vectors, failed = self._embedded(fresh, now)
        failed = materialize(failed.unionByName(unread).distinct(), "failed")
        old = self.store.read("chunks", url)
        kept = chunks.join(failed.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        stale = old.join(failed.withColumnRenamed("path", "file_path"), "file_path", "left_semi").join(current.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        every = materialize(kept.unionByName(stale), "every")
        if not every.take(1):
            raise ValueError("nothing to link")
        gone = changes.where("change IN ('modified', 'deleted')").select("path")
        edges = materialize(resolve.link(every) if full else relink.relink(materialize(old, "old"), every, self.store.read("edges", url)), "edges")
        if known:
            self._record(url, known.created_at, known.last_indexed, known.commit, 0)
        self.store.replace("vectors", incremental.replaced(self.store.read("vectors", url), vectors, failed, changes.join(gone.union(changed).distinct(), "path", "left_semi")))
        self.store.replace("chunks", every)
        self._index_terms(url, every, changes, failed, full)
        if edges.isEmpty():
            self.store.drop("edges", url)
        self.store.replace("edges", edges)
        done = current.join(failed, "path", "left_anti").unionByName(state.select("path", "sha").join(failed, "path", "left_semi").join(current.select("path"), "path", "left_semi"))
        self.store.replace("file_state", done.select(F.lit(url).alias("repo_url"), "path", "sha"))
        self._record(url, known.created_at if known else now, now, commit, INDEX_VERSION)
        return incremental.summary(changes, failed)

    def _record(self, url: str, created: int, indexed: int, commit: str | None, version: int) -> None:
        """Write a repository's row."""
        row = [(url, created, indexed, commit, version)]
        self.store.replace("repositories", self.spark.createDataFrame(row, SCHEMAS["repositories"]))

    @property
    def terms_index(self) -> segments.SegmentedIndex:
        """The lexical index of all repositories."""
        return segments.SegmentedIndex(self.spark, f"{self.store.root}/lexical")

    def _index_terms(self, url: str, chunks: DataFrame, changes: DataFrame, failed: DataFrame, full: bool) -> None:
        """Write the postings of changed files as a segment; a full run replaces all of the repository's."""
        touched = changes.where("change <> 'unchanged'").select("path").join(failed, "path", "left_anti").select(F.lit(url).alias("repo_url"), F.col("path").alias("filepath"))
        fresh = _named(chunks).join(touched, ["repo_url", "filepath"], "left_semi")
        if full:
            touched = touched.unionByName(self.terms_index.docs().where(F.col("repo_url") == url).select("repo_url", "filepath"))
            fresh = _named(chunks)
        self.terms_index.apply(fresh, touched)

    def lexical(self, terms: list[str], fields: tuple[str, ...] = tuple(lexical.FIELDS), url: str | None = None) -> DataFrame:
        """BM25 over the stored index: statistics of all repositories, hits of one."""
        return self.terms_index.search(terms, fields, url)

    def _vectors_state(self) -> str:
        """Which runs the vectors are of."""
        runs = F.sort_array(F.collect_list(F.concat_ws("=", "repo_url", "last_indexed")))  # a row a repository
        return self.store.read("repositories").agg(F.sha2(F.concat_ws(" ", runs), 256)).first()[0]

    def build_vector_index(self) -> DataFrame:
        """Build the ANN index of all vectors; searches use it until a repository is indexed or deleted. Returns its sizes."""
        state, path = self._vectors_state(), f"{self.store.root}/ann"
        self.spark.createDataFrame([("",)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")  # none is current while it is built
        sizes = ann.build(self.store.read("vectors"), path)
        self.spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        return sizes

    def _nearest(self, url: str, asked: DataFrame, certain: bool) -> DataFrame:
        """The nearest points by the index if it is current, else by all of the repository's vectors."""
        path = f"{self.store.root}/ann"
        if indexes.exists(self.spark, f"{path}/state") and self.spark.read.parquet(f"{path}/state").first()[0] == self._vectors_state():
            return ann.search(self.spark, path, asked, url, threshold=vector.THRESHOLD, certain=certain)
        return vector.search(self.store.read("vectors", url), asked, url, threshold=vector.THRESHOLD)

    def _embedded(self, chunks: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        """Vectors of chunks, and the paths of files of which any chunk failed; new vectors go to the cache."""
        named = chunks.withColumn("code_text", F.col("source_code")).withColumn("key", vector.text_key(F.col("source_code"), self.model, self.dims, "passage"))
        cache = vector.live(self.store.read("embedding_cache").where(F.col("model") == self.model), now)
        texts = vector.distinct_texts(named, self.model, self.dims)
        made = materialize(vector.embed(vector.cache_misses(texts, cache), self.embedder, self.dims), "vectors")
        good = made.where("error IS NULL").select("key", "vector")
        both = materialize(cache.join(texts, "key", "left_semi").select("key", "vector").unionByName(good), "vectors")
        self.store.replace("embedding_cache", cache.select("model", "key", "vector", "created_at").unionByName(good.select(F.lit(self.model).alias("model"), "key", "vector", F.lit(now).alias("created_at"))))
        failed = named.join(made.where("error IS NOT NULL"), "key", "left_semi").select(F.col("file_path").alias("path")).distinct()
        out = named.join(both, "key").select("repo_url", F.col("file_path").alias("filepath"), F.col("qualified_name").alias("symbol"), "start_line", "vector")
        return out, failed

    def delete_repository(self, url: str) -> bool:
        """False if the repository was not indexed."""
        files = self.terms_index.docs().where(F.col("repo_url") == url).select("repo_url", "filepath").distinct()
        if files.take(1):
            self.terms_index.apply(_named(self.store.read("chunks").limit(0)), files)
        return self.store.delete_repository(url)

    # Tables in the operators' terms

    def symbols(self, url: str) -> DataFrame:
        node = F.concat("file_path", F.lit("\n"), "qualified_name").alias("node")
        return self.store.read("chunks", url).select(node, F.col("file_path").alias("filepath"), "qualified_name", "name", "type", "start_line", "end_line", "source_code")

    def edges(self, url: str) -> DataFrame:
        e = self.store.read("edges", url)
        return e.select("type", F.concat("src_file", F.lit("\n"), "src_name").alias("src"), F.concat("dst_file", F.lit("\n"), "dst_name").alias("dst"))

    def chunks(self, url: str | None = None) -> DataFrame:
        return _named(self.store.read("chunks", url))

    # Questions

    def repositories(self) -> DataFrame:
        """Repositories and their number of symbols, the last indexed first."""
        n = self.store.read("chunks").groupBy("repo_url").agg(F.count("*").alias("symbols"))
        return self.store.read("repositories").join(n, "repo_url", "left").orderBy(F.desc_nulls_first("last_indexed"), "repo_url")

    def find(self, url: str, name: str, filepath: str | None = None) -> DataFrame:
        return graph.find(self.symbols(url), name, filepath)

    def definitions(self, url: str, name: str) -> DataFrame:
        """Symbols of a name with their direct neighbours counted."""
        found = graph.find(self.symbols(url), name, limit=25)
        calls = graph.of_type(self.edges(url), "CALLS")
        out = calls.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("calls"))
        into = calls.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("called_by"))
        return found.join(out, "node", "left").join(into, "node", "left").fillna(0, ["calls", "called_by"])

    def neighbours(self, url: str, name: str, direction: str = "callers", depth: int = 1, limit: int = 200, filepath: str | None = None) -> DataFrame:
        """Callers or callees of a name, up to five steps away."""
        calls = graph.of_type(self.edges(url), "CALLS")
        pairs = graph.reversed_(calls) if direction == "callers" else calls
        return graph.neighbours(self.symbols(url), pairs, self.find(url, name, filepath), _clamped(depth, DEPTHS), _clamped(limit, LIMITS))

    def impact(self, url: str, name: str, depth: int = 3, filepath: str | None = None, max_symbols: int = 300) -> DataFrame | None:
        """What a change of a symbol may touch; None if there is no such symbol."""
        symbols, edges = self.symbols(url), self.edges(url)
        targets = materialize(graph.find(symbols, name, filepath), "targets")
        if not targets.take(1):
            return None
        methods = graph.of_type(edges, "HAS_METHOD").join(symbols.select(F.col("node").alias("dst"), "name"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("owner"), "name")
        over = graph.overriding(targets, methods, graph.of_type(edges, "INHERITS"))
        return graph.impact(symbols, edges, targets, _clamped(depth, DEPTHS), _clamped(max_symbols, (1, 2000)), over)

    def code_at(self, url: str, filepath: str, line: int) -> DataFrame:
        """The innermost symbol around a line, with its code."""
        return graph.at_line(self.symbols(url), self.spark.createDataFrame([(filepath, line)], "filepath string, line int"))

    def symbol_code(self, url: str, name: str, filepath: str | None = None) -> DataFrame:
        """The code of the symbols of a name."""
        return self.find(url, name, filepath).select("filepath", "qualified_name", "type", "start_line", "end_line", "source_code")

    def context(self, url: str, name: str, depth: int = 3) -> DataFrame:
        """What surrounds the symbols of a name."""
        return graph.symbol_context(self.symbols(url), self.edges(url), self.find(url, name), _clamped(depth, DEPTHS))

    def indexed_paths(self, url: str) -> DataFrame:
        """path of every file that has symbols."""
        return self.store.read("chunks", url).select(F.col("file_path").alias("path")).distinct()

    def graph(self, url: str, limit: int = 400) -> tuple[DataFrame, DataFrame]:
        """The best connected symbols, and the edges among them."""
        nodes = graph.top_degree(self.symbols(url), self.edges(url), _clamped(limit, (1, 2000)))
        return nodes, graph.within(self.edges(url), nodes)

    def counts(self, url: str) -> DataFrame:
        """symbols, calls, inherits of a repository."""
        e = self.edges(url).agg(F.count_if(F.col("type") == "CALLS").alias("calls"), F.count_if(F.col("type") == "INHERITS").alias("inherits"))
        return self.symbols(url).agg(F.count("*").alias("symbols")).crossJoin(e)

    def search(self, url: str, question: str, limit: int = fusion.KEPT, scorer: Callable | None = None, certain: bool = False) -> DataFrame:
        """Hybrid search: vectors and BM25 fused by rank, the best candidates reranked, the best of those returned.

        Vectors are found by the ANN index if it was built since the last run, exactly if ``certain`` or if there is none.
        """
        limit = _clamped(limit, (1, 20))
        asked = self.spark.createDataFrame([(0, self.embedder([question])[0])], "query_id int, vector array<float>")
        key = ["filepath", "symbol", "start_line", "rank", "score"]
        a = self._nearest(url, asked, certain).select(F.lit(0).alias("list_id"), F.lit("vector").alias("source"), *key)
        terms = self.terms(question)
        b = self.lexical(terms, url=url).select(F.lit(1).alias("list_id"), F.lit("bm25").alias("source"), *key)
        candidates = max(fusion.CANDIDATES, limit)
        fused = fusion.reciprocal_rank_fusion(a.unionByName(b), 2).where(F.col("rank") <= candidates)
        hits = self.chunks(url).join(F.broadcast(fused), ["filepath", "symbol", "start_line"])  # as many rows as candidates
        passage = fusion.passage(F.col("symbol"), F.col("chunk_type"), F.col("filepath"), F.col("code_text"))
        return fusion.rerank(hits, (scorer or fusion.word_overlap(question))(passage), limit)

    def terms(self, question: str) -> list[str]:
        """Search terms of a question, by the rule of ``search_terms``."""
        from symgraph.functions.text import search_terms

        row = self.spark.createDataFrame([(question,)], "q string").select(search_terms(F.array("q")).alias("t")).first()
        return list(row.t)

    def address(self, url: str) -> str:
        """The one form of a repository's address."""
        return self.spark.createDataFrame([(url,)], "u string").select(repository_address(F.col("u"))).first()[0]
