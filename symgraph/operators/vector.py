"""Vector search: exact cosine, and embedding with a cache."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT, THRESHOLD = 20, 0.25
#: A cached vector counts for thirty days.
CACHE_MILLIS = 30 * 24 * 3600 * 1000
#: Model and dimensions of each provider of embeddings.
PROVIDERS = {"local": ("bge-small-en-v1.5", 384), "hashed": ("hashed", 64)}


@dataclass(frozen=True)
class Settings:
    """Which vectors a store holds; another model or dimension is another collection."""

    model: str
    dims: int

    @classmethod
    def of(cls, provider: str, model: str | None = None, dims: int | None = None) -> Settings:
        """A provider's own model, or another one, of which the dimension must be given."""
        own = PROVIDERS.get(provider)
        if model is None:
            if own is None:
                raise ValueError(f"{provider} has no default model")
            return cls(own[0], dims or own[1])
        if dims is None and (own is None or own[0] != model):
            raise ValueError("another model needs its dimension")
        return cls(model, dims or own[1])

    @property
    def collection(self) -> str:
        return f"code_{re.sub('[^a-z0-9]+', '-', self.model.lower()).strip('-')}_{self.dims}"


def live(cache: DataFrame, now: int, ttl: int = CACHE_MILLIS) -> DataFrame:
    """Cached vectors that have not expired; none if ``ttl`` is 0."""
    return cache.where(F.col("created_at") > now - ttl) if ttl else cache.limit(0)
KEY = ["filepath", "symbol", "start_line"]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null if either is zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def search(points: DataFrame, queries: DataFrame, repo_url: str | None = None, limit: int = LIMIT, threshold: float | None = None) -> DataFrame:
    """query_id, key, score, rank: the best points of each query.

    ``queries`` (query_id, vector) is what one request asks, three rows at most in the engine, so it is sent to every task.
    ``points``: key, repo_url, vector. Each task keeps a query's best before anything is shuffled.
    """
    if repo_url is not None:
        points = points.where(F.col("repo_url") == repo_url)
    asked = queries.select("query_id", F.col("vector").alias("q"))
    scored = points.select(*KEY, "vector").join(F.broadcast(asked)).withColumn("score", F.round(cosine(F.col("vector"), F.col("q")), 9)).drop("vector", "q")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return scored.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def text_key(text: Column, model: str, dims: int, task: str) -> Column:
    """The cache key of a text."""
    return F.concat_ws(":", F.lit(f"emb:v1:{model}:{dims}:{task}"), F.sha2(text, 256))


def distinct_texts(chunks: DataFrame, model: str, dims: int, task: str = "passage") -> DataFrame:
    """key, text, uses: every text once, however often it occurs."""
    keyed = chunks.select(text_key(F.col("code_text"), model, dims, task).alias("key"), F.col("code_text").alias("text"))
    return keyed.groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("uses"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts that the cache (key, vector) has no vector for."""
    return texts.join(cache.select("key"), "key", "left_anti")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dims: int, batch: int = 100, attempts: int = 3) -> DataFrame:
    """key, vector, error: ``embedder`` is called on batches; a batch that keeps failing, or gives vectors of another length, is an error of its texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors, error = None, "no attempt"
                for _ in range(attempts):
                    try:
                        vectors = embedder(part["text"].tolist())
                    except Exception as e:  # whatever a model raises is reported with the texts it concerns
                        error = str(e) or type(e).__name__
                        continue
                    break
                if vectors is not None and any(len(v) != dims for v in vectors):
                    vectors, error = None, "wrong dimension"
                yield pd.DataFrame({"key": part["key"], "vector": vectors if vectors is not None else [None] * len(part), "error": None if vectors is not None else error})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<float>, error string")


def hashed_words(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder: hashed words, at length 1."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * dims
            for t in re.findall("[a-z_][a-z0-9_]*", text.lower()):
                v[zlib.crc32(t.encode()) % dims] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def fingerprint(vector: Column, dims: int = 24) -> Column:
    """The first components, rounded to four places."""
    return F.transform(F.slice(vector, 1, dims), lambda x: F.round(x.cast("double"), 4))
