"""The parser as a table function: files in, symbols out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from symgraph.schemas import CHUNK, CHUNK_FIELDS
from symgraph.sources import python_parser, script_parser


def parse_file(path: str, language: str, source: str) -> list[dict]:
    """Symbols of one file, their qualified names made unique by ``#n`` in source order."""
    found = python_parser.parse(path, source) if language == "python" else script_parser.parse(path, source, language)
    seen: dict[str, int] = {}
    for chunk in found:
        name = chunk["qualified_name"]
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            chunk["qualified_name"] = f"{name}#{seen[name]}"
    return found


def parse_files(files: DataFrame) -> DataFrame:
    """repo_url and the chunks of every readable file (repo_url, path, language, content); no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, language, content in zip(batch.repo_url, batch.path, batch.language, batch.content, strict=True):
                rows += [{"repo_url": repo, **c} for c in parse_file(path, language, content)]
            yield pd.DataFrame(rows, columns=["repo_url", *CHUNK_FIELDS])

    return files.where("content IS NOT NULL").select("repo_url", "path", "language", "content").mapInPandas(run, "repo_url string, " + CHUNK)
