"""The pipeline's stages, each against what it is to do with its input."""

from __future__ import annotations

import corpus_pipeline as cp
import duckdb

from symgraph.llm import simhash
from symgraph.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    out = cp.drop_toxic(spark, docs, sf_dir)
    assert out.columns == list(cp.COLUMNS)
    kept = {r.doc_id for r in out.collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    right = [(i in kept) != bool(t) for i, t in labels.items()]
    assert sum(right) >= 0.9 * len(right)

    out = cp.drop_near_duplicates(spark, docs, sf_dir)
    assert out.columns == list(cp.COLUMNS)
    kept = {r.doc_id for r in out.collect()}
    sets = {i: set(simhash.shingles(simhash.words(r.text or ""), 5)) for i, r in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in sorted(before):
        if i in kept:
            assert not any(j in kept and j < i and alike(i, j) for j in before)
        else:
            assert any(alike(i, j) for j in before if j != i)

    out = cp.mask_personal_data(spark, docs, sf_dir)
    assert out.columns == list(cp.COLUMNS) and out.count() == len(before)
    masked = out.select("doc_id", "text", "n_chars").toPandas()  # noqa: F841
    assert not duckdb.sql(r"SELECT * FROM masked WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')").fetchall()
    assert all(r.n_chars == len(r.text) for r in out.collect())

    out = cp.mix_sources(spark, docs, sf_dir)
    assert out.columns == list(cp.COLUMNS)
    words = sum(len(r.text.split()) for r in out.collect())
    assert abs(words / sum(len((r.text or "").split()) for r in before.values()) - 1.5) < 0.1


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).select("sequence_id", "length").groupBy("sequence_id").sum("length").collect()
    assert rows and max(r[1] for r in rows) <= 4096
