"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import reference
from corpora import corpus, docs, empty, odd  # noqa: F401  (fixtures)
from logquarry.llm.common import written
from logquarry.llm.mixing import mix_sources
from logquarry.llm.queries import ORACLE, QUERIES
from pathlib import Path

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, docs, corpus, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    good = written(stage["quality"](spark, docs, ""))
    assert {k for k, _ in rows(good)} >= set(range(40)) and good.columns == docs.columns
    lined = written(stage["shared_lines"](spark, good, ""))
    assert {k: t for k, t in rows(lined)} == {k: t for k, (_, _, t) in reference.line_dedup(rows(good)).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    single = written(stage["near_copies"](spark, lined, ""))
    assert sorted(k for k, _ in rows(single)) == sorted({c for c, _ in reference.jaccard_classes(rows(lined)).values()})
    mixed = written(stage["source_mix"](spark, single, ""))
    assert set(Counter(k for k, _ in rows(mixed)).values()) <= {1, 2} and mixed.columns == docs.columns
    taken = mix_sources(single, with_text=False).where("taken > 0")
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in taken.collect()}
    assert Counter(k for k, _ in rows(mixed)) == copies
    encoded = stage["encode"](spark, mixed, "")
    texts = dict(rows(mixed))
    assert all(r["decoded_sha256"] == reference.sha(texts[r["doc_id"]]) for r in encoded.collect())


@needs_data
def test_run(spark):
    found = corpus_pipeline.run(spark, DATA).toPandas()
    assert len(found) > 50 and found["n_tokens"].min() > 0


@needs_data
@pytest.mark.parametrize("name", ORACLE)
def test_queries_with_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected, got = connection.execute(ORACLE[name]).fetch_df(), QUERIES[name](spark, DATA).toPandas()
    columns = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(columns, ignore_index=True), expected[columns].sort_values(columns, ignore_index=True), check_dtype=False)


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    """Null ids and texts, repeated rows, and columns with names that stages use."""
    clashing = {name: F.lit("x") for name in ("_one", "row", "col", "_kept_id", "_kept_id_of_row", "_row", "_text", "taken", "size")}
    docs = odd.withColumns(clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, "")
        assert left.columns == docs.columns, name
        got = left.collect()
        known = {(row["doc_id"], row["source"], row["taken"]) for row in docs.collect()}
        assert got and {(row["doc_id"], row["source"], row["taken"]) for row in got} <= known, name
        assert stage(spark, empty, "").count() == 0, name
    single = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert len({(row["doc_id"], row["text"]) for row in single}) == len(single)
    assert corpus_pipeline.encode(spark, docs, "").count() == odd.count() and corpus_pipeline.encode(spark, empty, "").count() == 0
