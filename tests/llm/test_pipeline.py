"""The queries on a small table, and the stages one after the other."""

from __future__ import annotations

import hashlib
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_harness import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from feedweir.llm import near, phrases, quality, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op9_feistel_shards", "op12_spelling_variants"}))
def test_query_equals_its_sql(spark, sf_dir, name):
    n, error = compare(connect(sf_dir), spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])
    assert error is None and n > 0, error


def test_checksummed_queries_equal_their_sql(spark, tmp_path):
    rows = [(i * 3, "text é %d checksum checksums checksün" % i if i % 5 else None) for i in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op9_feistel_shards", "op12_spelling_variants"):
        _, error = compare(con, spark, str(tmp_path), queries.QUERIES[name], queries.ORACLES[name])
        assert error is None, error


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, sf_dir)
    assert kept.schema == docs.schema and 0.5 * docs.count() < kept.count() <= docs.count()
    single = corpus_pipeline.near_dedup(spark, kept, sf_dir)
    assert single.schema == docs.schema and single.count() == near.near_duplicates(kept).select("class_id").distinct().count()
    cut = corpus_pipeline.substring_dedup(spark, single, sf_dir)
    assert cut.schema == docs.schema and cut.count() == single.count()
    want = {r.doc_id: r.kept_sha256 for r in phrases.remove_repeats(single).collect()}
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in cut.collect()}
    assert {i: hashlib.sha256(" ".join(x).encode()).hexdigest() for i, x in words.items()} == want
    mixed = corpus_pipeline.source_mixing(spark, cut, sf_dir)
    assert mixed.schema == docs.schema and mixed.count() > 0
    pieces = corpus_pipeline.pack(spark, mixed, sf_dir)
    assert pieces.selectExpr("sum(length) = sum(IF(start = 0, doc_tokens, 0))").first()[0]


def test_run_gives_pieces(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_on_messy_and_empty_tables(spark, sf_dir, messy, none, tmp_path):
    """Nulls, ties, repeated rows, very long texts and no rows at all go through every stage."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, docs in (("messy", messy), ("none", none)):
        folder = f"{tmp_path}/{name}"
        docs.selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder)
        assert pieces.where("length <= 0 OR offset + length > 2048").count() == 0
        assert (pieces.count() == 0) == (name == "none")


def test_filters_on_an_empty_table(spark, sf_dir, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert quality.accepted(none, labels).count() == 0 and near.one_of_each(none).count() == 0
