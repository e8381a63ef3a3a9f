"""The dealt operators as queries, and the pipeline, on the smallest tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from driftlens.staging import stage

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_": "doc_id size source_size target taken",
    "op3_": "query_id rank vec_id score",
    "op4_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_": "doc_id n_shingles component_id",
    "op7_": "doc_id held_out lang_pred score",
    "op8_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_": "doc_id held_out score predicted",
    "op10_": "doc_id n_tokens",
    "op11_": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_": "vec_id code error label_error codebooks_sha256",
}


def test_every_operator_has_one_query():
    names = [n for n in entry_point.queries() if re.match(r"op\d+_", n)]
    assert len(names) == 13 and {re.match(r"op\d+_", n)[0] for n in names} == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(n for n in entry_point.queries() if re.match(r"op\d+_", n)))
def test_columns(spark, name):
    frame = entry_point.queries()[name](spark, DATA)
    assert set(COLUMNS[re.match(r"op\d+_", name)[0]].split()) <= set(frame.columns)
    count = frame.count()
    if name[:4] == "op11":
        assert count > 0
    elif name[:4] in ("op3_", "op8_", "op13"):
        assert count >= 200
    else:
        assert count == 200


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "packing"]
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, DATA), "test-stage")
        if name == "packing":
            break
        assert out.columns == docs.columns
        assert 0 < out.count() and out.select("doc_id").distinct().count() <= docs.select("doc_id").distinct().count()
        if name in ("near_duplicates", "repeated_passages"):
            assert out.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count()
        docs = out
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 2048").count() <= 1


def test_close_languages_are_no_reason_to_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("text").rlike("[A-Za-z]"))
    pair = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("en-GB"))
    assert corpus_pipeline.known_language(spark, pair, DATA).count() == pair.count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry_point.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    cursor = connection.execute(entry_point.oracle_sql()[name])
    names = sorted(c[0] for c in cursor.description)
    expected = sorted(tuple(dict(zip([c[0] for c in cursor.description], r))[n] for n in names) for r in cursor.fetchall())
    frame = entry_point.queries()[name](spark, DATA)
    assert sorted(frame.columns) == names
    assert sorted(tuple(r[n] for n in names) for r in frame.collect()) == expected
