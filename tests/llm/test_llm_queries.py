"""The registered queries: names, columns of the contracts, and SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexweave.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_quality": "doc_id held_out score predicted",
    "op2_ngram_join": "doc_id n_shingles component_id",
    "op3_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_substring_dedup": "doc_id text spans",
    "op7_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_html": "page_id url text n_chars",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


def test_registered():
    assert set(QUERIES) == set(COLUMNS) and {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = spark.read.parquet(f"{small}/{'pages' if name == 'op8_html' else 'documents'}.parquet").count()
    assert df.count() >= rows if name == "op10_packing" else df.count() == rows


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())


def test_quality_on_held_out_labels(spark, small):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{small}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = QUERIES["op1_quality"](spark, small).where("held_out").join(labels, "doc_id").collect()
    assert rows and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_language_model_beats_single_words(spark, small):
    base, score = QUERIES["op7_lm"](spark, small).where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base
