"""Queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import digest_columns, encode_column
from .html_extract import extract_pages
from .media import media_columns
from .ngram_join import ngram_components
from .ngram_lm import train_and_score
from .packing import pack_documents
from .quality_classifier import fit_classifier, score_documents
from .quality_rules import rule_report
from .sharding import interleaved_shards
from .shared import read_table
from .substring_dedup import dedup_report


def word_vocabulary() -> str:
    """Path of the public word-level vocabulary; the file is read where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels are learned outside the holdout only."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit_classifier(docs, read_table(spark, sf_dir, "labels")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose counts differ by one at most."""
    return interleaved_shards(read_table(spark, sf_dir, "documents"), shards=8)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_components(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' payloads in tar shards, read back with their features."""
    return media_columns(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that occur earlier, and where these were."""
    return dedup_report(read_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, id digests and decoded digests of all documents."""
    return digest_columns(encode_column(read_table(spark, sf_dir, "documents"), word_vocabulary()))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a trigram model of those outside the holdout."""
    return train_and_score(read_table(spark, sf_dir, "documents"), order=3)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows of 4096."""
    return pack_documents(read_table(spark, sf_dir, "documents"), word_vocabulary())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of all documents, with cutoffs from the labelled ones."""
    return rule_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_media, op4_bpe, op5_sharding, op6_substring_dedup, op7_lm, op8_html, op9_quality_rules, op10_packing)}
#: SQL that DuckDB runs over whole tables. The others hold fitted models, hashes, tokens or files that SQL doesn't
#: express; tests hold them against brute force, exact round trips or held-out labels.
ORACLE: dict[str, str] = {"op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * k >= 90 * (nx + ny - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM s LEFT JOIN m ON doc_id = x"""}
