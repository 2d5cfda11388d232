"""The corpus pipeline: five stages, each on the documents that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result as Parquet in the folder that executors share and reads it again. Before a stage, executors
give back the heap that the one before has grown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.ngram_join import ngram_components
from lexweave.llm.packing import pack_documents
from lexweave.llm.quality_classifier import fit_classifier, keep_quality
from lexweave.llm.quality_rules import keep_good
from lexweave.llm.queries import word_vocabulary
from lexweave.llm.shared import materialize, read_table, release_heap
from lexweave.llm.substring_dedup import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more.

    Null and empty texts get the score of a text without words. Rows that repeat are judged alike; ids and other
    columns have no part in it. Without labelled rows every document gets 0.5 and stays.
    """
    release_heap(spark)
    return keep_quality(docs, fit_classifier(docs, read_table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the risk-controlled rules of their language.

    Null and empty texts have no words and go. Rows that repeat are judged alike. A null language is one of its own. Without
    labels the base test alone decides.
    """
    release_heap(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Of rows that repeat an id, which are one document, the one with the smallest text stays, by the other columns where texts
    are equal. Rows with a null id all stay, and so do null and empty texts, which resemble nothing.
    """
    release_heap(spark)
    groups = ngram_components(docs, n=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    rest = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_row"))
    return one.select(*("doc_id" if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; n_chars follows the text.

    Null and empty texts stay as they are, and so do rows with a null id. A document of which nothing is left goes.
    """
    release_heap(spark)
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens.

    Null and empty texts are the end token alone. Rows that repeat are packed each on its own; a null id stays null.
    """
    release_heap(spark)
    return pack_documents(docs, word_vocabulary())


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]
#: Tokenisation, window packing and the fitted stages are beyond SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
