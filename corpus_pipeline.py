"""From raw documents to packed training sequences.

Each stage is a function of (spark, docs, folder of the tables); what it returns is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoiceloom.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from invoiceloom.llm.catalog import table, tokenizer
from invoiceloom.llm.rows import packed, unpacked, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.7; the model learns from the labelled rows of the raw table."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = docs.select(packed(docs)).withColumn("score", quality_classifier.quality_score(model, F.col("row.text")))
    return unpacked(scored.where(F.col("score") >= quality_classifier.THRESHOLD), docs.columns, {})


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rule model keep."""
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.with_rules(docs, model).where("kept").select(*docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, ``n_chars`` counted anew."""
    kept = line_dedup.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those that are similar to one with a smaller id, through others or directly; null ids stay."""
    groups = ngram_join.similar_documents(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence."""
    return packing.packed_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("quality_rules", by_rules),
    ("line_dedup", own_lines),
    ("ngram_join", one_of_each_group),
    ("best_fit_packing", sequences),
]

#: Two stages score with trained models and one plans a packing, which SQL can't state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
