"""Landed tables, ground truth and predictions; responses and reports as JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

_SCHEMAS = {
    "blocks": schemas.BLOCKS,
    "page_text": schemas.PAGE_TEXT,
    "page_images": schemas.PAGE_IMAGES,
    "attachments": schemas.ATTACHMENTS,
    "ocr_lines": schemas.OCR_LINES,
    "table_cells": schemas.TABLE_CELLS,
    "model_responses": schemas.MODEL_RESPONSES,
}


def table_schema(name: str, partitions: str = "") -> str:
    return _SCHEMAS[name] + (f", {partitions}" if partitions else "")


def read_landed(spark: SparkSession, folder: str, name: str, partitions: str = "") -> DataFrame:
    """A landed table by name, with its fixed schema and its partition columns, if any."""
    return spark.read.schema(table_schema(name, partitions)).parquet(f"{folder}/{name}")


def read_corpus(spark: SparkSession, folder: str) -> dict:
    names = ("page_text", "page_images", "attachments", "blocks", "ocr_lines")
    return {name: read_landed(spark, folder, name) for name in names}


def read_expected(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ground truth: JSON arrays of {invoice_file, invoice_type, expected}, or one object a line."""
    return spark.read.schema(schemas.EXPECTED).option("multiLine", not lines).json(path)


def write_expected(records: DataFrame, path: str) -> None:
    """Ground truth, one object a line; missing values stay in the record."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_predicted(spark: SparkSession, folder: str, bulk: bool = False) -> DataFrame:
    """Predictions: invoice_key, predicted, broken.

    One JSON file per invoice, named after it, keyed by the name without suffix; ``bulk`` reads
    what ``write_predicted`` wrote, many predictions a file.  A prediction that is no JSON
    record (cut off, a list, plain text) counts as none: its record is NULL and ``broken``
    holds the text.  An empty file is a missing one.
    """
    if bulk:
        texts = spark.read.schema("invoice_key string, text string").json(folder)
    else:
        files = spark.read.option("wholetext", True).text(folder)
        texts = files.select(file_key(F.col("_metadata.file_name")).alias("invoice_key"), F.col("value").alias("text"))
    shape = f"struct<{schemas.RECORD_TEXT[7:-1]},_corrupt_record:string>"
    read = texts.withColumn("r", F.from_json("text", shape))
    whole = F.col("r._corrupt_record").isNull() & F.startswith(F.ltrim("text"), F.lit("{"))
    broken = ~F.coalesce(F.col("r").isNotNull() & whole, F.lit(False))
    return read.select(
        "invoice_key",
        F.when(~broken, F.col("r").dropFields("_corrupt_record")).alias("predicted"),
        F.when(broken, F.coalesce("text", F.lit(""))).alias("broken"),
    )


def write_predicted(predictions: DataFrame, folder: str) -> None:
    """Predictions (invoice_file, text) with their keys, many a file: millions of single files would cost more than their content."""
    keyed = predictions.select(file_key(F.col("invoice_file")).alias("invoice_key"), "text")
    keyed.write.mode("overwrite").json(folder)


def file_key(name):
    """File name without its last suffix."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def response_json(responses: DataFrame) -> DataFrame:
    """Responses in the shape consumers read.

    The score goes by the name ``global``; amounts and rates are text, so that no reader
    takes them for floating point.
    """
    as_text = F.col("invoice").cast(schemas.INVOICE.replace("decimal(7,4)", "string").replace("decimal(28,2)", "string"))
    return responses.select(
        "doc_id",
        *[c for c in ("kind", "route") if c in responses.columns],
        "status",
        as_text.alias("invoice"),
        F.struct(
            F.col("global_score").alias("global"), "fields", "needs_review"
        ).alias("confidence"),
        "warnings",
        "errors",
        "evidence",
    )


def write_responses(responses: DataFrame, path: str, fmt: str = "json", run_id: str | None = None) -> None:
    """Responses as JSON; with a run id they replace what that run wrote before, and nothing else.

    The files of a run are gzipped: while it is overwritten, its old and its new files are both on disk.
    """
    shaped = response_json(responses)
    if run_id is None:
        shaped.write.mode("overwrite").format(fmt).save(path)
        return
    _overwrite_run(shaped, path, run_id, fmt, **({"compression": "gzip"} if fmt == "json" else {}))


def _overwrite_run(rows: DataFrame, path: str, run_id: str, fmt: str, *parts: str, **options: str) -> None:
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .options(**options)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", *parts)
        .format(fmt)
        .save(path)
    )


def read_responses(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Written responses in the form they had before: typed amounts, the score as ``global_score``."""
    text_invoice = schemas.INVOICE.replace("decimal(7,4)", "string").replace("decimal(28,2)", "string")
    shape = (
        f"doc_id bigint, kind string, route string, status string, invoice {text_invoice}, "
        f"confidence struct<global:double,fields:map<string,double>,needs_review:array<string>>, "
        f"warnings array<string>, errors {schemas.ERRORS}, evidence {schemas.EVIDENCE}"
    )
    rows = spark.read.schema(shape + ("" if run_id is None else ", run_id string")).json(path)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return rows.select(
        "doc_id", "kind", "route", "status", F.col("invoice").cast(schemas.INVOICE).alias("invoice"),
        F.col("confidence.global").alias("global_score"), F.col("confidence.fields").alias("fields"),
        F.col("confidence.needs_review").alias("needs_review"), "warnings", "errors", "evidence",
    )


LEVEL = "key string, fields bigint, errors bigint, score double, accuracy double"
FIELD_RESULT = (
    "invoice_file string, invoice_type string, field_path string, expected_value string, predicted_value string, "
    "match boolean, score double, metric string, detail string"
)


def write_report(results: DataFrame, levels: DataFrame, folder: str, run_id: str | None = None) -> None:
    """Evaluation report: field results and one data set per level of the roll-ups.

    Eight rows an invoice repeat their names and texts, so the files are gzipped JSON; while a run
    is overwritten, its old and its new files are both on disk.
    """
    if run_id is None:
        results.write.mode("overwrite").json(f"{folder}/fields", compression="gzip")
        levels.write.mode("overwrite").partitionBy("level").json(f"{folder}/levels", compression="gzip")
        return
    _overwrite_run(results, f"{folder}/fields", run_id, "json", compression="gzip")
    _overwrite_run(levels, f"{folder}/levels", run_id, "json", "level", compression="gzip")


def read_report(spark: SparkSession, folder: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(field results, levels) of a run."""
    results = spark.read.schema(FIELD_RESULT + ", run_id string").json(f"{folder}/fields")
    levels = spark.read.schema(LEVEL + ", run_id string, level string").json(f"{folder}/levels")
    return tuple(x.filter(F.col("run_id") == run_id).drop("run_id") for x in (results, levels))
