"""Extraction of newly landed documents.

Documents land in folders ``<root>/<table>/landing=<name>``; the manifest gets a row
per document once all its rows are there.  The stream follows the manifest, so a
micro-batch only ever sees whole documents and no state is kept.  Output is written
per batch id and overwritten when a batch is replayed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import TABLES, extract_invoices
from ..sources.landed import table_schema

MANIFEST = "doc_id bigint, landing string"


def landed_in(spark: SparkSession, root: str, name: str, landings: list[str]) -> DataFrame:
    """Rows of a table from the given landing folders; a landing may lack the table."""
    folder = f"{root}/{name}"
    paths = [f"{folder}/landing={x}" for x in landings]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if jvm_path(p).getFileSystem(hadoop).exists(jvm_path(p))]
    schema = table_schema(name, "landing string")
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*there)


def extract_batch(batch: DataFrame, batch_id: int, root: str, out: str) -> None:
    """Extract the documents of one micro-batch; only their landing folders are read.

    The names of the folders come to the driver: as many as the manifest files of the
    batch name.  A document that landed twice in the batch is taken from its last landing.
    """
    spark = batch.sparkSession
    documents = batch.groupBy("doc_id").agg(F.max("landing").alias("landing")).persist()
    try:
        landings = [r.landing for r in documents.select("landing").distinct().collect()]
        tables = {
            name: landed_in(spark, root, name, landings)
            .join(documents, ["doc_id", "landing"], "left_semi")
            .drop("landing")
            for name in TABLES
        }
        (
            extract_invoices(tables)
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out)
        )
    finally:
        documents.unpersist()


def latest_responses(spark: SparkSession, out: str) -> DataFrame:
    """One response per document: that of the last batch it landed in."""
    rows = spark.read.parquet(out)
    whole = F.struct(*rows.columns)
    return rows.groupBy("doc_id").agg(F.max_by(whole, "batch_id").alias("r")).select("r.*")


def extract_landings(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    max_files_per_batch: int = 100,
    **trigger,
):
    """Start the stream; by default it works off everything that has landed and stops.

    ``max_files_per_batch`` manifest files make a batch at most; the rest waits for the next.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        extract_batch(batch, batch_id, root, out)

    return (
        spark.readStream.schema(MANIFEST)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .parquet(f"{root}/manifest")
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
