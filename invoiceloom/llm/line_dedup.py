"""Lines that many documents share, dropped everywhere but in one document.

Explode the normalised lines, hash them, count the distinct documents of each hash, drop lines over the
threshold and put the rest together by position. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm.rows import BLANKS, ascii_lower, column, packed, unpacked, written

MIN_DOCUMENTS = 3
MIN_CHARACTERS = 20


def line_key(line: Column) -> Column:
    """A line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_characters: int = MIN_CHARACTERS,
) -> DataFrame:
    """Rows of ``df`` with shared lines dropped from ``text_column``, plus ``n_lines`` and ``n_dropped``.

    A line's key is hashed to 96 bits. Keys of at least ``min_characters`` code points that at least ``min_documents``
    distinct ids hold lose all their lines, except in the largest id that holds them.

    Null or empty text is one empty line. Rows that repeat an id count as one document and each come out; equal rows
    come out equal. Rows with a null id count towards no threshold and lose every shared line. An empty table gives an empty one.
    Columns of ``df`` called ``n_lines`` or ``n_dropped`` are replaced, all others stay as they are.
    """
    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    rows = df.select(packed(df)).select("row", F.col("row")[id_column].alias("id"), text.alias("body"))
    rows = rows.withColumn("body_hash", F.xxhash64("body"))

    source = df.select(column(id_column).alias("id"), F.coalesce(column(text_column), F.lit("")).alias("body"))
    lines = source.select(
        "id", F.xxhash64("body").alias("body_hash"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")
    ).withColumn("key", line_key(F.col("line")))
    hashed = lines.where(F.length("key") >= min_characters).select(
        "id", "body_hash", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")
    )
    shared = (
        hashed.groupBy("h1", "h2")
        .agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_documents)
        .drop("n")
    )
    # written first, so that the join below exchanges both sides itself and may split a line that a third of all documents hold
    shared = written(shared, "shared-lines")
    dropped = (
        hashed.join(shared, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "body_hash")
        .agg(F.collect_set("pos").alias("gone"))  # at most the lines of one text
    )
    left, right = rows.alias("l"), dropped.alias("r")
    met = left.join(
        right,
        F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.body_hash") == F.col("r.body_hash")),
        "left",
    ).select("row", "body", "gone")
    split = met.withColumn("parts", F.split("body", "\n", -1)).withColumn("n_lines", F.size("parts"))
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone"))  # hashed, keeps the order
    rest = F.array_join(F.transform(places, lambda p: F.get(F.col("parts"), p)), "\n")
    return unpacked(
        split,
        df.columns,
        {
            text_column: F.when(F.col("gone").isNull(), F.col("body")).otherwise(rest),
            "n_lines": F.col("n_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        },
    )
