"""Tax lines out of table cells.

A cell with a percent sign never reads as money and a cell with a withholding mark
neither, so base and amount are the first two money cells of a row, whichever cell
holds the rate.  All work is keyed by the table row, so a document with very many
tables spreads over tasks; a row itself is only as wide as its table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import (
    contains_any,
    contains_count,
    first_withholding_amount,
    strip,
    table_money,
    table_rate,
)

ROW_KEY = ("doc_id", "page", "table_seq", "row")


def looks_like_tax_table(text: Column) -> Column:
    return contains_count(F.lower(text), fv.TABLE_SIGNS) >= 2


def is_header_text(row_text: Column) -> Column:
    """Header test on the joined text of a row."""
    return contains_count(F.lower(row_text), fv.HEADER_WORDS) >= 2


def cells_from_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that look like tax tables -> cells: lines are rows, tabs or pipes part cells.

    Blank lines and cells are left out after numbering.  The box of a cell is its
    share of an even grid over the block.
    """
    lines = blocks.filter(looks_like_tax_table(F.col("text"))).select(
        "doc_id",
        "page",
        F.col("block_seq").alias("table_seq"),
        "bbox",
        "confidence",
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.posexplode(F.split("text", "\n")).alias("row", "line"),
    )
    parts = F.split(strip(F.col("line")), fv.CELL_BREAK)
    cells = (
        lines.filter(strip(F.col("line")) != "")
        .select("*", F.size(parts).alias("n_parts"), F.posexplode(parts).alias("col", "raw"))
        .withColumn("text", strip(F.col("raw")))
        .filter(F.col("text") != "")
    )
    width = (F.col("bbox.x1") - F.col("bbox.x0")) / F.col("n_parts")
    height = (F.col("bbox.y1") - F.col("bbox.y0")) / F.col("n_lines")
    return cells.select(
        "doc_id",
        "page",
        "table_seq",
        F.lit("tax_table").alias("kind"),
        "row",
        "col",
        "text",
        F.struct(
            (F.col("bbox.x0") + F.col("col") * width).alias("x0"),
            (F.col("bbox.y0") + F.col("row") * height).alias("y0"),
            (F.col("bbox.x0") + (F.col("col") + 1) * width).alias("x1"),
            (F.col("bbox.y0") + (F.col("row") + 1) * height).alias("y1"),
        ).alias("bbox"),
        "confidence",
    )


def table_sizes(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table."""
    return cells.groupBy("doc_id", "page", "table_seq", "kind").agg(
        (F.max("row") + 1).alias("table_rows"), (F.max("col") + 1).alias("table_cols")
    )


def row_offsets(tables: DataFrame) -> DataFrame:
    """Offset that makes row numbers of kept tables unique on a page."""
    kept = tables.filter(F.col("kind").isin(*fv.TABLE_KINDS))
    earlier = (
        Window.partitionBy("doc_id", "page")
        .orderBy("table_seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return kept.withColumn(
        "row_offset", F.coalesce(F.sum(F.col("table_rows") + 1).over(earlier), F.lit(0))
    )


def cells_from_grid(grids: DataFrame) -> DataFrame:
    """Grids of texts (arrays of rows of cells) -> cells of tables.

    ``table_seq`` tells grids of one page apart; grids without it are the only ones of their page.
    """
    number = F.col("table_seq") if "table_seq" in grids.columns else F.lit(0)
    rows = grids.select(
        "doc_id", "page", number.cast("int").alias("table_seq"), F.posexplode("rows").alias("row", "cells")
    )
    zero = F.lit(0.0)
    return (
        rows.select("doc_id", "page", "table_seq", "row", F.posexplode("cells").alias("col", "raw"))
        .withColumn("text", strip(F.col("raw")))
        .filter(F.col("text") != "")
        .select(
            "doc_id",
            "page",
            "table_seq",
            F.lit("unknown").alias("kind"),
            "row",
            "col",
            "text",
            F.struct(zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1")).alias(
                "bbox"
            ),
            F.lit(fv.GRID_CELL_CONFIDENCE).alias("confidence"),
        )
    )


def row_confidence(rate: Column, base: Column, amount: Column, first: Column) -> Column:
    """Confidence of a row from its first cell and from how well the amount fits."""
    fits = F.abs(base * rate - amount * 100) <= F.lit(fv.ROW_AMOUNT_TOLERANCE).cast("decimal(9,4)") * 100

    def capped(weight: float, cap: float) -> Column:
        return F.least(F.lit(cap), (first + fv.ROW_RATE_CONFIDENCE + weight) / 3)

    return (
        F.when(base.isNull() | amount.isNull(), (first + fv.ROW_RATE_CONFIDENCE) / 2)
        .when(fits, capped(fv.ROW_MATCH_WEIGHT, fv.ROW_MATCH_CAP))
        .otherwise(capped(fv.ROW_MISMATCH_WEIGHT, fv.ROW_MISMATCH_CAP))
    )


def tax_line_candidates(cells: DataFrame) -> DataFrame:
    """Tax lines of all kept tables, one per row that has a rate and is no header.

    A row with a rate holds the word ``%``, so it is a header as soon as any other
    header word occurs in it.
    """
    lowered = F.lower("text")
    read = cells.filter(F.col("kind").isin(*fv.TABLE_KINDS)).select(
        *ROW_KEY,
        "col",
        "bbox",
        "confidence",
        table_rate(F.col("text")).alias("rate"),
        table_money(F.col("text")).alias("money"),
        F.when(
            F.contains(lowered, F.lit(fv.WITHHOLDING_MARK)), first_withholding_amount(F.col("text"))
        ).alias("withheld"),
        contains_any(lowered, [w for w in fv.HEADER_WORDS if w != "%"]).alias("header_word"),
    )
    money_so_far = F.count("money").over(
        Window.partitionBy(*ROW_KEY)
        .orderBy("col")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    has_rate, is_money = F.col("rate").isNotNull(), F.col("money").isNotNull()
    held_at = F.struct("col", "withheld")
    held = F.col("withheld").isNotNull()
    rows = (
        read.withColumn("money_rank", money_so_far)
        .groupBy(*ROW_KEY)
        .agg(
            F.min(F.when(has_rate, F.struct("col", "rate"))).alias("rate_cell"),
            F.max(F.when(is_money & (F.col("money_rank") == 1), F.col("money"))).alias("tax_base"),
            F.max(F.when(is_money & (F.col("money_rank") == 2), F.col("money"))).alias("tax_amount"),
            F.min(F.struct("col", "confidence")).alias("first_cell"),
            F.max(F.when(held & ~has_rate, held_at)).alias("held_plain"),
            F.max(F.when(held & has_rate, held_at)).alias("held_rated"),
            F.bool_or("header_word").alias("header"),
            F.max("confidence").alias("top_confidence"),
            F.struct(
                F.min("bbox.x0").alias("x0"),
                F.min("bbox.y0").alias("y0"),
                F.max("bbox.x1").alias("x1"),
                F.max("bbox.y1").alias("y1"),
            ).alias("bbox"),
        )
        .filter(F.col("rate_cell").isNotNull() & ~F.col("header"))
    )
    # A withholding counts unless it stands in the first cell or in the rate cell itself.
    plain = F.when(F.col("held_plain.col") > F.col("first_cell.col"), F.col("held_plain"))
    rated = F.when(F.col("held_rated.col") > F.col("rate_cell.col"), F.col("held_rated"))
    return rows.select(
        *ROW_KEY,
        F.col("rate_cell.rate").alias("tax_rate"),
        "tax_base",
        "tax_amount",
        F.greatest(plain, rated)["withheld"].alias("withholding_amount"),
        row_confidence(
            F.col("rate_cell.rate"),
            F.col("tax_base"),
            F.col("tax_amount"),
            F.col("first_cell.confidence"),
        ).alias("confidence"),
        "bbox",
        F.when(F.col("top_confidence") < 1.0, "synthetic").otherwise("layout").alias("source"),
    )


def table_totals(lines: DataFrame) -> DataFrame:
    """Sums and mean confidence of the table lines of each document."""
    zero = F.lit("0.00").cast("decimal(28,2)")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.coalesce("tax_base", zero)).alias("net_amount"),
        F.sum(F.coalesce("tax_amount", zero)).alias("tax_amount"),
        F.avg("confidence").alias("confidence"),
    )


def table_warnings(documents: DataFrame, cells: DataFrame, lines: DataFrame, grid: bool = False) -> DataFrame:
    """Documents whose tables gave nothing: doc_id, message.

    ``grid`` picks the wording for tables handed over as grids of text.
    """
    kept = (
        cells.filter(F.col("kind").isin(*fv.TABLE_KINDS))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_cells"))
    )
    no_cells, no_lines = (
        (fv.MSG_GRID_BLANK, fv.MSG_GRID_NO_LINES) if grid else (fv.MSG_NO_TABLES, fv.MSG_NO_TABLE_LINES)
    )
    return (
        documents.select("doc_id")
        .join(lines.select("doc_id"), "doc_id", "left_anti")
        .join(kept, "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("n_cells").isNull(), no_cells).otherwise(no_lines).alias("message"),
        )
    )


def grid_warnings(grids: DataFrame) -> DataFrame:
    """Warnings of grids of text; a grid without any row is told apart from a blank one."""
    empty = grids.filter(F.size("rows") == 0).select(
        "doc_id", F.lit(fv.MSG_GRID_EMPTY).alias("message")
    )
    filled = grids.filter(F.size("rows") > 0)
    cells = cells_from_grid(filled)
    return empty.unionByName(table_warnings(filled, cells, tax_line_candidates(cells), grid=True))
