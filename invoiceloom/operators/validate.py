"""Fiscal checks with exact decimals.

A line is compared as base * rate against amount * 100, so no division can round.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MONEY_TOLERANCE, MSG_TOTALS

WARNING = "struct<code:string,message:string,field:string>"
CODES = ("net_amount_mismatch", "tax_amount_mismatch", "tax_line_mismatch", "gross_amount_mismatch")


def _tolerance(value) -> Column:
    return F.lit(str(value)).cast("decimal(9,4)")


def differs(left: Column, right: Column, tolerance=MONEY_TOLERANCE) -> Column:
    return F.abs(left - right) > _tolerance(tolerance)


def line_differs(rate: Column, base: Column, amount: Column, tolerance=MONEY_TOLERANCE) -> Column:
    return F.abs(base * rate - amount * F.lit(100)) > _tolerance(tolerance) * 100


def expected_gross(net: Column, tax: Column, advance: Column, withholding: Column) -> Column:
    zero = F.lit("0.00").cast("decimal(3,2)")
    return net + tax - F.coalesce(advance, zero) - F.coalesce(withholding, zero)


def total_warnings(lines: Column, totals: Column, tolerance=MONEY_TOLERANCE) -> Column:
    """All warnings of one record, in order, from its array of lines and its totals."""

    def summed(name: str) -> Column:
        zero = F.lit("0.00").cast("decimal(38,6)")
        return F.aggregate(lines, zero, lambda a, x: (a + x[name]).cast("decimal(38,6)"))

    def warning(code: str, field: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"), F.lit(MSG_TOTALS[code]).alias("message"), field.alias("field")
        )

    net, tax, gross = totals["net_amount"], totals["tax_amount"], totals["gross_amount"]
    by_line = F.transform(
        lines,
        lambda x, i: F.when(
            line_differs(x["tax_rate"], x["tax_base"], x["tax_amount"], tolerance),
            warning(
                "tax_line_mismatch",
                F.concat(F.lit("tax_lines["), i.cast("string"), F.lit("].tax_amount")),
            ),
        ),
    )
    want = expected_gross(net, tax, totals["advance_amount"], totals["withholding_amount"])
    head = F.array(
        F.when(
            differs(summed("tax_base"), net, tolerance),
            warning("net_amount_mismatch", F.lit("totals.net_amount")),
        ),
        F.when(
            differs(summed("tax_amount"), tax, tolerance),
            warning("tax_amount_mismatch", F.lit("totals.tax_amount")),
        ),
    )
    tail = F.array(
        F.when(
            differs(want, gross, tolerance),
            warning("gross_amount_mismatch", F.lit("totals.gross_amount")),
        )
    )
    return F.array_compact(F.concat(head, by_line, tail))


def validate_totals(lines: DataFrame, totals: DataFrame, tolerance=MONEY_TOLERANCE) -> DataFrame:
    """Warnings of a corpus: doc_id, rank, code, field, message.

    Lines are summed per document before the join, so a document with very many
    lines is added up map-side; line checks never leave their row.
    """
    sums = lines.groupBy("doc_id").agg(
        F.sum("tax_base").alias("sum_base"), F.sum("tax_amount").alias("sum_tax")
    )
    zero = F.lit("0.00").cast("decimal(3,2)")
    joined = totals.join(sums, "doc_id", "left")

    def warning(code: str, wrong: Column, field: str) -> Column:
        return F.when(
            wrong,
            F.struct(
                F.lit(CODES.index(code) + 1).alias("rank"),
                F.lit(code).alias("code"),
                F.lit(field).alias("field"),
            ),
        )

    of_totals = F.array(
        warning(
            "net_amount_mismatch",
            differs(F.coalesce("sum_base", zero), F.col("net_amount"), tolerance),
            "totals.net_amount",
        ),
        warning(
            "tax_amount_mismatch",
            differs(F.coalesce("sum_tax", zero), F.col("tax_amount"), tolerance),
            "totals.tax_amount",
        ),
        warning(
            "gross_amount_mismatch",
            differs(
                expected_gross(
                    F.col("net_amount"),
                    F.col("tax_amount"),
                    F.col("advance_amount"),
                    F.col("withholding_amount"),
                ),
                F.col("gross_amount"),
                tolerance,
            ),
            "totals.gross_amount",
        ),
    )
    from_totals = joined.select("doc_id", F.inline(F.array_compact(of_totals)))
    return from_totals.unionByName(
        line_warnings(lines, tolerance).select("doc_id", "rank", "code", "field")
    ).withColumn("message", warning_message(F.col("code")))


def line_warnings(lines: DataFrame, tolerance=MONEY_TOLERANCE) -> DataFrame:
    """Lines whose amount is not base * rate / 100; the field carries the line's number."""
    return lines.filter(
        line_differs(F.col("tax_rate"), F.col("tax_base"), F.col("tax_amount"), tolerance)
    ).select(
        "doc_id",
        F.lit(3).alias("rank"),
        F.lit("tax_line_mismatch").alias("code"),
        F.concat(F.lit("tax_lines["), F.col("line_no").cast("string"), F.lit("].tax_amount")).alias(
            "field"
        ),
        "line_no",
    )


def warning_message(code: Column) -> Column:
    """Warning code to its text."""
    text = F.lit(None).cast("string")
    for name in CODES:
        text = F.when(code == name, F.lit(MSG_TOTALS[name])).otherwise(text)
    return text
