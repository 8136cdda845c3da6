"""Invoices derived from the order tables.

One order is one invoice: the buyer is the customer, the seller is the supplier
of its first line, and lines are summed per tax rate.  Printed values carry
planned defects chosen by document number, so checks have something to find:

    doc % 17 = 3   wrong control character in the seller's tax id
    doc % 11 = 5   gross amount 1.00 too high
    doc % 13 = 7   first tax amount 0.02 too high
    doc % 41 = 11  31 February as date
    doc % 37 = 10  no text at all
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CIF_LETTERS, NIF_LETTERS
from ..functions.tax_ids import cif_control_digit

AMOUNT = "decimal(18,2)"
RATES = (21, 10, 4)
_LINE_SHIFT = 1 << 40


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(number: Column, width: int) -> Column:
    return F.lpad((number % 10**width).cast("string"), width, "0")


def _nif_letter(number: Column) -> Column:
    return F.substring(F.lit(NIF_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def _customer_tax_id(key: Column) -> Column:
    prefix = F.floor(key / 5) % 3
    foreign = F.concat(
        F.substring(F.lit("XYZ"), (prefix + 1).cast("int"), F.lit(1)),
        _digits(key, 7),
        _nif_letter(prefix * 10**7 + key % 10**7),
    )
    return F.when(key % 5 == 0, foreign).otherwise(
        F.concat(_digits(key, 8), _nif_letter(key % 10**8))
    )


def _supplier_tax_id(key: Column, wrong: Column) -> Column:
    digit = (cif_control_digit(_digits(key, 7)) + wrong.cast("int")) % 10
    letter = F.substring(F.lit(CIF_LETTERS), (digit + 1).cast("int"), F.lit(1))
    return F.concat(
        F.substring(F.lit("BPF"), (key % 3 + 1).cast("int"), F.lit(1)),
        _digits(key, 7),
        F.when(key % 3 == 1, letter).otherwise(digit.cast("string")),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice with its printed values and an array of tax lines."""
    line = read_table(spark, sf_dir, "lineitem")
    rate = F.element_at(
        F.array(*[F.lit(r) for r in RATES]),
        (F.round(F.col("l_tax") * 100).cast("int") % 3 + 1).cast("int"),
    )
    discounted = (
        F.col("l_extendedprice").cast(AMOUNT) * (1 - F.col("l_discount").cast("decimal(4,2)"))
    ).cast(AMOUNT)
    per_order = (
        line.select(
            F.col("l_orderkey").alias("doc_id"),
            (F.col("l_linenumber").cast("long") * _LINE_SHIFT + F.col("l_suppkey")).alias("first"),
            rate.alias("rate"),
            discounted.alias("amount"),
        )
        .groupBy("doc_id")
        .agg(
            F.min("first").alias("first"),
            *[
                F.sum(F.when(F.col("rate") == r, F.col("amount"))).cast(AMOUNT).alias(f"base{r}")
                for r in RATES
            ],
        )
    )
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey", F.to_date("o_orderdate").alias("day")
    )
    customer = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    supplier = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), "s_nationkey"
    )
    joined = (
        per_order.withColumn("suppkey", F.col("first") % _LINE_SHIFT)
        .join(orders, "doc_id")
        .join(customer, "o_custkey", "left")
        .join(supplier, "suppkey", "left")
    )
    return _printed(joined)


def _printed(joined: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    lines = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(r).alias("rate"),
                    F.col(f"base{r}").alias("base"),
                    (F.col(f"base{r}") * F.lit(r) * F.lit("0.01").cast("decimal(3,2)"))
                    .cast(AMOUNT)
                    .alias("true_amount"),
                )
                for r in RATES
            ]
        ),
        lambda x: x["base"].isNotNull(),
    )
    off = F.when(doc % 13 == 7, F.lit("0.02")).otherwise(F.lit("0.00")).cast("decimal(3,2)")
    with_lines = joined.withColumn("true_lines", lines)
    printed_lines = F.transform(
        "true_lines",
        lambda x, i: F.struct(
            i.alias("line_no"),
            x["rate"].alias("rate"),
            x["base"].alias("base"),
            (x["true_amount"] + F.when(i == 0, off).otherwise(F.lit("0.00").cast("decimal(3,2)")))
            .cast(AMOUNT)
            .alias("amount"),
        ),
    )
    zero = F.lit("0.00").cast("decimal(28,2)")

    def total(name: str) -> Column:
        return F.aggregate(
            "true_lines", zero, lambda a, x: (a + x[name]).cast("decimal(28,2)")
        ).cast(AMOUNT)

    year = F.date_format("day", "yyyy")
    return (
        with_lines.withColumn("net", total("base"))
        .withColumn("tax", total("true_amount"))
        .select(
            "doc_id",
            F.concat(year, F.lit("/"), _digits(doc, 6)).alias("number"),
            F.col("day").alias("issue_date"),
            F.when(doc % 41 == 11, F.concat(F.lit("31/02/"), year))
            .otherwise(F.date_format("day", "dd/MM/yyyy"))
            .alias("printed_date"),
            _supplier_tax_id(F.col("suppkey"), doc % 17 == 3).alias("supplier_tax_id"),
            F.concat(
                F.lit("Almacenes Nacion "), "s_nationkey", F.lit(" "), "suppkey", F.lit(" S.L.")
            ).alias("supplier_name"),
            _customer_tax_id(F.col("o_custkey")).alias("customer_tax_id"),
            F.concat(
                F.lit("Comercial "), "c_mktsegment", F.lit(" "), "o_custkey", F.lit(" S.A.")
            ).alias("customer_name"),
            printed_lines.alias("lines"),
            "net",
            "tax",
            (
                F.col("net")
                + F.col("tax")
                + F.when(doc % 11 == 5, F.lit("1.00")).otherwise(F.lit("0.00")).cast("decimal(3,2)")
            )
            .cast(AMOUNT)
            .alias("gross"),
            F.when(doc % 10 == 0, "embedded_xml")
            .when(doc % 10 == 1, "scanned")
            .when(doc % 10 == 2, "hybrid")
            .otherwise("digital")
            .alias("made_as"),
        )
    )


def ledger_lines(invoices: DataFrame) -> DataFrame:
    """Tax lines of the ledger, one row each: doc_id, line_no, tax_rate, tax_base, tax_amount."""
    return invoices.select("doc_id", F.inline("lines")).select(
        "doc_id",
        "line_no",
        F.col("rate").cast("decimal(7,4)").alias("tax_rate"),
        F.col("base").alias("tax_base"),
        F.col("amount").alias("tax_amount"),
    )


def ledger_totals(invoices: DataFrame) -> DataFrame:
    """Stated totals of the ledger, one row per invoice."""
    none = F.lit(None).cast(AMOUNT)
    return invoices.select(
        "doc_id",
        F.col("net").alias("net_amount"),
        F.col("tax").alias("tax_amount"),
        F.col("gross").alias("gross_amount"),
        none.alias("advance_amount"),
        none.alias("withholding_amount"),
    )


def misread_lines(lines: DataFrame) -> DataFrame:
    """Tax lines as read: where doc % 6 = 0 the first base lost its amount and counts 0."""
    lost = (F.col("doc_id") % 6 == 0) & (F.col("line_no") == 0)
    kind = lines.schema["tax_base"].dataType
    return lines.withColumn("tax_base", F.when(lost, F.lit("0.00").cast(kind)).otherwise(F.col("tax_base")))
