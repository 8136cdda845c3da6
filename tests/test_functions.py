from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from invoiceloom import functions as fn


def scalar(spark, values, build):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money(spark):
    given = ["1.234,56 €", "1234,5", "1,234.56", "42", "10.005", "-10.005", "no es dinero", "", "1e3", ".5", "EUR 7", "1,2,3", "12345678901234567890123456789"]
    want = ["1234.56", "1234.50", "1234.56", "42.00", "10.01", "-10.01", None, None, None, "0.50", "7.00", None, None]
    got = scalar(spark, given, fn.normalize_money)
    assert got == [None if w is None else Decimal(w) for w in want]


def test_matched_amount_reads_like_money(spark):
    given = ["1.234,56 €", "1234,5", "1,234.56", "EUR  12,00", "1.2.3", ",", ".", "7.", "12,345,678", "0,1€"]
    assert scalar(spark, given, fn.matched_amount) == scalar(spark, given, fn.normalize_money)


def test_dates(spark):
    given = ["2026-05-13", "13/05/2026", "13-05-2026", "13.05.2026", "31/02/2026", " 1/2/2024 ", "2024/01/02", "1-2-24", "13/05-2026"]
    got = [None if d is None else d.isoformat() for d in scalar(spark, given, fn.parse_invoice_date)]
    assert got == ["2026-05-13"] * 4 + [None, "2024-02-01", None, None, None]


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (fn.is_valid_nif, ["00000000T", "12345678Z", "12.345.678-z"], ["00000000A", "12345678A", "x"]),
        (fn.is_valid_nie, ["X0000000T", "Y0000000Z", "Z0000000M"], ["X0000000A", "W0000000T"]),
        (fn.is_valid_cif, ["B99286320", "A58818501", "P2807900B"], ["B99286321", "P2807900A", "texto"]),
        (fn.is_valid_tax_id, ["B99286320", "X0000000T", "12345678Z"], ["", "A12345678", "B87654321"]),
    ],
)
def test_tax_ids(spark, check, good, bad):
    assert scalar(spark, good, check) == [True] * len(good)
    assert scalar(spark, bad, check) == [False] * len(bad)


def test_table_rate(spark):
    given = ["21%", "21,5%", "4 %", "0%", "16%", "21", "121%", "x 10,00% y"]
    assert scalar(spark, given, lambda c: fn.plain_rate(fn.table_rate(c))) == [
        "21", "21", "4", "0", None, None, None, "10",
    ]


def test_withholding(spark):
    given = ["Retención 105,00", "reten 1.234,56", "reten 7,5", "reten"]
    assert scalar(spark, given, fn.first_withholding_amount) == [
        Decimal("105.00"), Decimal("1234.56"), Decimal("7.50"), None,
    ]


def test_legal_name(spark):
    # A suffix whose last point ends the text stays: there is no word border behind it.
    given = ["Servicios  ABC, S.L.", "Servicios ABC S.A.x", " a-b ; c "]
    assert scalar(spark, given, fn.normalize_legal_name) == ["SERVICIOS ABC S L", "SERVICIOS ABC X", "A B C"]


def test_xml_values(spark):
    assert scalar(spark, ["1,5", "1000.505", "x", "1.000,5"], fn.xml_decimal) == [
        Decimal("1.500000"), Decimal("1000.505000"), None, None,
    ]
    assert scalar(spark, ["  a \n b ", "   "], fn.xml_text) == ["a b", None]
