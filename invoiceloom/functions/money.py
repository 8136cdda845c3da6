"""Amounts written in European or English style -> DECIMAL with two places."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import BLANKS, WITHHOLDING_GROUPED, WITHHOLDING_PLAIN
from .text import first_match, strip

MONEY = "decimal(28,2)"
XML_MONEY = "decimal(28,6)"
_NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"


def _to_decimal(numeral: Column, kind: str) -> Column:
    return F.when(numeral.rlike(_NUMERAL), numeral.try_cast(kind))


def normalize_money(col: Column) -> Column:
    """The separator standing last is the decimal one; rounding is half up.

    Anything that is not an amount, and anything beyond 26 integer digits, is NULL.
    """
    bare = strip(col)
    for mark in ("€", "EUR", "eur", " "):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    bare = strip(bare)
    comma_is_decimal = F.contains(F.substring_index(bare, ".", -1), F.lit(","))
    numeral = F.when(comma_is_decimal, F.translate(bare, ",.", ".")).otherwise(
        F.replace(bare, F.lit(","), F.lit(""))
    )
    return _to_decimal(numeral, MONEY)


def matched_amount(col: Column) -> Column:
    """Same reading for text that a pattern has already cut down to digits, separators,
    blanks and a euro mark; one pass drops the marks and the cast needs no guard."""
    bare = F.translate(col, "€EUReur" + BLANKS, "")
    comma_is_decimal = F.contains(F.substring_index(bare, ".", -1), F.lit(","))
    return (
        F.when(comma_is_decimal, F.translate(bare, ",.", "."))
        .otherwise(F.replace(bare, F.lit(","), F.lit("")))
        .try_cast(MONEY)
    )


def table_money(col: Column) -> Column:
    """Amount in a table cell; same reading, the cell is trimmed once more."""
    bare = strip(col)
    for mark in ("€", "EUR"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return normalize_money(bare)


def first_withholding_amount(col: Column) -> Column:
    """First amount inside a withholding cell; a grouped amount goes before any decimal."""
    grouped = first_match(col, WITHHOLDING_GROUPED, 1)
    return F.when(grouped.isNotNull(), table_money(grouped)).otherwise(
        table_money(first_match(col, WITHHOLDING_PLAIN, 1))
    )


def xml_decimal(col: Column, kind: str = XML_MONEY) -> Column:
    """Decimal in an XML element: comma read as point, more than two places kept."""
    return _to_decimal(strip(F.replace(col, F.lit(","), F.lit("."))), kind)
