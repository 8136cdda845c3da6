"""Tax rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import TABLE_RATE, TABLE_RATES
from .text import first_match, strip

RATE = "decimal(7,4)"


def table_rate(col: Column) -> Column:
    """Rate of a table cell: needs a percent sign, integer part one of the legal rates."""
    whole = first_match(F.lower(strip(col)), TABLE_RATE, 1).try_cast("decimal(38,0)")
    return F.when(whole.isin(*TABLE_RATES), whole).cast(RATE)


def plain_rate(col: Column) -> Column:
    """Rate as text without idle zeros: 21.0000 -> 21, 5.5000 -> 5.5."""
    return F.regexp_replace(col.cast("string"), r"\.?0+\z", "")


def pointed_rate(col: Column) -> Column:
    """Rate as text with at least one decimal: 21.0000 -> 21.0, 5.2500 -> 5.25."""
    return F.regexp_replace(col.cast("string"), r"(\.[0-9]+?)0+\z", "$1")
