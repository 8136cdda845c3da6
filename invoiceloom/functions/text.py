"""Small text helpers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import BLANKS


def strip(col: Column) -> Column:
    """Both ends without any Unicode blank."""
    return F.btrim(col, F.lit(BLANKS))


def xml_text(col: Column) -> Column:
    """XML text: trimmed, runs of blanks made one space, empty becomes NULL."""
    return F.nullif(strip(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def contains_any(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def contains_count(col: Column, words) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(col, F.lit(w)).cast("int") for w in words])


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when there is none."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))
