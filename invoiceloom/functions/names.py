"""Legal names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import NAME_SEPARATORS, NAME_SUFFIXES
from .text import strip


def normalize_legal_name(col: Column) -> Column:
    """Company suffixes dropped, runs of blanks and punctuation made one space, upper case."""
    bare = F.regexp_replace(col, NAME_SUFFIXES, "")
    return F.upper(strip(F.regexp_replace(bare, NAME_SEPARATORS, " ")))
