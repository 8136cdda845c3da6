"""Invoice dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_YEAR_FIRST = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"
_DAY_FIRST = r"^[0-9]{1,2}([/.-])[0-9]{1,2}\1(?!0000)[0-9]{4}\z"


def parse_invoice_date(col: Column) -> Column:
    """yyyy-m-d, d/m/yyyy, d-m-yyyy or d.m.yyyy; days that do not exist are NULL."""
    text = strip(col)
    return F.when(text.rlike(_YEAR_FIRST), F.try_to_date(text, "yyyy-M-d")).when(
        text.rlike(_DAY_FIRST), F.try_to_date(F.translate(text, "/.", "--"), "d-M-yyyy")
    )
