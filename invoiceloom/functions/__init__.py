"""Column -> Column expressions; none of them leaves the JVM."""

from .dates import parse_invoice_date
from .money import MONEY, first_withholding_amount, matched_amount, normalize_money, table_money, xml_decimal
from .names import normalize_legal_name
from .tax_ids import is_valid_cif, is_valid_nie, is_valid_nif, is_valid_tax_id, normalize_tax_id
from .text import contains_any, contains_count, strip, xml_text
from .tax_rates import plain_rate, table_rate

__all__ = [
    "MONEY",
    "contains_any",
    "contains_count",
    "first_withholding_amount",
    "is_valid_cif",
    "is_valid_nie",
    "is_valid_nif",
    "is_valid_tax_id",
    "matched_amount",
    "normalize_legal_name",
    "normalize_money",
    "normalize_tax_id",
    "parse_invoice_date",
    "plain_rate",
    "strip",
    "table_money",
    "table_rate",
    "xml_decimal",
    "xml_text",
]
