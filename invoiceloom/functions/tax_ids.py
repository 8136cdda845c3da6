"""Control digits of Spanish tax identifiers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    CIF_LETTERS,
    CIF_SHAPE,
    CIF_TYPES_DIGIT_ONLY,
    CIF_TYPES_LETTER_ONLY,
    NIE_SHAPE,
    NIF_LETTERS,
    NIF_SHAPE,
)


def normalize_tax_id(col: Column) -> Column:
    """Upper case without blanks, dashes and points."""
    return F.upper(F.regexp_replace(col, r"(?U)[\s\-.]", ""))


def _nif_letter(number: Column) -> Column:
    return F.substring(F.lit(NIF_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def _ends_with_nif_letter(digits: Column, tax_id: Column) -> Column:
    return F.right(tax_id, F.lit(1)) == _nif_letter(digits.try_cast("int"))


def _nif(tax_id: Column) -> Column:
    return F.when(
        tax_id.rlike(NIF_SHAPE), _ends_with_nif_letter(F.left(tax_id, F.lit(8)), tax_id)
    ).otherwise(F.lit(False))


def _nie(tax_id: Column) -> Column:
    digits = F.translate(F.left(tax_id, F.lit(8)), "XYZ", "012")
    return F.when(tax_id.rlike(NIE_SHAPE), _ends_with_nif_letter(digits, tax_id)).otherwise(
        F.lit(False)
    )


def cif_control_digit(seven_digits: Column) -> Column:
    """Digits at odd places count as the digit sum of their double, the others as they are."""
    doubled = F.translate(seven_digits, "0123456789", "0246813579")
    parts = [
        F.substring(doubled if place % 2 else seven_digits, place, 1).try_cast("int")
        for place in range(1, 8)
    ]
    return (10 - reduce(lambda a, b: a + b, parts) % 10) % 10


def _cif(tax_id: Column) -> Column:
    entity, control = F.left(tax_id, F.lit(1)), F.right(tax_id, F.lit(1))
    digit = cif_control_digit(F.substring(tax_id, 2, 7))
    by_digit = control == digit.cast("string")
    by_letter = control == F.substring(F.lit(CIF_LETTERS), (digit + 1).cast("int"), F.lit(1))
    verdict = (
        F.when(entity.isin(*CIF_TYPES_LETTER_ONLY), by_letter)
        .when(entity.isin(*CIF_TYPES_DIGIT_ONLY), by_digit)
        .otherwise(by_digit | by_letter)
    )
    return F.when(tax_id.rlike(CIF_SHAPE), verdict).otherwise(F.lit(False))


def is_valid_nif(col: Column) -> Column:
    return _nif(normalize_tax_id(col))


def is_valid_nie(col: Column) -> Column:
    return _nie(normalize_tax_id(col))


def is_valid_cif(col: Column) -> Column:
    return _cif(normalize_tax_id(col))


def is_valid_tax_id(col: Column) -> Column:
    """Valid as NIF, NIE or CIF."""
    tax_id = normalize_tax_id(col)
    return _nif(tax_id) | _nie(tax_id) | _cif(tax_id)
