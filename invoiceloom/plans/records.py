"""Findings, XML records or proposals -> audited records.

Every function here is a projection over one row per document: no shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions import is_valid_tax_id, parse_invoice_date, plain_rate
from ..operators.candidates import FIELD_COLUMNS, tax_line_parts
from ..operators.validate import total_warnings

MONEY = "decimal(28,2)"

# What a missing field does in each branch: an error, or a warning with confidence 0.
MISSING_IS_ERROR = {
    "digital": {
        "invoice_data.number": True,
        "invoice_data.issue_date": True,
        "supplier.tax_id": True,
        "customer.tax_id": True,
    },
    "ocr": {"invoice_data.issue_date": True},
}
MISSING_WARNS = {
    "digital": ("supplier.legal_name", "customer.legal_name"),
    "ocr": (
        "invoice_data.number",
        "invoice_data.issue_date",
        "supplier.tax_id",
        "supplier.legal_name",
        "customer.tax_id",
        "customer.legal_name",
    ),
}
TAX_LINES_CONFIDENCE = {"digital": fv.CONF_TAX_LINES_DIGITAL, "ocr": fv.CONF_TAX_LINES_OCR}
SOURCE = {"digital": "digital_text", "ocr": "ocr"}


def zero() -> Column:
    return F.lit("0.00").cast(MONEY)


def entry(key, value: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(key.alias("key"), value.cast("double").alias("value"))


def error(code: str, message, field: str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(code).alias("code"), message.alias("message"), F.lit(field).alias("field")
    )


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def mean_above_zero(entries: Column) -> Column:
    above = F.filter(entries, lambda e: e["value"] > 0)
    total = F.aggregate(above, F.lit(0.0), lambda a, e: a + e["value"])
    return F.when(F.size(above) > 0, total / F.size(above)).otherwise(F.lit(0.0))


def to_review(entries: Column) -> Column:
    """Names below the threshold, zero included."""
    low = F.filter(entries, lambda e: e["value"] < fv.REVIEW_BELOW)
    return F.transform(low, lambda e: e["key"])


def invoice_struct(number, issue_date, supplier, supplier_id, customer, customer_id, lines, totals):
    return F.struct(
        F.struct(supplier.alias("legal_name"), supplier_id.alias("tax_id")).alias("supplier"),
        F.struct(customer.alias("legal_name"), customer_id.alias("tax_id")).alias("customer"),
        F.struct(
            number.alias("number"),
            issue_date.alias("issue_date"),
            F.lit(None).cast("date").alias("due_date"),
        ).alias("invoice_data"),
        lines.alias("tax_lines"),
        totals.alias("totals"),
    ).cast(schemas.INVOICE)


def totals_struct(net, tax, gross, advance=None, withholding=None, kind: str = MONEY) -> Column:
    none = F.lit(None)
    return F.struct(
        net.cast(kind).alias("net_amount"),
        tax.cast(kind).alias("tax_amount"),
        gross.cast(kind).alias("gross_amount"),
        (none if advance is None else advance).cast(kind).alias("advance_amount"),
        (none if withholding is None else withholding).cast(kind).alias("withholding_amount"),
    )


def text_records(
    findings: DataFrame, branch: str | Column, include_evidence: bool = True, *carried: str
) -> DataFrame:
    """Records of the digital or the OCR branch, one per row of findings.

    ``branch`` names the branch of all rows or is a column that tells it row by row.
    Columns that are NULL are missing fields, so documents without any finding
    come out as error records once they are left-joined.  ``carried`` columns stay.
    """

    def by_branch(value) -> Column:
        """``value`` of a branch's name, whichever branch a row belongs to."""
        if isinstance(branch, str):
            return value(branch)
        return F.when(branch == "digital", value("digital")).otherwise(value("ocr"))

    def where_policy(policy: dict, field: str, value: Column) -> Column:
        """``value`` in the branches whose policy names the field."""
        return by_branch(lambda b: value if field in policy[b] else F.lit(None).cast("string"))

    def missing_confidence(field: str) -> Column:
        return by_branch(lambda b: F.lit(0.0 if field in MISSING_WARNS[b] else None).cast("double"))

    def hit(field: str) -> Column:
        return F.col(FIELD_COLUMNS[field])

    # Step 1: read and check single values.
    parsed = findings.withColumns(
        {
            "issue": parse_invoice_date(hit("invoice_data.issue_date")["value"]),
            "supplier_ok": is_valid_tax_id(hit("supplier.tax_id")["value"]),
            "customer_ok": is_valid_tax_id(hit("customer.tax_id")["value"]),
            "paired": F.filter("rates", lambda r: r["base"].isNotNull()),
        }
    )
    # Lines by the text of their rate: 10.0 before 21.0 before 4.0.
    ordered = F.array_sort(
        F.transform(
            "paired",
            lambda r: F.struct(
                plain_rate(r["rate"]).alias("rate_text"),
                r["rate"].alias("tax_rate"),
                r["base"].cast(MONEY).alias("tax_base"),
                r["amount"].cast(MONEY).alias("tax_amount"),
            ),
        )
    )
    amounts = {
        name: F.coalesce(hit(f"totals.{name}")["value"].cast(MONEY), zero())
        for name in ("net_amount", "tax_amount", "gross_amount")
    }
    lined = parsed.withColumns(
        {
            "lines": F.coalesce(ordered, F.array().cast(_LINES)),
            "totals": totals_struct(*amounts.values()),
        }
    )

    # Step 2: confidence entries in their fixed order.
    def plain_confidence(field: str) -> Column:
        there = hit(field).isNotNull()
        return _present(field, F.when(there, hit(field)["confidence"]).otherwise(missing_confidence(field)))

    def id_confidence(field: str, ok: str) -> Column:
        found = hit(field)["confidence"]
        checked = F.when(F.col(ok), found).otherwise(found * fv.INVALID_TAX_ID_FACTOR)
        return _present(field, F.when(hit(field).isNotNull(), checked).otherwise(missing_confidence(field)))

    date = hit("invoice_data.issue_date")
    date_confidence = _present(
        "invoice_data.issue_date",
        F.when(F.col("issue").isNotNull(), date["confidence"])
        .when(date.isNotNull(), F.lit(0.0))
        .otherwise(missing_confidence("invoice_data.issue_date")),
    )
    has_lines = F.size("lines") > 0
    thirds = [F.coalesce(hit(f"totals.{t}")["confidence"], F.lit(0.0)) for t in amounts]
    entries = F.concat(
        compact(
            plain_confidence("invoice_data.number"),
            date_confidence,
            id_confidence("supplier.tax_id", "supplier_ok"),
            plain_confidence("supplier.legal_name"),
            id_confidence("customer.tax_id", "customer_ok"),
            plain_confidence("customer.legal_name"),
        ),
        F.transform(
            "lines",
            lambda x: entry(
                F.concat(F.lit("tax_lines["), x["rate_text"], F.lit("]")), F.lit(fv.CONF_TAX_LINE)
            ),
        ),
        compact(
            entry("tax_lines", F.when(has_lines, by_branch(lambda b: F.lit(TAX_LINES_CONFIDENCE[b]))).otherwise(0.0)),
            *[_present(f"totals.{t}", hit(f"totals.{t}")["confidence"]) for t in amounts],
            entry("totals", (thirds[0] + thirds[1] + thirds[2]) / 3),
        ),
    )
    complete = (
        hit("invoice_data.number").isNotNull()
        & F.col("issue").isNotNull()
        & hit("supplier.tax_id").isNotNull()
        & hit("customer.tax_id").isNotNull()
    )
    checked = lined.withColumns(
        {
            "entries": entries,
            "complete": complete,
            "total_checks": total_warnings(F.col("lines"), F.col("totals")),
        }
    )

    # Step 3: messages in their fixed order.
    def missing_warning(field: str) -> Column:
        return where_policy(MISSING_WARNS, field, F.when(hit(field).isNull(), fv.MSG_MISSING[field]))

    def id_warning(field: str, ok: str, message: str) -> Column:
        bad = hit(field).isNotNull() & ~F.col(ok)
        return F.coalesce(
            F.when(bad, F.concat(F.lit(message), hit(field)["value"])), missing_warning(field)
        )

    bad_date = date.isNotNull() & F.col("issue").isNull()
    warnings = F.concat(
        compact(
            missing_warning("invoice_data.number"),
            F.when(bad_date, invalid_date(fv.MSG_INVALID_DATE, date["value"])).otherwise(
                missing_warning("invoice_data.issue_date")
            ),
            id_warning("supplier.tax_id", "supplier_ok", fv.MSG_INVALID_SUPPLIER_ID),
            missing_warning("supplier.legal_name"),
            id_warning("customer.tax_id", "customer_ok", fv.MSG_INVALID_CUSTOMER_ID),
            missing_warning("customer.legal_name"),
            F.when(~has_lines, fv.MSG_NO_TAX_LINES),
        ),
        F.transform("total_checks", lambda w: w["message"]),
        compact(F.when(~F.col("complete"), fv.MSG_INCOMPLETE)),
    )
    is_error = {f: by_branch(lambda b, f=f: F.lit(MISSING_IS_ERROR[b].get(f, False))) for f in fv.REQUIRED_FIELDS}
    errors = compact(
        *[
            F.when(is_error[f] & hit(f).isNull(), error("missing_field", fv.MSG_MISSING[f], f))
            for f in fv.REQUIRED_FIELDS
        ]
    )
    invoice = invoice_struct(
        hit("invoice_data.number")["value"],
        F.col("issue"),
        F.coalesce(hit("supplier.legal_name")["value"], F.lit(fv.UNKNOWN_NAME)),
        hit("supplier.tax_id")["value"],
        F.coalesce(hit("customer.legal_name")["value"], F.lit(fv.UNKNOWN_NAME)),
        hit("customer.tax_id")["value"],
        F.transform(
            "lines",
            lambda x: F.struct(
                x["tax_rate"].alias("tax_rate"),
                x["tax_base"].alias("tax_base"),
                x["tax_amount"].alias("tax_amount"),
            ),
        ),
        F.col("totals"),
    )
    return checked.select(
        "doc_id",
        "kind",
        by_branch(F.lit).alias("route"),
        F.when(F.col("complete"), "ok").otherwise("error").alias("status"),
        F.when(F.col("complete"), invoice).alias("invoice"),
        mean_above_zero(F.col("entries")).alias("global_score"),
        F.map_from_entries("entries").alias("fields"),
        to_review(F.col("entries")).alias("needs_review"),
        warnings.alias("warnings"),
        errors.cast(schemas.ERRORS).alias("errors"),
        (
            evidence_map(by_branch(lambda b: F.lit(SOURCE[b]))) if include_evidence else F.lit(None).cast(schemas.EVIDENCE)
        ).alias("evidence"),
        *carried,
    )


_LINES = (
    "array<struct<rate_text:string,tax_rate:decimal(7,4),tax_base:decimal(28,2),tax_amount:decimal(28,2)>>"
)


def _present(key: str, value: Column) -> Column:
    """Entry of a field, NULL when the field has no confidence at all."""
    return F.when(value.isNotNull(), entry(key, value))


def invalid_date(message: str, shown: Column) -> Column:
    return F.concat(F.lit(message + fv.MSG_DATE_DETAIL + "'"), shown, F.lit("'"))


def evidence_map(source: Column) -> Column:
    """Where each resolved field and each part of a tax line was read."""

    def seen(hit: Column) -> Column:
        return F.struct(
            hit["value"].alias("text"),
            hit["page"].alias("page"),
            hit["bbox"].alias("bbox"),
            source.alias("source"),
        )

    fixed = compact(
        *[
            F.when(
                F.col(column).isNotNull(),
                F.struct(F.lit(field).alias("key"), seen(F.col(column)).alias("value")),
            )
            for field, column in FIELD_COLUMNS.items()
        ]
    )
    parts = F.transform(
        F.flatten(F.transform("rates", tax_line_parts)),
        lambda p: F.struct(p["field_name"].alias("key"), seen(p).alias("value")),
    )
    return F.map_from_entries(F.concat(fixed, F.coalesce(parts, F.array()))).cast(schemas.EVIDENCE)
