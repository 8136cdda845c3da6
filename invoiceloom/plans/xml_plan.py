"""XML branch: attachments -> audited records or error rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions import is_valid_tax_id, parse_invoice_date, plain_rate
from ..functions.money import XML_MONEY
from ..operators.validate import total_warnings
from ..operators.xml_records import attachment_results
from .records import (
    compact,
    entry,
    error,
    invalid_date,
    invoice_struct,
    mean_above_zero,
    totals_struct,
)


def last_wins(entries: Column) -> Column:
    """Key-value entries with every key once, its last value kept.

    Entries are sorted by key and place, so that a look at the next one tells the last of
    a key; the rest goes back to its order.
    """
    by_key = F.array_sort(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e.alias("entry")))
    )

    def last_of_each(s: Column) -> Column:
        kept = F.filter(s, lambda x, j: ~F.coalesce(F.get(s, j + 1)["key"] == x["key"], F.lit(False)))
        placed = F.array_sort(F.transform(kept, lambda x: F.struct(x["at"], x["entry"].alias("entry"))))
        return F.transform(placed, lambda x: x["entry"])

    # bound to a variable, or the sort would run again for every entry
    return F.get(F.transform(F.array(by_key), last_of_each), F.lit(0))


def printed(amount: Column) -> Column:
    """Amount as text: two places, more only when they are used."""
    return F.regexp_replace(amount.cast("string"), r"(\.[0-9]{2}[0-9]*?)0+\z", "$1")


_FIELDS = {
    "invoice_data.number": "invoice_number",
    "invoice_data.issue_date": "issue_date",
    "supplier.tax_id": "supplier_tax_id",
    "supplier.legal_name": "supplier_name",
    "customer.tax_id": "customer_tax_id",
    "customer.legal_name": "customer_name",
}


def xml_records(records: DataFrame, include_evidence: bool = True) -> DataFrame:
    """One audited record per parsed XML record."""
    zero = F.lit("0.00").cast(XML_MONEY)

    def amount(name: str) -> Column:
        return F.coalesce(f"{name}_amount", zero)

    checked = records.withColumns(
        {
            "issue": parse_invoice_date(F.col("issue_date")),
            "totals": totals_struct(
                amount("net"),
                amount("tax"),
                amount("gross"),
                F.col("advance_amount"),
                F.col("withholding_amount"),
                XML_MONEY,
            ),
        }
    ).withColumns(
        {
            "complete": F.col("invoice_number").isNotNull()
            & F.col("issue").isNotNull()
            & F.col("supplier_tax_id").isNotNull()
            & F.col("customer_tax_id").isNotNull(),
            "total_checks": total_warnings(F.col("tax_lines"), F.col("totals")),
        }
    )

    def missing(field: str) -> Column:
        return F.when(F.col(_FIELDS[field]).isNull(), fv.MSG_MISSING_XML[field])

    def id_warning(field: str, message: str) -> Column:
        value = F.col(_FIELDS[field])
        bad = value.isNotNull() & ~is_valid_tax_id(value)
        return F.coalesce(missing(field), F.when(bad, F.concat(F.lit(message), value)))

    bad_date = F.col("issue_date").isNotNull() & F.col("issue").isNull()
    has_lines = F.size("tax_lines") > 0
    warnings = F.concat(
        compact(
            missing("invoice_data.number"),
            F.coalesce(
                missing("invoice_data.issue_date"),
                F.when(bad_date, invalid_date(fv.MSG_INVALID_DATE_XML, F.col("issue_date"))),
            ),
            missing("supplier.legal_name"),
            id_warning("supplier.tax_id", fv.MSG_INVALID_SUPPLIER_ID),
            missing("customer.legal_name"),
            id_warning("customer.tax_id", fv.MSG_INVALID_CUSTOMER_ID),
            F.when(~has_lines, fv.MSG_MISSING_XML["tax_lines"]),
        ),
        F.transform("total_checks", lambda w: w["message"]),
    )
    sure = F.lit(fv.CONF_XML)
    entries = last_wins(
        F.concat(
            F.array(*[entry(f, sure) for f in fv.RECORD_FIELDS]),
            F.transform(
                "tax_lines",
                lambda t: entry(
                    F.concat(F.lit("tax_lines["), plain_rate(t["tax_rate"]), F.lit("]")), sure
                ),
            ),
            compact(F.when(has_lines, entry("tax_lines", sure))),
        )
    )
    invoice = invoice_struct(
        F.col("invoice_number"),
        F.col("issue"),
        F.coalesce("supplier_name", F.lit(fv.UNKNOWN_NAME)),
        F.col("supplier_tax_id"),
        F.coalesce("customer_name", F.lit(fv.UNKNOWN_NAME)),
        F.col("customer_tax_id"),
        F.col("tax_lines"),
        F.col("totals"),
    )
    incomplete = fv.MSG_MISSING_XML["record"]
    scored = checked.withColumn("entries", entries)
    return scored.select(
        "doc_id",
        F.lit("embedded_xml").alias("kind"),
        F.lit("xml").alias("route"),
        F.when(F.col("complete"), "ok").otherwise("error").alias("status"),
        F.when(F.col("complete"), invoice).alias("invoice"),
        F.when(F.col("complete"), mean_above_zero(F.col("entries"))).otherwise(0.0).alias(
            "global_score"
        ),
        F.when(F.col("complete"), F.map_from_entries("entries"))
        .otherwise(F.create_map().cast("map<string,double>"))
        .alias("fields"),
        F.array().cast("array<string>").alias("needs_review"),
        F.when(F.col("complete"), warnings).otherwise(F.array(F.lit(incomplete))).alias("warnings"),
        F.when(F.col("complete"), F.array().cast(schemas.ERRORS))
        .otherwise(F.array(error("xml_invalid_data", incomplete, "file")))
        .alias("errors"),
        (
            F.when(F.col("complete"), xml_evidence()) if include_evidence else F.lit(None)
        ).cast(schemas.EVIDENCE).alias("evidence"),
        *[c for c in ("att_seq", "xml_count", "last_format") if c in records.columns],
    )


def _seen(key: Column, text: Column) -> Column:
    value = F.struct(
        text.alias("text"),
        F.lit(1).alias("page"),
        F.lit(None).cast(schemas.BBOX).alias("bbox"),
        F.lit("xml").alias("source"),
    )
    return F.struct(key.alias("key"), value.alias("value"))


def xml_evidence() -> Column:
    """Evidence of every field and every part of a tax line, all on page 1."""
    blank, nothing = F.lit(""), F.lit("0.00").cast(XML_MONEY)
    fixed = [_seen(F.lit(f), F.coalesce(c, blank)) for f, c in _FIELDS.items()]
    sums = [
        _seen(F.lit(f"totals.{t}_amount"), printed(F.coalesce(f"{t}_amount", nothing)))
        for t in ("net", "tax", "gross")
    ]

    def parts(line: Column) -> Column:
        rate = printed(line["tax_rate"])

        def part(name: str, text: Column) -> Column:
            return _seen(F.concat(F.lit("tax_lines["), rate, F.lit("]."), F.lit(name)), text)

        return F.array(
            part("tax_rate", rate),
            part("tax_base", printed(line["tax_base"])),
            part("tax_amount", printed(line["tax_amount"])),
        )

    lines = F.flatten(F.transform("tax_lines", parts))
    return F.map_from_entries(last_wins(F.concat(F.array(*fixed), lines, F.array(*sums))))


def error_columns(code: Column, message: Column, warnings: Column) -> dict:
    """The columns of an error response, but for doc_id, kind and route."""
    told = F.struct(code.alias("code"), message.alias("message"), F.lit("file").alias("field"))
    return {
        "status": F.lit("error"),
        "invoice": F.lit(None).cast(schemas.INVOICE),
        "global_score": F.lit(0.0),
        "fields": F.create_map().cast("map<string,double>"),
        "needs_review": F.array().cast("array<string>"),
        "warnings": warnings,
        "errors": F.array(told).cast(schemas.ERRORS),
        "evidence": F.lit(None).cast(schemas.EVIDENCE),
    }


def error_record(rows: DataFrame, route: str) -> DataFrame:
    """Error responses from doc_id, kind, code, message, warnings."""
    told = error_columns(F.col("code"), F.col("message"), F.col("warnings"))
    return rows.select("doc_id", "kind", F.lit(route).alias("route"), *[c.alias(n) for n, c in told.items()])


def xml_branch(documents: DataFrame, attachments: DataFrame, include_evidence: bool = True) -> DataFrame:
    """All documents of the XML route: records, or the reason why there is none.

    Attachments are parsed in one pass and reduced to a row per document, which tells the
    first record, or how many XML files there are and the format of the last.
    """
    known = documents.select("doc_id", "kind")
    mine = attachments.join(known.select("doc_id"), "doc_id", "left_semi")
    told = known.join(attachment_results(mine), "doc_id", "left")
    records = xml_records(told, include_evidence)
    none = F.col("xml_count").isNull()
    instead = error_columns(
        F.when(none, "no_xml_found").otherwise("xml_parse_failed"),
        F.when(none, fv.MSG_NO_XML).otherwise(F.concat(F.lit(fv.MSG_XML_FORMAT), "last_format")),
        F.array(
            F.when(none, fv.MSG_NO_XML_WARNING).otherwise(F.concat(F.lit(fv.MSG_XML_FORMAT_WARNING), "last_format"))
        ),
    )
    return records.withColumns(
        {c: F.when(F.col("att_seq").isNull(), other).otherwise(F.col(c)) for c, other in instead.items()}
    ).drop("att_seq", "xml_count", "last_format")
