"""Structured XML attachments -> parsed records.

``from_xml`` reads the fixed paths once per attachment.  Only the two fallbacks
that may reach anywhere in the file use XPath, and only on files that parse.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import xml_decimal, xml_text
from ..functions.money import XML_MONEY
from .prepare import xml_attachments

_PARTY = (
    "struct<LegalEntity:struct<CorporateName:string,Name:string,TaxIdentificationNumber:{tax}>,"
    "CorporateName:string,Name:string,TaxIdentificationNumber:{tax}>"
).format(tax="struct<_VALUE:string,NumberStartDateOfValidTaxIdentification:string>")
_TAXES = "struct<TaxLine:array<struct<TaxRate:string,TaxableBase:string,TaxAmount:string>>>"
_SUMS = (
    "struct<TotalGrossAmountBeforeTaxes:string,TotalSums:string,TotalTaxes:string,InvoiceTotal:string,"
    "TotalGeneralSurcharges:string,TotalPaymentsOnAccount:string>"
)
FILE_SCHEMA = (
    "FacturaeHeader struct<InvoiceNumber:string,InvoiceDate:string>, "
    f"FacturaeBody struct<Parties:struct<SellerParty:{_PARTY},BuyerParty:{_PARTY}>,"
    f"TaxesOutputs:{_TAXES},InvoiceTotals:{_SUMS}>, "
    f"TaxesOutputs {_TAXES}, InvoiceTotals {_SUMS}, _corrupt_record string"
)
RECORD_COLUMNS = (
    "invoice_number",
    "issue_date",
    "supplier_name",
    "supplier_tax_id",
    "customer_name",
    "customer_tax_id",
    "tax_lines",
    "net_amount",
    "tax_amount",
    "gross_amount",
    "advance_amount",
    "withholding_amount",
)


def _anywhere(tag: str) -> Column:
    return F.xpath_string("raw_xml", F.lit(f"//*[local-name()='{tag}'][1]"))


def _header_text(tag: str) -> Column:
    """Child of the header; without that child, the first such element anywhere."""
    return xml_text(F.coalesce(F.col(f"x.FacturaeHeader.{tag}"), _anywhere(tag)))


def _party(tag: str) -> tuple[Column, Column]:
    """Name and tax id of a party, with their fallbacks."""
    party = F.col(f"x.FacturaeBody.Parties.{tag}")
    entity = party["LegalEntity"]

    def inside(name: str) -> Column:
        return F.when(entity.isNotNull(), entity[name]).otherwise(party[name])

    name = F.coalesce(inside("CorporateName"), inside("Name"))
    element = F.coalesce(inside("TaxIdentificationNumber"), party["TaxIdentificationNumber"])
    stated = F.coalesce(
        xml_text(element["_VALUE"]), xml_text(element["NumberStartDateOfValidTaxIdentification"])
    )
    texts = F.xpath("raw_xml", F.lit(f"//*[local-name()='{tag}']//text()"))
    looks_right = F.filter(
        F.transform(texts, lambda t: xml_text(t)), lambda t: t.rlike(fv.XML_TAX_ID_SHAPE)
    )
    found = F.when(party.isNotNull(), F.get(looks_right, F.lit(0)))
    return xml_text(name), F.coalesce(stated, found)


def _tax_lines() -> Column:
    """Lines with a readable rate; a missing base or amount counts as 0."""
    listed = F.coalesce(F.col("x.FacturaeBody.TaxesOutputs.TaxLine"), F.col("x.TaxesOutputs.TaxLine"))
    zero = F.lit("0").cast(XML_MONEY)
    read = F.transform(
        listed,
        lambda t: F.struct(
            xml_decimal(t["TaxRate"]).try_cast("decimal(7,4)").alias("tax_rate"),
            F.coalesce(xml_decimal(t["TaxableBase"]), zero).alias("tax_base"),
            F.coalesce(xml_decimal(t["TaxAmount"]), zero).alias("tax_amount"),
        ),
    )
    return F.filter(F.coalesce(read, F.array()), lambda t: t["tax_rate"].isNotNull())


def _sum(tag: str) -> Column:
    sums = F.coalesce(F.col("x.FacturaeBody.InvoiceTotals"), F.col("x.InvoiceTotals"))
    return xml_decimal(sums[tag])


def read_attachments(attachments: DataFrame) -> DataFrame:
    """XML files with the ``record`` read from them: doc_id, att_seq, format, record.

    The record is NULL for files of another format, files that are cut off, have another
    root or tell neither number, date nor seller.
    """
    supported = F.when(F.col("format") == "facturae", F.col("raw_xml"))
    parsed = xml_attachments(attachments).select(
        "doc_id",
        "att_seq",
        "format",
        "raw_xml",
        F.from_xml(supported, FILE_SCHEMA, {"ignoreNamespace": "true"}).alias("x"),
    )
    readable = F.col("x").isNotNull() & F.col("x._corrupt_record").isNull()
    root = F.xpath_string("raw_xml", F.lit("local-name(/*)"))
    supplier_name, supplier_tax_id = _party("SellerParty")
    customer_name, customer_tax_id = _party("BuyerParty")
    values = {
        "invoice_number": _header_text("InvoiceNumber"),
        "issue_date": _header_text("InvoiceDate"),
        "supplier_name": supplier_name,
        "supplier_tax_id": supplier_tax_id,
        "customer_name": customer_name,
        "customer_tax_id": customer_tax_id,
        "tax_lines": _tax_lines(),
        "net_amount": F.coalesce(_sum("TotalGrossAmountBeforeTaxes"), _sum("TotalSums")),
        "tax_amount": _sum("TotalTaxes"),
        "gross_amount": _sum("InvoiceTotal"),
        "advance_amount": _sum("TotalGeneralSurcharges"),
        "withholding_amount": _sum("TotalPaymentsOnAccount"),
    }
    # XPath stops on files that do not parse, so it stays behind the other tests.
    record = F.when(
        F.when(readable, root == "Facturae").otherwise(F.lit(False)),
        F.struct(*[values[c].alias(c) for c in RECORD_COLUMNS]),
    )
    told = ("invoice_number", "issue_date", "supplier_name", "supplier_tax_id")
    held = parsed.select("doc_id", "att_seq", "format", record.alias("record"))
    known = F.coalesce(*[F.col(f"record.{c}") for c in told]).isNotNull()
    return held.withColumn("record", F.when(known, F.col("record")))


def parse_attachments(attachments: DataFrame) -> DataFrame:
    """Readable records: one row per attachment of the supported format that holds one."""
    read = read_attachments(attachments).filter(F.col("record").isNotNull())
    return read.select("doc_id", "att_seq", "format", "record.*")


def first_record(records: DataFrame) -> DataFrame:
    """The first readable attachment of each document."""
    first = F.min(F.struct("att_seq", "format", *RECORD_COLUMNS))
    return records.groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.*")


def attachment_summary(attachments: DataFrame) -> DataFrame:
    """Number of XML files per document and the format of the last one."""
    last = F.max(F.struct("att_seq", "format"))
    return (
        xml_attachments(attachments)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("xml_count"), last.alias("last"))
        .select("doc_id", "xml_count", F.col("last.format").alias("last_format"))
    )


def attachment_results(attachments: DataFrame) -> DataFrame:
    """One row per document with XML files: their number, the format of the last, and the first record.

    ``att_seq`` and the record's columns are NULL where no file holds a record.
    """
    read = read_attachments(attachments)
    first = F.min(F.when(F.col("record").isNotNull(), F.struct("att_seq", "record")))
    last = F.max(F.struct("att_seq", "format"))
    return (
        read.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("xml_count"), last.alias("last"), first.alias("first"))
        .select("doc_id", "xml_count", F.col("last.format").alias("last_format"), "first.att_seq", "first.record.*")
    )
