"""Ledger invoices printed as the tables the jobs read.

Printed defects, by document number:

    doc % 19 = 4   base line stands before its rate line
    doc % 23 = 6   buyer name missing
    doc % 29 = 8   buyer tax id written with a dash
    doc % 31 = 9   gross amount stands before the net amount
    doc % 43 = 12  no invoice number
    doc % 5 = 2    thousands separators in the rate lines too
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_legal_name


def plain_amount(col: Column) -> Column:
    return F.replace(col.cast("string"), F.lit("."), F.lit(","))


def grouped_amount(col: Column) -> Column:
    return F.translate(F.format_number(col, 2), ",.", ".,")


def _entry(slot, text: Column, tie: int = 0) -> Column:
    slot = slot if isinstance(slot, Column) else F.lit(slot)
    return F.struct(
        slot.cast("double").alias("slot"), F.lit(tie).alias("tie"), text.alias("text")
    )


def rendered_lines(invoices: DataFrame) -> DataFrame:
    """All printed lines: doc_id, made_as, page, block_seq, y0, text."""
    doc = F.col("doc_id")
    unit = F.when(doc % 7 == 3, F.lit(" €")).otherwise(F.lit(" EUR"))
    tied = doc % 6 == 0
    dashed = F.when(
        (doc % 29 == 8) & F.col("customer_tax_id").rlike("^[0-9]"),
        F.concat(
            F.left("customer_tax_id", F.lit(8)), F.lit("-"), F.right("customer_tax_id", F.lit(1))
        ),
    ).otherwise(F.col("customer_tax_id"))
    fixed = [
        _entry(0, F.when(doc % 43 != 12, F.concat(F.lit("FACTURA "), "number"))),
        _entry(1, F.concat(F.lit("Fecha: "), "printed_date")),
        _entry(2, F.concat(F.lit("EMISOR "), "supplier_tax_id")),
        _entry(F.when(tied, 2).otherwise(3), F.col("supplier_name"), 1),
        _entry(4, F.concat(F.lit("CLIENTE "), dashed)),
        _entry(
            F.when(tied, 4).otherwise(5), F.when(doc % 23 != 6, F.col("customer_name")), 1
        ),
        _entry(6, F.concat(F.lit("Base imponible "), grouped_amount(F.col("net")), unit)),
        _entry(7, F.concat(F.lit("Impuesto repercutido: "), grouped_amount(F.col("tax")), unit)),
        _entry(
            F.when(doc % 31 == 9, 5.5).otherwise(20),
            F.concat(F.lit("TOTAL FACTURA "), grouped_amount(F.col("gross")), unit),
        ),
        _entry(21, F.when(doc % 2 == 0, F.lit("Gracias por su confianza"))),
    ]
    swapped = (doc % 19 == 4).cast("int")
    rate_lines = F.transform(
        "lines",
        lambda x: _entry(
            8 + 2 * x["line_no"] + swapped,
            F.concat(
                F.lit("IVA "),
                x["rate"].cast("string"),
                F.lit("% "),
                F.when(doc % 5 == 2, grouped_amount(x["amount"])).otherwise(
                    plain_amount(x["amount"])
                ),
                unit,
            ),
        ),
    )
    base_lines = F.transform(
        "lines",
        lambda x: _entry(
            9 + 2 * x["line_no"] - swapped,
            F.concat(F.lit("Base imponible: "), grouped_amount(x["base"]), unit),
        ),
    )
    place = (F.col("slot") * 10 + F.col("tie")).cast("int")
    return (
        invoices.filter(doc % 37 != 10)
        .select(
            "doc_id", "made_as", F.array(*fixed).alias("fixed"), rate_lines.alias("rates"), base_lines.alias("bases")
        )
        .select("doc_id", "made_as", F.inline(F.concat("fixed", "rates", "bases")))
        .filter(F.col("text").isNotNull())
        .select(
            "doc_id",
            "made_as",
            F.when((doc % 4 == 0) & (F.col("slot") >= 20), 2).otherwise(1).alias("page"),
            F.when(doc % 3 == 1, 1000 - place).otherwise(place).alias("block_seq"),
            (10 + 35 * F.col("slot")).alias("y0"),
            "text",
        )
    )


def _bbox(y0: Column) -> Column:
    return F.struct(
        F.lit(10.0).alias("x0"), y0.alias("y0"), F.lit(200.0).alias("x1"), (y0 + 20).alias("y1")
    )


def text_blocks(lines: DataFrame) -> DataFrame:
    """Every printed line as a digital text block."""
    return lines.select(
        "doc_id",
        "page",
        "block_seq",
        "text",
        _bbox(F.col("y0")).alias("bbox"),
        F.lit("digital_text").alias("source"),
        F.lit(1.0).alias("confidence"),
    )


def pdf_blocks(lines: DataFrame) -> DataFrame:
    """Blocks a PDF reader finds: nothing in scans, only the heading in hybrids."""
    readable = (F.col("made_as").isin("digital", "embedded_xml")) | (
        (F.col("made_as") == "hybrid") & F.startswith("text", F.lit("FACTURA "))
    )
    return text_blocks(lines.filter(readable))


def ocr_lines(lines: DataFrame) -> DataFrame:
    """Lines an OCR engine reports for scans and hybrids, each with its polygon."""
    y0 = F.col("y0")

    def point(x: float, y: Column) -> Column:
        return F.struct(F.lit(x).alias("x"), y.alias("y"))

    corners = F.array(point(10.0, y0), point(200.0, y0), point(200.0, y0 + 20), point(10.0, y0 + 20))
    return lines.filter(F.col("made_as").isin("scanned", "hybrid")).select(
        "doc_id",
        "page",
        F.col("block_seq").alias("line_seq"),
        corners.alias("polygon"),
        "text",
        F.lit(0.92).alias("confidence"),
    )


def page_text(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Text per page as a PDF reader returns it; every document has at least page 1."""
    printed = (
        lines.filter(F.col("made_as").isin("digital", "embedded_xml"))
        .groupBy("doc_id", "page")
        .agg(F.expr("listagg(text, '\n') within group (order by y0, block_seq)").alias("text"))
    )
    other = invoices.filter(
        F.col("made_as").isin("scanned", "hybrid") | (F.col("doc_id") % 37 == 10)
    ).select(
        "doc_id",
        F.lit(1).alias("page"),
        F.when(
            (F.col("made_as") == "hybrid") & (F.col("doc_id") % 37 != 10),
            F.concat(F.lit("  FACTURA "), "number", F.lit("\n")),
        )
        .otherwise(F.lit(" \n"))
        .alias("text"),
    )
    return printed.unionByName(other)


def page_images(invoices: DataFrame) -> DataFrame:
    """Scans and hybrids hold a page picture, every 15th document a logo."""
    picture = F.when(F.col("made_as").isin("scanned", "hybrid"), F.lit(1240))
    logo = F.when(F.col("doc_id") % 15 == 0, F.lit(120))
    return invoices.select(
        "doc_id",
        F.lit(1).alias("page"),
        F.explode(F.array_compact(F.array(picture, logo))).alias("width"),
    ).select(
        "doc_id",
        "page",
        "width",
        F.when(F.col("width") == 1240, 1754).otherwise(60).alias("height"),
        F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"),
    )


def table_grids(invoices: DataFrame) -> DataFrame:
    """The tax table of each invoice as an OCR block: rows by line, cells by tab or pipe."""
    doc = F.col("doc_id")
    bar = F.when(doc % 2 == 0, F.lit("\t")).otherwise(F.lit(" | "))

    def cells(*parts: Column) -> Column:
        return F.concat_ws("\x00", *parts)

    rows = F.transform(
        "lines",
        lambda x: cells(
            F.concat(x["rate"].cast("string"), F.lit("%")),
            grouped_amount(x["base"]),
            F.when(doc % 9 == 4, F.lit("")).otherwise(plain_amount(x["amount"])),
            F.when(
                (doc % 8 == 3) & (x["line_no"] == 0),
                F.concat(F.lit("Retención "), plain_amount(x["amount"])),
            ),
        ),
    )
    heading = F.when(doc % 5 != 1, cells(F.lit("IVA"), F.lit("Base"), F.lit("Cuota")))
    text = F.concat_ws(
        "\n", F.array_compact(F.array(heading)), rows, F.array(F.lit(""), F.lit("Fin de la tabla"))
    )
    return invoices.select(
        "doc_id",
        F.lit(1).alias("page"),
        F.lit(0).alias("block_seq"),
        F.replace(text, F.lit("\x00"), bar).alias("text"),
        _bbox(F.lit(400.0)).alias("bbox"),
        F.when(doc % 3 == 0, 1.0).otherwise(0.88).alias("confidence"),
    )


def _element(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))


def _party(tag: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))


def attachments(invoices: DataFrame) -> DataFrame:
    """XML files attached to every tenth invoice, in seven shapes by ``doc / 10 % 7``.

    0 plain, 1 a foreign file first, 2 decimal commas and free-standing names,
    3 no tax lines and another net element, 4 cut off, 5 a format without a
    record, 6 not named as XML.
    """
    shape = (F.floor(F.col("doc_id") / 10) % 7).cast("int")

    def number(col: Column) -> Column:
        text = col.cast("string")
        return F.when(shape == 2, F.replace(text, F.lit("."), F.lit(","))).otherwise(text)

    def party(tag: str, name: str, tax_id: str) -> Column:
        tax = _element("TaxIdentificationNumber", F.col(tax_id))
        entity = F.when(
            shape == 2, F.concat(_element("Name", F.col(name)), tax)
        ).otherwise(
            F.concat(tax, _party("LegalEntity", _element("CorporateName", F.col(name))))
        )
        return _party(tag, entity)

    heading = F.concat(
        _element("InvoiceNumber", F.col("number")),
        _element("InvoiceDate", F.col("issue_date").cast("string")),
    )
    tax_lines = F.array_join(
        F.transform(
            "lines",
            lambda x: F.concat(
                F.lit("<TaxLine>"),
                _element("TaxRate", number(x["rate"].cast("decimal(4,2)"))),
                _element("TaxableBase", number(x["base"])),
                _element("TaxAmount", number(x["amount"])),
                F.lit("</TaxLine>"),
            ),
        ),
        "",
    )
    net_tag = F.when(shape == 3, F.lit("TotalSums")).otherwise(F.lit("TotalGrossAmountBeforeTaxes"))
    record = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<fe:Facturae xmlns:fe="http://www.facturae.es/">'),
        F.when(shape == 2, F.lit("")).otherwise(
            F.concat(F.lit("<FacturaeHeader>"), heading, F.lit("</FacturaeHeader>"))
        ),
        F.lit("<FacturaeBody><Parties>"),
        party("SellerParty", "supplier_name", "supplier_tax_id"),
        party("BuyerParty", "customer_name", "customer_tax_id"),
        F.lit("</Parties>"),
        F.when(shape == 2, F.concat(F.lit("<Document>"), heading, F.lit("</Document>"))).otherwise(
            F.lit("")
        ),
        F.when(shape == 3, F.lit("")).otherwise(
            F.concat(F.lit("<TaxesOutputs>"), tax_lines, F.lit("</TaxesOutputs>"))
        ),
        F.lit("<InvoiceTotals><"),
        net_tag,
        F.lit(">"),
        number(F.col("net")),
        F.lit("</"),
        net_tag,
        F.lit(">"),
        _element("TotalTaxes", number(F.col("tax"))),
        _element("InvoiceTotal", number(F.col("gross"))),
        F.lit("</InvoiceTotals></FacturaeBody></fe:Facturae>"),
    )
    staged = invoices.filter(F.col("made_as") == "embedded_xml").select(
        "doc_id", "number", record.alias("record")
    )
    record = F.col("record")
    whole = (
        F.when(shape == 4, F.replace(record, F.lit("</fe:Facturae>"), F.lit("")))
        .when(
            shape == 5,
            F.concat(
                F.lit('<Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2">'),
                _element("ID", F.col("number")),
                F.lit("</Invoice>"),
            ),
        )
        .otherwise(record)
    )

    def file(seq: Column, name: Column, raw: Column) -> Column:
        return F.struct(seq.alias("att_seq"), name.alias("filename"), raw.alias("raw_xml"))

    name = (
        F.when(shape == 1, F.lit(" Factura.XML "))
        .when(shape == 6, F.lit("xml-notas.txt"))
        .otherwise(F.lit("factura.xml"))
    )
    own = file((shape == 1).cast("int"), name, whole)
    foreign = file(F.lit(0), F.lit("anexo.xml"), F.lit("<Anexo>x</Anexo>"))
    files = F.array_compact(F.array(F.when(shape == 1, foreign), own))
    return staged.select("doc_id", F.inline(files))


def model_responses(invoices: DataFrame) -> DataFrame:
    """Answers of a model for every third invoice, in five writings by ``doc / 3 % 5``.

    0 plain, 1 fenced, 2 inside prose, 3 with trailing commas, 4 no record in it.
    Invoices with ``doc % 4 = 1`` get no seller tax id.
    """
    writing = (F.floor(F.col("doc_id") / 3) % 5).cast("int")
    tail = F.when(writing == 3, F.lit(",")).otherwise(F.lit(""))

    def text(col: Column) -> Column:
        return F.concat(F.lit('"'), col, F.lit('"'))

    lines = F.array_join(
        F.transform(
            "lines",
            lambda x: F.concat(
                F.lit('{"tax_rate": '),
                text(x["rate"].cast("string")),
                F.lit(', "tax_base": '),
                text(x["base"].cast("string")),
                F.lit(', "tax_amount": '),
                text(x["amount"].cast("string")),
                F.lit("}"),
            ),
        ),
        ", ",
    )
    record = F.concat(
        F.lit('{"invoice_data": {"number": '),
        text(F.col("number")),
        F.lit(', "issue_date": '),
        text(F.col("issue_date").cast("string")),
        F.lit('}, "supplier": {"legal_name": '),
        text(F.col("supplier_name")),
        F.lit(', "tax_id": '),
        F.when(F.col("doc_id") % 4 == 1, F.lit("null")).otherwise(text(F.col("supplier_tax_id"))),
        F.lit('}, "customer": {"legal_name": '),
        text(F.col("customer_name")),
        F.lit(', "tax_id": '),
        text(F.col("customer_tax_id")),
        F.lit('}, "tax_lines": ['),
        lines,
        tail,
        F.lit('], "totals": {"net_amount": '),
        text(F.col("net").cast("string")),
        F.lit(', "tax_amount": '),
        text(F.col("tax").cast("string")),
        F.lit(', "gross_amount": '),
        text(F.col("gross").cast("string")),
        F.lit("}"),
        tail,
        F.lit("}"),
    )
    staged = invoices.filter(F.col("doc_id") % 3 == 0).select("doc_id", record.alias("record"))
    record = F.col("record")
    raw = (
        F.when(writing == 1, F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .when(writing == 2, F.concat(F.lit("Resultado: "), record, F.lit(" Fin.")))
        .when(writing == 4, F.lit("No veo ninguna factura en la imagen."))
        .otherwise(record)
    )
    return staged.select("doc_id", F.lit(1).alias("page"), raw.alias("raw_text"))


def invoice_file() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))


def expected_records(invoices: DataFrame) -> DataFrame:
    """Ledger invoices as ground truth, amounts and rates as text."""
    none = F.lit(None).cast("string")
    doc = F.col("doc_id")
    lines = F.transform(
        "lines",
        lambda x: F.struct(
            x["rate"].cast("string").alias("tax_rate"),
            x["base"].cast("string").alias("tax_base"),
            x["amount"].cast("string").alias("tax_amount"),
        ),
    )
    record = F.struct(
        F.struct(
            F.col("number").alias("number"),
            F.col("issue_date").cast("string").alias("issue_date"),
            none.alias("due_date"),
        ).alias("invoice_data"),
        F.struct(
            F.col("supplier_name").alias("legal_name"), F.col("supplier_tax_id").alias("tax_id")
        ).alias("supplier"),
        F.struct(
            F.col("customer_name").alias("legal_name"), F.col("customer_tax_id").alias("tax_id")
        ).alias("customer"),
        lines.alias("tax_lines"),
        F.struct(
            F.col("net").cast("string").alias("net_amount"),
            F.col("tax").cast("string").alias("tax_amount"),
            F.col("gross").cast("string").alias("gross_amount"),
            none.alias("advance_amount"),
            none.alias("withholding_amount"),
        ).alias("totals"),
    )
    return invoices.select(
        invoice_file().alias("invoice_file"),
        F.when(doc % 3 == 0, "digital").when(doc % 3 == 1, "hybrid").otherwise("scanned").alias(
            "invoice_type"
        ),
        record.alias("expected"),
    )


def planned_predictions(invoices: DataFrame) -> DataFrame:
    """Predictions with planned mistakes, by document number:

    doc % 7 = 1 no prediction, doc % 5 = 1 wrong number, doc % 8 = 3 no date,
    doc % 9 = 4 seller written differently, doc % 9 = 5 the last 2, 4, 6 or 8 letters of the
    seller's normalised name missing, doc % 10 = 5 no buyer name,
    doc % 14 = 9 no buyer tax id, doc % 12 = 7 no tax lines, doc % 11 = 6 first
    tax amount 1.00 off, doc % 6 = 2 gross 5.00 off, doc % 4 = 3 rates with places.
    """
    doc = F.col("doc_id")
    record = F.col("expected")
    places = F.when(doc % 4 == 3, F.lit(".00")).otherwise(F.lit(""))
    off = F.when(doc % 11 == 6, 1).otherwise(0)

    def amount(text: Column, more: Column) -> Column:
        return (text.cast("decimal(18,2)") + more).cast("decimal(18,2)").cast("string")

    lines = F.transform(
        record["tax_lines"],
        lambda x, i: F.struct(
            F.concat(x["tax_rate"], places).alias("tax_rate"),
            x["tax_base"].alias("tax_base"),
            amount(x["tax_amount"], F.when(i == 0, off).otherwise(0)).alias("tax_amount"),
        ),
    )
    supplier = record["supplier"]["legal_name"]
    short = normalize_legal_name(supplier)
    changed = (
        record.withField("invoice_data.number", F.when(doc % 5 == 1, "X").otherwise(record["invoice_data"]["number"]))
        .withField("invoice_data.issue_date", F.when(doc % 8 != 3, record["invoice_data"]["issue_date"]))
        .withField(
            "supplier.legal_name",
            F.when(doc % 9 == 4, F.concat(F.upper(F.replace(supplier, F.lit(" "), F.lit("  "))), F.lit(",")))
            .when(doc % 9 == 5, F.substring(short, F.lit(1), F.length(short) - 2 - 2 * (doc % 4).cast("int")))
            .otherwise(supplier),
        )
        .withField("customer.legal_name", F.when(doc % 10 != 5, record["customer"]["legal_name"]))
        .withField("customer.tax_id", F.when(doc % 14 != 9, record["customer"]["tax_id"]))
        .withField("tax_lines", F.when(doc % 12 != 7, lines).otherwise(F.slice(lines, 1, 0)))
        .withField(
            "totals.gross_amount",
            amount(record["totals"]["gross_amount"], F.when(doc % 6 == 2, 5).otherwise(0)),
        )
    )
    numbered = expected_records(invoices).withColumn(
        "doc_id", F.regexp_extract("invoice_file", "[0-9]+", 0).cast("bigint")
    )
    return numbered.filter(doc % 7 != 1).select("invoice_file", changed.alias("predicted"))

LOOSE_PATHS = ("net", "note", "lines", "nothing", "deep.place")


def loose_records(invoices: DataFrame) -> DataFrame:
    """Expected and predicted records as JSON text of no fixed shape.

    doc % 4 tells the prediction's ``net``: 0 the same number, 1 one more, 2 text with the
    number, 3 missing.  ``note`` differs where doc % 3 = 1 and is a number where doc % 3 = 2,
    ``lines`` is a list that is cut where doc % 5 = 2, ``deep`` is no record where doc % 7 = 3.
    """
    doc = F.col("doc_id")
    net = F.col("net").cast("string")
    more = (F.col("net") + 1).cast("decimal(18,2)").cast("string")

    def named(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    def record(*parts: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    note = quoted(F.when(doc % 3 == 1, "other").otherwise(F.col("number")))
    expected = record(
        named("net", net),
        named("note", quoted(F.col("number"))),
        named("lines", F.lit('[1, "b"]')),
        named("deep", F.lit('{"place": "x"}')),
    )
    predicted = record(
        F.when(doc % 4 != 3, named("net", F.when(doc % 4 == 0, net).when(doc % 4 == 1, more).otherwise(quoted(net)))),
        named("note", F.when(doc % 3 == 2, F.lit("7")).otherwise(note)),
        named("lines", F.when(doc % 5 == 2, "[1]").otherwise('[1, "b"]')),
        named("deep", F.when(doc % 7 == 3, '"text"').otherwise('{"place": "x"}')),
    )
    return invoices.select(
        invoice_file().alias("invoice_file"),
        F.lit("any").alias("invoice_type"),
        expected.alias("expected"),
        predicted.alias("predicted"),
    )


def damaged_grids(grids: DataFrame) -> DataFrame:
    """Tax tables as bad scans give them: nothing legible where doc % 5 = 0, no per cent signs where doc % 7 = 0."""
    doc = F.col("doc_id")
    text = F.when(doc % 5 == 0, F.lit(" ")).when(doc % 7 == 0, F.replace("text", F.lit("%"), F.lit(" "))).otherwise(F.col("text"))
    return grids.withColumn("text", text)
