from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from invoiceloom import fixed_values as fv
from invoiceloom import schemas
from invoiceloom.operators import prepare, proposals, tax_tables as tt, validate, xml_records
from invoiceloom.operators.resolve import needs_review, resolve_documents, resolve_fields
from invoiceloom.plans import corpus, proposal_plan, xml_plan

D = Decimal


def grid_lines(spark, rows):
    g = spark.createDataFrame([(1, 1, rows)], "doc_id bigint, page int, rows array<array<string>>")
    return tt.tax_line_candidates(tt.cells_from_grid(g)).orderBy("row").collect()


def test_grid_with_header(spark):
    (r,) = grid_lines(spark, [["IVA", "Base", "Cuota"], ["21%", "100,00", "21,00"]])
    assert (r.tax_rate, r.tax_base, r.tax_amount) == (D("21"), D("100.00"), D("21.00"))
    assert r.source == "synthetic" and r.confidence == pytest.approx(2.5 / 3)


def test_grid_withholding(spark):
    (r,) = grid_lines(spark, [["21%", "1000,00", "210,00", "Retención 105,00"]])
    assert r.withholding_amount == D("105.00")
    (r,) = grid_lines(spark, [["21%", "", "210,00", "reten 105,00"]])
    assert (r.tax_base, r.tax_amount, r.withholding_amount) == (D("210.00"), None, D("105.00"))
    (r,) = grid_lines(spark, [["reten 9,00", "21%", "5,00", "reten 1,00", "reten 2,00"]])
    assert r.withholding_amount == D("2.00")
    (r,) = grid_lines(spark, [["reten 9,00", "21%", "5,00"]])
    assert r.withholding_amount is None
    (r,) = grid_lines(spark, [["x", "reten 21% 7,00", "5,00"]])
    assert r.withholding_amount is None


def test_grid_mismatch_and_incomplete_confidence(spark):
    good, bad = grid_lines(spark, [["21%", "500,00", "105,00"], ["21%", "100,00", "50,00"]])
    assert good.confidence >= 0.8 and bad.confidence == pytest.approx(0.7)
    (half,) = grid_lines(spark, [["10%", "5,00"]])
    assert half.confidence == pytest.approx(0.8)


def test_row_with_rate_and_header_word_is_skipped(spark):
    assert grid_lines(spark, [["IVA 21%", "100,00", "21,00"]]) == []


def test_grid_warnings(spark):
    g = spark.createDataFrame(
        [(1, 1, []), (2, 1, [[" "]]), (3, 1, [["x"]]), (4, 1, [["21%", "1,00"]])],
        "doc_id bigint, page int, rows array<array<string>>",
    )
    got = {r.doc_id: r.message for r in tt.grid_warnings(g).collect()}
    assert got == {1: fv.MSG_GRID_EMPTY, 2: fv.MSG_GRID_BLANK, 3: fv.MSG_GRID_NO_LINES}


def test_tables_do_not_mix_and_kinds_are_kept(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [
        (1, 1, t, 1, kind, 0, c, text, box, 1.0)
        for t, kind in ((0, "tax_table"), (1, "unknown"), (2, "line_items"))
        for c, text in enumerate(["21%", f"{t + 1}00,00", "21,00"])
    ]
    lines = tt.tax_line_candidates(spark.createDataFrame(rows, schemas.TABLE_CELLS)).orderBy("table_seq").collect()
    assert [(r.table_seq, r.tax_base, r.source) for r in lines] == [
        (0, D("100.00"), "layout"), (1, D("200.00"), "layout"),
    ]


XML = """<?xml version="1.0"?><fe:Facturae xmlns:fe="http://www.facturae.es/">
<FacturaeHeader><InvoiceNumber>2024/001</InvoiceNumber><InvoiceDate>2024-01-15</InvoiceDate></FacturaeHeader>
<FacturaeBody><Parties>{seller}{buyer}</Parties>
<TaxesOutputs>{lines}</TaxesOutputs>
<InvoiceTotals><TotalGrossAmountBeforeTaxes>{net}</TotalGrossAmountBeforeTaxes><TotalTaxes>210.00</TotalTaxes>
<InvoiceTotal>1210.00</InvoiceTotal></InvoiceTotals></FacturaeBody></fe:Facturae>"""
SELLER = "<SellerParty><LegalEntity><CorporateName>Uno  S.L.</CorporateName><TaxIdentificationNumber>B64188642</TaxIdentificationNumber></LegalEntity></SellerParty>"
BUYER = "<BuyerParty><TaxIdentificationNumber>00000000T</TaxIdentificationNumber><Name>Dos</Name></BuyerParty>"
LINE = "<TaxLine><TaxRate>21.00</TaxRate><TaxableBase>1000.00</TaxableBase><TaxAmount>210.00</TaxAmount></TaxLine>"


def attach(spark, *raws):
    return spark.createDataFrame(
        [(i, 0, "f.xml", raw) for i, raw in enumerate(raws)], schemas.ATTACHMENTS
    )


def test_xml_records(spark):
    a = attach(
        spark,
        XML.format(seller=SELLER, buyer=BUYER, lines=LINE, net="1000.00"),
        XML.format(seller=SELLER, buyer="", lines=LINE, net="1500,00"),
        XML.format(seller="<SellerParty><Extra>B64188642</Extra></SellerParty>", buyer=BUYER, lines="", net="x"),
        "<Otro><Facturae/></Otro>",
        "<Facturae><FacturaeHeader>",
        "<Facturae><FacturaeBody/></Facturae>",
    )
    got = {r.doc_id: r for r in xml_records.parse_attachments(a).collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0].supplier_name == "Uno S.L." and got[0].customer_name == "Dos"
    assert got[0].customer_tax_id == "00000000T" and got[0].net_amount == D("1000")
    assert got[0].tax_lines[0].tax_rate == D("21")
    assert got[2].supplier_tax_id == "B64188642" and got[2].net_amount is None
    docs = spark.createDataFrame([(i, "embedded_xml") for i in range(7)], "doc_id bigint, kind string")
    out = {r.doc_id: r for r in xml_plan.xml_branch(docs, a).collect()}
    assert out[0].status == "ok" and out[0].warnings == []
    assert out[0].fields["tax_lines[21]"] == 0.95
    assert [e.code for e in out[1].errors] == ["xml_invalid_data"]
    assert [e.code for e in out[4].errors] == ["xml_parse_failed"]
    assert [e.code for e in out[6].errors] == ["no_xml_found"]


def test_repeated_rate_in_xml_keeps_both_lines(spark):
    a = attach(spark, XML.format(seller=SELLER, buyer=BUYER, lines=LINE + LINE, net="1000.00"))
    docs = spark.createDataFrame([(0, "embedded_xml")], "doc_id bigint, kind string")
    r = xml_plan.xml_branch(docs, a).collect()[0]
    assert len(r.invoice.tax_lines) == 2 and len(r.fields) == 11
    assert fv.MSG_TOTALS["net_amount_mismatch"] in r.warnings


def test_xml_formats(spark):
    given = {
        "<Facturae x>": "facturae",
        '<Invoice xmlns="urn:ubl">': "ubl",
        "<CrossIndustryInvoice>": "cii",
        "zugferd": "cii",
        '<rsm:X><DocumentContext/>': "cii",
        "<x/>": "unknown",
        " " * 10_000 + "<Facturae>": "facturae",
    }
    df = spark.createDataFrame([(k,) for k in given], "raw string")
    got = {r.raw: r.f for r in df.select("raw", prepare.xml_format(F.col("raw")).alias("f")).collect()}
    assert got == given


def test_two_grids_on_a_page_stay_apart(spark):
    g = spark.createDataFrame(
        [(1, 1, 0, [["21%", "100,00", "21,00"]]), (1, 1, 1, [["10%", "50,00", "5,00"]])],
        "doc_id bigint, page int, table_seq int, rows array<array<string>>",
    )
    got = tt.tax_line_candidates(tt.cells_from_grid(g)).orderBy("table_seq").collect()
    assert [(r.tax_rate, r.tax_base, r.tax_amount) for r in got] == [
        (D("21"), D("100.00"), D("21.00")), (D("10"), D("50.00"), D("5.00")),
    ]


def facturae(lines, head=""):
    told = "".join(
        f"<TaxLine><TaxRate>{r}</TaxRate><TaxableBase>{b}</TaxableBase><TaxAmount>{a}</TaxAmount></TaxLine>" for r, b, a in lines
    )
    return (
        f"{head}<Facturae><FacturaeHeader><InvoiceNumber>A1</InvoiceNumber><InvoiceDate>2024-01-01</InvoiceDate></FacturaeHeader>"
        f"<FacturaeBody><TaxesOutputs>{told}</TaxesOutputs></FacturaeBody></Facturae>"
    )


def attached(spark, *files):
    return spark.createDataFrame([(i, 0, "factura.xml", f) for i, f in enumerate(files)], schemas.ATTACHMENTS)


def test_an_impossible_rate_leaves_its_line_out(spark):
    got = xml_records.parse_attachments(attached(spark, facturae([("21000", "1", "1"), ("21", "100", "21")]))).collect()
    assert [x.tax_rate for x in got[0].tax_lines] == [D("21")]


def test_a_record_behind_a_long_comment_is_parsed(spark):
    got = xml_records.parse_attachments(attached(spark, facturae([("21", "100", "21")], "<!--" + "x" * 10_000 + "-->"))).collect()
    assert [r.invoice_number for r in got] == ["A1"]


def test_many_tax_lines_in_one_file_end_in_seconds(spark):
    import time

    entries = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.struct((i % 20_000).cast("string").alias("key"), i.alias("value"))).alias("e")
    )
    started = time.perf_counter()
    (r,) = entries.select(xml_plan.last_wins(F.col("e")).alias("k")).collect()
    assert [x.value for x in r.k] == list(range(40_000, 60_000))
    assert time.perf_counter() - started < 30


def test_a_rate_of_25_digits_leaves_its_line_out(spark):
    raw = """{"invoice_data": {"number": "A1"}, "tax_lines": [
      {"tax_rate": "1234567890123456789012345", "tax_base": "1,00", "tax_amount": "1,00"},
      {"tax_rate": "21", "tax_base": "100,00", "tax_amount": "21,00"}]}"""
    c = proposals.proposal_candidates(proposals.proposed_fields(proposals.recover_json(answers(spark, raw))))
    (r,) = proposal_plan.proposal_records(c).collect()
    assert r.doc_id == 0 and len(r.errors) > 0


def test_every_document_of_any_table_gets_a_kind(spark):
    def table(ddl, *rows):
        return spark.createDataFrame(list(rows), ddl)

    page_text = table(schemas.PAGE_TEXT, (1, 1, "x" * 80))
    images = spark.createDataFrame([], schemas.PAGE_IMAGES).unionByName(
        spark.range(1).selectExpr("2L as doc_id"), allowMissingColumns=True
    )
    xml = attached(spark, facturae([])).withColumn("doc_id", F.lit(3).cast("bigint"))
    blocks = spark.createDataFrame([], schemas.BLOCKS)
    ocr = spark.createDataFrame([], schemas.OCR_LINES).unionByName(
        spark.range(1).selectExpr("4L as doc_id", "1 as page", "0 as line_seq", "'texto' as text"), allowMissingColumns=True
    )
    got = prepare.classify(page_text, images, xml, blocks, ocr).orderBy("doc_id").collect()
    assert [(r.doc_id, r.kind, r.n_lines) for r in got] == [
        (1, "digital", 0), (2, "scanned", 0), (3, "embedded_xml", 0), (4, "scanned", 1),
    ]
    tables = {"page_text": page_text, "page_images": images, "attachments": xml, "blocks": blocks, "ocr_lines": ocr}
    assert {r.doc_id for r in corpus.extract_invoices(tables).select("doc_id").collect()} == {1, 2, 3, 4}


def answers(spark, *raws):
    return spark.createDataFrame([(i, 1, r) for i, r in enumerate(raws)], schemas.MODEL_RESPONSES)


def test_json_recovery(spark):
    good = '{"invoice_data": {"number": "A1"}}'
    got = proposals.recover_json(
        answers(spark, good, f"```json\n{good}\n```", f"```\n{good}\n```", f"x {good} y",
                '{"invoice_data": {"number": "A1",},}', "", "  ", "nada", "{roto", "{a: 1}")
    ).orderBy("doc_id").collect()
    assert [r.error for r in got] == [None] * 5 + ["empty", "empty", "no_json", "no_json", "invalid_json"]


def test_proposal_record(spark):
    raw = """{"invoice_data": {"number": " A/1 ", "issue_date": "2024-01-15"},
      "supplier": {"legal_name": "S", "tax_id": "b99286320"}, "customer": {"legal_name": null, "tax_id": "12345678Z"},
      "tax_lines": [{"tax_rate": 21, "tax_base": 100.0, "tax_amount": 21.0}],
      "totals": {"net_amount": "100,00", "tax_amount": 21, "gross_amount": "120.00"}}"""
    c = proposals.proposal_candidates(proposals.proposed_fields(proposals.recover_json(answers(spark, raw))))
    r = proposal_plan.proposal_records(c).collect()[0]
    assert r.status == "ok" and r.invoice.supplier.tax_id == "B99286320"
    assert r.invoice.customer.legal_name == "Desconocido"
    assert r.invoice.tax_lines[0].tax_rate == D("21")
    assert r.warnings == [fv.MSG_TOTALS["gross_amount_mismatch"]]
    assert r.fields["invoice_data.number"] == pytest.approx(0.7)


def test_source_priority_beats_confidence(spark):
    rows = [
        (1, "supplier.tax_id", "B11111111", None, 0.95, 1, None, "ocr", 0),
        (1, "supplier.tax_id", "B22222222", None, 0.80, 1, None, "digital_text", 1),
        (1, "supplier.tax_id", "  ", None, 0.99, 1, None, "xml", 2),
        (1, "invoice_data.number", "A", None, 0.5, 1, None, "ocr", 3),
        (1, "invoice_data.number", "B", None, 0.5, 1, None, "ocr", 4),
    ]
    c = spark.createDataFrame(rows, schemas.CANDIDATES)
    got = {r.field_name: r.value for r in resolve_fields(c).collect()}
    assert got == {"supplier.tax_id": "B22222222", "invoice_data.number": "A"}
    d = resolve_documents(c, fv.RECORD_FIELDS).collect()[0]
    assert d.fields["supplier.tax_id"] == pytest.approx(0.4) and len(d.warnings) == 1
    assert d.needs_review == ["invoice_data.number", "supplier.tax_id"]


def test_review_of_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.9,)], "c double")
    c = F.col("c")
    got = df.select(needs_review(c).alias("a"), needs_review(c, include_zero=True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(False, True), (True, True), (False, False)]


def test_total_checks(spark):
    lines = spark.createDataFrame(
        [(1, 0, D("21"), D("100.00"), D("21.00")), (1, 1, D("10"), D("50.00"), D("5.00")),
         (2, 0, D("21"), D("100.00"), D("20.00")), (3, 0, D("21"), D("100.00"), D("21.00"))],
        schemas.TAX_LINES,
    )
    totals = spark.createDataFrame(
        [(1, D("150.00"), D("26.00"), D("176.00"), None, None), (2, D("100.00"), D("20.00"), D("121.00"), None, None),
         (3, D("100.00"), D("21.00"), D("96.00"), D("10.00"), D("15.00")), (4, D("1.00"), D("0.01"), D("1.00"), None, None)],
        schemas.TOTALS,
    )
    got = [(r.doc_id, r.code, r.field) for r in validate.validate_totals(lines, totals).orderBy("doc_id", "rank").collect()]
    assert got == [
        (2, "tax_line_mismatch", "tax_lines[0].tax_amount"),
        (2, "gross_amount_mismatch", "totals.gross_amount"),
        (4, "net_amount_mismatch", "totals.net_amount"),
    ]
