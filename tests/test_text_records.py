from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from invoiceloom import schemas
from invoiceloom.operators import candidates as cand
from invoiceloom.plans import corpus

NINE = [
    "FACTURA 2024/001", "Fecha: 01/03/2024", "EMISOR A12345678", "Empresa Proveedora S.L.",
    "CLIENTE B87654321", "Cliente Ejemplo S.A.", "Base imponible 100,00 EUR",
    "IVA 21% 21,00 EUR", "TOTAL FACTURA 121,00 EUR",
]


def make_blocks(spark, docs, source="digital_text"):
    rows = []
    for doc_id, texts in docs.items():
        for i, text in enumerate(texts):
            y = 10.0 + 40 * i
            rows.append((doc_id, 1, i, text, (0.0, y, 100.0, y + 20), source, 1.0))
    return spark.createDataFrame(rows, schemas.BLOCKS)


def kinds(spark, docs, kind):
    return spark.createDataFrame([(d, kind) for d in docs], "doc_id bigint, kind string")


def long_candidates(spark, texts):
    found = cand.candidates(cand.document_findings(make_blocks(spark, {1: texts})))
    return {(r.field_name, r.value): r.confidence for r in found.collect()}


def test_ocr_record_of_nine_blocks(spark):
    lines = make_blocks(spark, {1: NINE}).select(
        "doc_id", "page", F.col("block_seq").alias("line_seq"),
        F.expr("array(named_struct('x', bbox.x0, 'y', bbox.y0), named_struct('x', bbox.x1, 'y', bbox.y0),"
               " named_struct('x', bbox.x1, 'y', bbox.y1), named_struct('x', bbox.x0, 'y', bbox.y1))").alias("polygon"),
        "text", F.lit(0.9).alias("confidence"),
    )
    r = corpus.ocr_branch(kinds(spark, [1], "scanned"), lines).collect()[0]
    assert r.status == "ok"
    assert r.invoice.invoice_data.number == "2024/001"
    assert r.invoice.invoice_data.issue_date.isoformat() == "2024-03-01"
    assert r.invoice.supplier == ("Empresa Proveedora S.L.", "A12345678")
    assert r.invoice.customer == ("Desconocido", "B87654321")
    assert r.invoice.tax_lines == []
    assert r.invoice.totals.net_amount == Decimal("100.00")
    assert r.invoice.totals.tax_amount == Decimal("21.00")
    assert r.invoice.totals.gross_amount == Decimal("121.00")
    assert r.fields == pytest.approx(
        {
            "invoice_data.number": 0.85, "invoice_data.issue_date": 0.85, "supplier.tax_id": 0.425,
            "supplier.legal_name": 0.85, "customer.tax_id": 0.425, "customer.legal_name": 0.0,
            "tax_lines": 0.0, "totals.net_amount": 0.85, "totals.tax_amount": 0.8,
            "totals.gross_amount": 0.9, "totals": 0.85,
        }
    )
    assert r.global_score == pytest.approx(6.8 / 9)
    assert set(r.needs_review) == {"supplier.tax_id", "customer.tax_id", "customer.legal_name", "tax_lines"}
    assert len(r.warnings) == 6
    assert r.evidence["invoice_data.number"].source == "ocr"


def test_digital_record_reports_missing_fields_as_errors(spark):
    r = corpus.text_branch(kinds(spark, [1, 2], "digital"), make_blocks(spark, {1: ["nada"]}), "digital")
    for row in r.collect():
        assert row.status == "error" and row.invoice is None
        assert [e.field for e in row.errors] == [
            "invoice_data.number", "invoice_data.issue_date", "supplier.tax_id", "customer.tax_id",
        ]
        assert row.warnings[-1].startswith("Faltan campos")


def test_silent_scan(spark):
    empty = spark.createDataFrame([], schemas.OCR_LINES)
    r = corpus.ocr_branch(kinds(spark, [7], "scanned"), empty).collect()[0]
    assert [e.code for e in r.errors] == ["ocr_no_text"]


def test_base_before_rate_gives_no_tax_line(spark):
    got = long_candidates(spark, ["Base imponible 100,00 EUR", "IVA 21% 21,00 EUR"])
    assert ("tax_lines[21.0].tax_amount", "21.00") in got
    assert not [k for k in got if k[0].endswith("tax_base")]
    got = long_candidates(spark, ["IVA 21% 21,00 EUR", "IVA 10% 1,00 EUR", "Base imponible 100,00 EUR", "Base imponible 9,00 EUR"])
    assert ("tax_lines[21.0].tax_base", "100.00") in got and ("tax_lines[10.0].tax_base", "100.00") in got


def test_base_in_the_same_block_counts(spark):
    got = long_candidates(spark, ["Base imponible 50,00 EUR IVA 4% 2,00"])
    assert ("tax_lines[4.0].tax_base", "50.00") in got


def test_scanning_stops_at_gross(spark):
    got = long_candidates(spark, ["TOTAL FACTURA 121,00 EUR", "Base imponible 100,00 EUR", "IVA 21% 21,00 EUR"])
    names = {k[0] for k in got}
    assert "totals.gross_amount" in names
    assert "totals.net_amount" not in names and "totals.tax_amount" not in names


def test_names_first_two_per_section(spark):
    texts = ["Antes S.L.", "EMISOR", "Primera Linea", "Segunda S.L.", "Tercera S.L.", "CLIENTE", "123 no", "Cliente Final S.A."]
    found = cand.document_findings(make_blocks(spark, {1: texts}))
    r = found.collect()[0]
    assert (r.supplier_name_1.value, r.supplier_name_2.value) == ("Primera Linea", "Segunda S.L.")
    assert r.supplier_name.value == "Segunda S.L."
    assert r.customer_name is None


def test_tax_id_after_buyer_word_and_dashed(spark):
    got = long_candidates(spark, ["B12345674 CLIENTE 12345678-Z"])
    assert got[("customer.tax_id", "12345678Z")] == 0.8


def test_dates_need_a_word_and_month_may_pass_as_number(spark):
    got = long_candidates(spark, ["15/01/2024", "Fecha 2024.3.1"])
    assert ("invoice_data.issue_date", "2024-3-1") in got
    assert ("invoice_data.number", "01/2024") in got


def test_thousands_in_rate_lines_are_cut(spark):
    got = long_candidates(spark, ["IVA 21% 1.234,56 EUR", "IVA 21,00"])
    assert ("tax_lines[21.0].tax_amount", "1.23") in got
    assert ("tax_lines[2.0].tax_amount", "1.00") in got


def test_reading_order_beats_input_order(spark):
    b = make_blocks(spark, {1: ["FACTURA 2024/002", "FACTURA 2024/001"]}).withColumn(
        "bbox", F.expr("named_struct('x0', bbox.x0, 'y0', -bbox.y0, 'x1', bbox.x1, 'y1', bbox.y1)")
    )
    assert cand.document_findings(b).collect()[0].number.value == "2024/001"


def paged_blocks(spark, rows):
    """(doc, page, text) in reading order."""
    full = [(d, p, i, t, (0.0, 10.0 + 40 * i, 100.0, 30.0 + 40 * i), "digital_text", 1.0) for i, (d, p, t) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.BLOCKS)


def test_sections_bases_and_names_cross_pages(spark):
    b = paged_blocks(spark, [
        (1, 1, "EMISOR A12345678"),
        (1, 2, "Empresa Proveedora S.L."), (1, 2, "IVA 21% 21,00 EUR"),
        (1, 3, "Otra Empresa S.A."), (1, 3, "CLIENTE B87654321"), (1, 3, "Firma Ejemplo S.A."),
        (1, 4, "Tercer Nombre S.L."),
        (1, 5, "Base imponible 100,00 EUR"),
        (2, 1, "Empresa Sola S.L."), (2, 2, "EMISOR A12345678"), (2, 3, "Empresa Tarde S.L."),
    ])
    named = cand.findings_in_order(b).filter("fact = 'name'").orderBy("doc_id", "page", "block_seq").collect()
    assert [(r.doc_id, r.value, r.section, r.name_rank) for r in named] == [
        (1, "Empresa Proveedora S.L.", "supplier", 1),
        (1, "Otra Empresa S.A.", "supplier", 2),
        (1, "Firma Ejemplo S.A.", "customer", 1),
        (1, "Tercer Nombre S.L.", "customer", 2),
        (2, "Empresa Sola S.L.", None, None),
        (2, "Empresa Tarde S.L.", "supplier", 1),
    ]
    one, two = cand.document_findings(b).orderBy("doc_id").collect()
    assert one.supplier_name.value == "Empresa Proveedora S.L." and one.customer_name.value == "Firma Ejemplo S.A."
    assert [(r.rate, r.amount, r.base) for r in one.rates] == [(Decimal("21.00"), "21.00", "100.00")]
    assert two.supplier_name.value == "Empresa Tarde S.L."


def test_a_document_that_holds_a_third_of_all_blocks(spark):
    rows = [(1, p, t) for p in range(1, 401) for t in ("sin datos", "IVA 21% 21,00 EUR")]
    rows = [(1, 0, "EMISOR A12345678"), *rows, (1, 401, "Base imponible 100,00 EUR"), (1, 402, "Empresa Final S.L.")]
    rows += [(d, 1, t) for d in range(2, 180) for t in NINE]
    found = {r.doc_id: r for r in cand.document_findings(paged_blocks(spark, rows)).collect()}
    assert len(found) == 179
    assert found[1].rates[0].page == 1 and found[1].rates[0].base == "100.00"
    assert found[1].supplier_name.value == "Empresa Final S.L." and found[1].supplier_name.page == 402
    assert all(found[d].number.value == "2024/001" for d in range(2, 180))


def test_buyer_id_after_characters_of_two_units(spark):
    got = long_candidates(spark, ["\U0001f600" * 12 + " CLIENTE 12345678Z"])
    assert ("customer.tax_id", "12345678Z") in got


def test_no_job_runs_while_a_plan_is_built(spark):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    cand.document_findings(make_blocks(spark, {1: NINE}))
    assert not status.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_facts_are_made_in_projections_and_move_once(spark):
    plan = cand.findings_in_order(make_blocks(spark, {1: NINE}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "inline(concat(single" in plan and "collect_list" not in plan


def test_every_text_a_pattern_matches_holds_one_of_its_parts(spark):
    from invoiceloom import fixed_values as fv

    of = {
        "seller": (fv.SELLER_WORDS, cand._SELLER_PARTS, "emitido|emitida|emisor|proveedor|vendedor|vendor|de parte de|ship from|shipfrom|supplier|seller"),
        "buyer": (fv.BUYER_WORDS, cand._BUYER_PARTS, "domicilio de entrega|domicilio cliente|domicilio destino|cliente|comprador|buyer|customer|purchaser"
                  "|bill to|billto|ship to|shipto|billed to|billedto"),
        "base": (fv.BASE_WORDS, cand._BASE_PARTS, "x base imponible|base tax|taxable base|imponible|base "),
        "tax": (fv.TAX_WORDS, cand._TAX_PARTS, "iva|impuesto|tax|vat|i.v.a|i.va|iv.a|i.v.a."),
        "date": (fv.DATE_WORDS, cand._DATE_PARTS, "fecha|fecha de factura|f em|f. em.|fem|f.em|issue date|issuedate"),
        "company": (fv.COMPANY_FORM, cand._COMPANY_PARTS, "x s.l|x sl|x s.a|x sa|s.l.u|slu|s.a.u|sau|s.lu|sl.u|limitada|anónima|bis断续"),
        "total": (fv.TOTAL_WORDS, cand._TOTAL_PARTS, "total factura|total general|total bruto|importe total|total a pagar|total pagar|grand total"
                  "|amount due|total: 5|total = 5€"),
        "number": (fv.INVOICE_NUMBER, cand._NUMBER_PARTS, "2024/001|24-123|F123|f-123|F / 123|A24/123|K24-123|İ024/123"),
    }
    forms = [str, str.upper, str.title, *[lambda t, a=a, b=b: t.replace(a, b) for a, b in ("iİ", "iı", "sſ", "kK")]]
    for pattern, parts, texts in of.values():
        rows = [(form(t),) for t in texts.split("|") for form in forms]
        df = spark.createDataFrame(rows, "text string").where(F.col("text").rlike(pattern))
        assert df.count() >= len(texts.split("|"))
        missed = df.where(~cand.contains_any(F.lower("text"), parts)).collect()
        assert missed == []
