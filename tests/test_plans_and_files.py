"""What plans read, sources that compete, and files written and read back."""

import json
import re

from pyspark.sql import functions as F

from invoiceloom import fixed_values as fv
from invoiceloom.operators import candidates as cand
from invoiceloom.operators import evaluate as ev
from invoiceloom.operators import metrics, producers, proposals, resolve
from invoiceloom.plans import corpus
from invoiceloom.sources import landed, ledger as led, rendered as ren

from test_scoring_and_runs import landed_tables


def scanned_columns(df) -> list[set]:
    """Columns of each file scan in the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    return [set(re.findall(r"(\w+)#", found)) for found in re.findall(r"FileScan \w+ \[([^\]]*)\]", final)]


def test_inputs_are_read_once(spark, sf, tmp_path):
    _, tables = landed_tables(spark, sf, "doc_id < 200")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = landed.read_corpus(spark, str(tmp_path))
    scans = scanned_columns(cand.document_findings(read["blocks"]))
    assert len(scans) == 1 and "text" in scans[0]
    routed = corpus.routed_documents(read)
    scans = scanned_columns(corpus.extract_invoices(read, routed=routed).groupBy("status").count())
    texts = [s for s in scans if "text" in s]
    assert len(texts) == 2 and sum("polygon" in s for s in texts) == 1  # blocks once, OCR lines once
    assert sum("raw_xml" in s for s in scans) == 1
    assert all("text" in s or "raw_xml" in s or s <= {"doc_id", "route", "kind", "n_lines"} for s in scans)


def test_facts_cross_pages(spark):
    """A section that stays open, a base on a later page, and names counted over pages."""
    lines = [(1, 1, "EMISOR A12345678"), (1, 2, "IVA 21% 21,00 EUR"), (2, 1, "Primera Empresa S.L."), (3, 1, "Segunda Empresa S.L."),
             (3, 2, "Tercera Empresa S.L."), (4, 1, "Base imponible 100,00 EUR"), (4, 2, "CLIENTE B87654321"), (5, 1, "Comercial Ejemplo S.A.")]
    rows = [(9, p, n, t, (0.0, 10.0 * n, 1.0, 1.0), s, 1.0) for p, n, t in lines for s in ("digital_text",)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, block_seq int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, source string, confidence double")
    got = {(r.field_name, r.value) for r in cand.candidates(cand.document_findings(blocks)).collect()}
    assert {("supplier.legal_name", "Primera Empresa S.L."), ("supplier.legal_name", "Segunda Empresa S.L."), ("customer.legal_name", "Comercial Ejemplo S.A.")} <= got
    assert ("supplier.legal_name", "Tercera Empresa S.L.") not in got and ("tax_lines[21.0].tax_base", "100.00") in got


def test_digital_text_beats_surer_ocr(spark):
    bbox = "struct<x0:double,y0:double,x1:double,y1:double>"
    kind = f"doc_id long, page int, block_seq int, text string, bbox {bbox}, source string, confidence double"
    box = (0.0, 1.0, 1.0, 2.0)
    rows = [(1, 1, 0, "EMISOR B11111111", box, "ocr", 0.99), (1, 1, 1, "EMISOR B22222222", box, "digital_text", 0.5), (2, 1, 0, "EMISOR B11111111", box, "ocr", 0.99)]
    found = producers.text_candidates(spark.createDataFrame(rows, kind))
    won = {r.doc_id: (r.value, r.source) for r in resolve.resolve_fields(found, ["supplier.tax_id"]).collect()}
    assert won == {1: ("B22222222", "digital_text"), 2: ("B11111111", "ocr")}


def test_reasons_from_a_resolution(spark):
    bbox = "struct<x0:double,y0:double,x1:double,y1:double>"
    row = lambda doc, field, value, conf: (doc, field, value, None, conf, 1, None, "ocr", 0)
    full = [row(1, f, "x", 0.9) for f in fv.REQUIRED_FIELDS if "tax_id" not in f]
    rows = [*full, row(1, "supplier.tax_id", "B99286320", 0.9), row(1, "customer.tax_id", "00000000T", 0.9), row(1, "tax_lines[21.0].tax_rate", "21", 0.8), row(2, "invoice_data.number", "7", 0.4)]
    c = spark.createDataFrame(rows, f"doc_id long, field_name string, value string, normalized_value string, confidence double, page int, bbox {bbox}, source string, cand_seq int")
    documents = spark.createDataFrame([(1, "digital"), (2, "scanned"), (3, "hybrid")], "doc_id long, kind string")
    read = spark.createDataFrame([(2, 1, i, "t", 0.5) for i in range(9)] + [(3, 1, 0, "t", 0.5)], "doc_id long, page int, line_seq int, text string, confidence double")
    quality = proposals.ocr_quality(documents, read)
    signals = proposals.resolution_signals(resolve.resolve_documents(c, fv.RECORD_FIELDS), documents, c, quality)
    work = {r.doc_id: (r.codes, [x.detail for x in r.reasons]) for r in proposals.work_list(signals).collect()}
    assert set(work) == {2, 3}
    assert work[2][0] == ["missing_field", "low_confidence", "low_confidence_field", "complex_scanned", "tax_table_unresolved"]
    assert work[3][0] == ["missing_field", "low_confidence", "complex_scanned", "tax_table_unresolved", "low_ocr_quality"]
    assert work[2][1][0] == fv.MSG_MODEL_MISSING_FIELD + ", ".join(f for f in fv.REQUIRED_FIELDS if f != "invoice_data.number")


def test_predictions_from_a_file_each(spark, sf, tmp_path):
    truth = ren.expected_records(led.ledger(spark, sf)).limit(5).collect()
    texts = [json.dumps(r.expected.asDict(recursive=True)) for r in truth]
    texts[1], texts[2], texts[3] = texts[1][:-4], "", "[1, 2]"
    for r, text in list(zip(truth, texts, strict=True))[:4]:  # the last one is missing
        (tmp_path / r.invoice_file.replace(".pdf", ".json")).write_text(text)
    pairs = ev.pair_records(spark.createDataFrame(truth, ren.expected_records(led.ledger(spark, sf)).schema), landed.read_predicted(spark, str(tmp_path)))
    got = {r.invoice_file: r for r in pairs.collect()}
    assert [got[r.invoice_file].predicted is not None for r in truth] == [True, False, False, False, False]
    assert [got[r.invoice_file].broken for r in truth] == [None, texts[1], None, texts[3], None]  # an empty file is a missing one
    scores = {r["key"]: r["errors"] for r in ev.roll_ups(ev.evaluate_fields(pairs)).filter("level = 'invoice'").collect()}
    assert scores == {r.invoice_file: 0 if i == 0 else 8 for i, r in enumerate(truth)}


def test_why_a_field_fails(spark):
    rows = [("a.pdf", "any", '{"n": 100.5, "t": "x", "l": [1], "totals": {"net_amount": "1"}}', '{"n": "90.25", "t": "y", "l": {"k": 1}, "totals": {"net_amount": "1"}}')]
    pairs = spark.createDataFrame(rows, "invoice_file string, invoice_type string, expected string, predicted string")
    got = {r.field_path: r for r in ev.evaluate_fields(pairs, ("n", "t", "l", "none", "totals", "supplier.legal_name")).collect()}
    assert (got["n"].metric, got["n"].detail, got["n"].match) == ("tolerance", "expected 100.5, got 90.25, diff 10.25", False)
    assert (got["t"].metric, got["t"].detail) == ("exact", "expected 'x', got 'y'")
    assert (got["l"].metric, got["l"].detail) == ("structural", "mismatch: <class 'list'> vs <class 'dict'>")
    assert (got["none"].metric, got["none"].detail, got["none"].match) == ("exact", "both null", True)
    assert got["totals"].match and got["totals"].metric == "totals" and got["supplier.legal_name"].match


def test_responses_of_a_run_are_gzipped_and_read_back_whole(spark, sf, tmp_path):
    _, tables = landed_tables(spark, sf, "doc_id < 40")
    responses, path = corpus.extract_invoices(tables), str(tmp_path / "out")
    for run in ("a", "b", "b"):
        landed.write_responses(responses, path, run_id=run)
    files = [f.name for f in (tmp_path / "out" / "run_id=b").glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    columns = ["doc_id", "kind", "route", "status", "invoice", "global_score", "needs_review", "warnings", "errors"]
    want = responses.select(*columns).collect()
    assert sorted(landed.read_responses(spark, path, "b").select(*columns).collect(), key=lambda r: r.doc_id) == sorted(want, key=lambda r: r.doc_id)


def test_a_run_replaces_only_itself(spark, sf, tmp_path):
    _, tables = landed_tables(spark, sf, "doc_id < 40")
    stages = metrics.StageTimes("r")
    responses = corpus.extract_invoices(tables, stages=stages)
    path = str(tmp_path / "out")
    stages.run("responses", responses, lambda df: landed.write_responses(df, path, run_id="r"), metrics.response_counts())
    landed.write_responses(responses.limit(3), path, run_id="s")
    landed.write_responses(responses, path, run_id="r")
    want = corpus.extract_invoices(tables).select("doc_id", "status", "invoice", "warnings").collect()
    back = landed.read_responses(spark, path, "r").select("doc_id", "status", "invoice", "warnings").collect()
    assert sorted(back) == sorted(want) and landed.read_responses(spark, path, "s").count() == 3
    assert '"net_amount":"' in spark.read.text(path).filter("value like '%net_amount%'").first()[0]
    counts = {r.stage: r.metadata for r in stages.table(spark).collect()}
    assert int(counts["responses"]["documents"]) == len(want)
    found = cand.document_findings(corpus.routed_blocks(tables, corpus.routed_documents(tables)).drop("route"))
    assert int(counts["candidates"]["candidates"]) == cand.candidates(found).count() > 0
