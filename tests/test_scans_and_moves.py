"""How often registered queries read the ledger, compute a step, or move rows."""

import re

from pyspark.sql import functions as F

from catalog import queries as cq
from invoiceloom import fixed_values as fv
from invoiceloom.operators import candidates as cand
from invoiceloom.operators import proposals, resolve
from invoiceloom.sources import landed, ledger as led, rendered as ren

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
CANDIDATE = f"doc_id long, field_name string, value string, normalized_value string, confidence double, page int, bbox {BBOX}, source string, cand_seq int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def ledger_scans(df) -> int:
    """Scans that read how an invoice was made: only the ledger tells it."""
    return len([c for c in re.findall(r"FileScan parquet \[([^\]]*)\]", plan(df)) if "made_as" in c])


def test_the_ledger_is_read_from_files_by_column(spark, sf):
    inv = cq.invoices(spark, sf)
    assert "InMemoryTableScan" not in plan(inv) and "InMemoryRelation" not in plan(inv)
    assert re.findall(r"FileScan parquet \[([^\]]*)\]", re.sub(r"#\d+L?", "", plan(ren.page_images(inv)))) == ["doc_id,made_as"]
    same = [led.ledger(spark, sf).select("doc_id", F.to_json(F.struct("*")).alias("j")).collect(), inv.select("doc_id", F.to_json(F.struct("*")).alias("j")).collect()]
    assert sorted(same[0]) == sorted(same[1])
    assert cq.invoices(spark, sf) is inv


def test_a_ledger_that_is_gone_is_written_again(spark, sf, monkeypatch):
    inv = cq.invoices(spark, sf)
    monkeypatch.setattr(cq, "exists", lambda spark, path: False)
    again = cq.invoices(spark, sf)
    assert again is not inv and again.count() == inv.count() > 0


def test_rejections_and_work_lists_classify_once(spark, sf):
    assert ledger_scans(cq.d5_rejections(spark, sf)) == 2  # OCR lines; the attachments
    assert ledger_scans(cq.m3_resolution_work_list(spark, sf)) == 1  # OCR lines; candidates are written once
    assert ledger_scans(cq.m3_model_work_list(spark, sf)) <= 4  # blocks, OCR lines twice, attachments


def test_a_report_computes_its_results_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(landed, "write_report", lambda results, levels, folder, run: seen.append((results, levels)))
    monkeypatch.setattr(landed, "read_report", lambda *a: seen[0])
    cq.s11_report_levels(spark, sf)
    assert len(seen) == 2
    assert all("ArrowEvalPython" not in plan(x) for pair in seen for x in pair)


def test_resolution_moves_candidates_once(spark):
    rows = [(d, f, f"{d}{f}", None, 0.9, 1, None, s, 0) for d in (1, 2) for f in fv.RECORD_FIELDS for s in ("ocr", "vlm")]
    found = resolve.resolve_documents(spark.createDataFrame(rows, CANDIDATE), fv.RECORD_FIELDS)
    assert plan(found).count("Exchange ") == 1
    assert sorted((r.doc_id, len(r["values"]), {e.source for e in r.evidence.values()}) for r in found.collect()) == [(1, 9, {"ocr"}), (2, 9, {"ocr"})]


def test_candidates_are_unfolded_without_a_filter_inside(spark, sf):
    inv = led.ledger(spark, sf)
    made = [ren.rendered_lines(inv), cand.candidates(cand.document_findings(ren.text_blocks(ren.rendered_lines(inv)))),
            proposals.proposed_fields(proposals.recover_json(ren.model_responses(inv)))]
    assert all("inline(filter" not in plan(df) and "inline(knownnotcontainsnull" not in plan(df) for df in made)
