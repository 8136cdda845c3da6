"""A whole corpus: route every document and run its branch.

Routing reduces every input to one row per document and is written once: a few bytes a
document.  Blocks and OCR lines meet their routes before any pattern is looked for, so text
of another branch is never matched, and both go through one pass.  Which policy applies to a
document is told by its route.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.candidates import candidate_count, document_findings
from ..operators.metrics import StageTimes
from ..operators.prepare import classify, non_blank, ocr_blocks, rejected, route
from ..sources.shared import written
from .records import text_records
from .xml_plan import error_columns, error_record, xml_branch

TABLES = ("page_text", "page_images", "attachments", "blocks", "ocr_lines")
_BLOCK = ("doc_id", "page", "block_seq", "text", "bbox", "source", "confidence")


def text_branch(
    documents: DataFrame,
    blocks: DataFrame,
    branch: str,
    include_evidence: bool = True,
) -> DataFrame:
    """Records of documents (doc_id, kind) from their blocks, found or not."""
    findings = document_findings(blocks)
    return text_records(
        documents.select("doc_id", "kind").join(findings, "doc_id", "left"), branch, include_evidence
    )


def silenced(records: DataFrame) -> DataFrame:
    """Records of OCR documents in which nothing was read (``n_lines`` 0 or NULL) become error rows."""
    silent = (F.col("route") == "ocr") & (F.coalesce("n_lines", F.lit(0)) == 0)
    instead = error_columns(
        F.lit("ocr_no_text"), F.lit(fv.MSG_OCR_NO_TEXT), F.array(F.lit(fv.MSG_OCR_NO_TEXT_WARNING))
    )
    return records.withColumns(
        {c: F.when(silent, other).otherwise(F.col(c)) for c, other in instead.items()}
    ).drop("n_lines")


def ocr_branch(
    documents: DataFrame,
    lines: DataFrame,
    include_evidence: bool = True,
) -> DataFrame:
    """OCR documents; those in which nothing was read become error rows."""
    counted = documents
    if "n_lines" not in documents.columns:  # else counted along with the kinds
        read = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
        counted = documents.join(read, "doc_id", "left")
    met = counted.select("doc_id", "kind", "n_lines").join(document_findings(ocr_blocks(lines)), "doc_id", "left")
    return silenced(text_records(met, "ocr", include_evidence, "n_lines"))


def routed_documents(tables: dict, force_ocr: bool = False) -> DataFrame:
    """doc_id, kind, n_lines and route of every document that a table names, written once."""
    kinds = classify(*[tables[name] for name in TABLES])
    routed = kinds.select("doc_id", "kind", "n_lines", route(F.col("kind"), force_ocr).alias("route"))
    return written(routed, "routes")


def routed_blocks(tables: dict, routed: DataFrame) -> DataFrame:
    """Blocks of documents on the digital route and OCR lines of those on the OCR route."""
    branches = {"digital": non_blank(tables["blocks"]), "ocr": ocr_blocks(tables["ocr_lines"])}
    tagged = [b.select(*_BLOCK).withColumn("route", F.lit(name)) for name, b in branches.items()]
    return tagged[0].unionByName(tagged[1]).join(routed.select("doc_id", "route"), ["doc_id", "route"], "left_semi")


def extract_invoices(
    tables: dict,
    force_ocr: bool = False,
    include_evidence: bool = True,
    routed: DataFrame | None = None,
    stages: StageTimes | None = None,
) -> DataFrame:
    """One response per document of the corpus; ``tables`` holds the five inputs by name.

    Routing runs as a job of its own; the rest is one plan.  ``routed`` may bring a routing
    that was made before.  ``stages`` gets a stage "candidates" that counts documents with
    findings and their candidates while the responses are made.
    """
    routed = routed_documents(tables, force_ocr) if routed is None else routed
    findings = document_findings(routed_blocks(tables, routed).drop("route"))
    if stages is not None:
        counts = {"documents": F.count(F.lit(1)), "candidates": F.sum(candidate_count(findings))}
        findings = stages.watch("candidates", findings, counts)
    met = routed.filter(F.col("route") != "xml").join(findings, "doc_id", "left")
    text = silenced(text_records(met, F.col("route"), include_evidence, "n_lines"))
    xml = xml_branch(routed.filter(F.col("route") == "xml"), tables["attachments"], include_evidence)
    return text.unionByName(xml)


def rejected_records(kinds: DataFrame, branch: str, force_ocr: bool = False) -> DataFrame:
    """Responses for documents handed to a branch that does not take their kind."""
    rows = rejected(kinds, branch, force_ocr).join(kinds.select("doc_id", "kind"), "doc_id")
    return error_record(rows.withColumn("warnings", F.array().cast("array<string>")), branch)
