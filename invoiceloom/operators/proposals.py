"""Model proposals: when to ask, how to read the answers, what they are worth."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions import strip

_SINGLE = (
    ("invoice_data.number", fv.PROPOSAL_CONF_FIELD),
    ("invoice_data.issue_date", fv.PROPOSAL_CONF_FIELD),
    ("supplier.legal_name", fv.PROPOSAL_CONF_FIELD),
    ("supplier.tax_id", fv.PROPOSAL_CONF_FIELD),
    ("customer.legal_name", fv.PROPOSAL_CONF_FIELD),
    ("customer.tax_id", fv.PROPOSAL_CONF_FIELD),
)
_TOTALS = (
    ("totals.net_amount", fv.PROPOSAL_CONF_AMOUNT),
    ("totals.tax_amount", fv.PROPOSAL_CONF_AMOUNT),
    ("totals.gross_amount", fv.PROPOSAL_CONF_AMOUNT),
)
_PARTS = ("tax_rate", "tax_base", "tax_amount")


def recover_json(responses: DataFrame) -> DataFrame:
    """The JSON text inside each answer, or why there is none (``error``).

    A fenced block goes first, then everything between the outer braces; trailing
    commas are dropped only when the text does not parse as it stands.
    """
    text = strip(F.col("raw_text"))
    fenced = F.regexp_extract("text", fv.PROPOSAL_FENCE, 1)
    has_fence = F.regexp_like("text", F.lit(fv.PROPOSAL_FENCE))
    braced = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    cut = (
        responses.withColumn("text", text)
        .withColumn("has_fence", has_fence)
        .withColumn(
            "piece",
            F.when(F.col("has_fence"), strip(fenced))
            .when(braced != "", braced)
            .when(F.try_parse_json("text").isNotNull(), F.col("text")),
        )
        .withColumn("repaired", F.regexp_replace("piece", fv.TRAILING_COMMA, "$1"))
    )
    json = F.when(F.try_parse_json("piece").isNotNull(), F.col("piece")).when(
        F.try_parse_json("repaired").isNotNull(), F.col("repaired")
    )
    return cut.withColumn("json", json).select(
        "doc_id",
        "page",
        "json",
        F.when(F.coalesce("text", F.lit("")) == "", "empty")
        .when(F.col("piece").isNull(), "no_json")
        .when(F.col("json").isNull(), "invalid_json")
        .alias("error"),
    )


def proposed_fields(recovered: DataFrame) -> DataFrame:
    """One row per proposed value: doc_id, page, seq, field_name, line_index, part, value, confidence.

    Empty values are not proposed.
    """
    # An answer without JSON gives a NULL record and so no rows; a filter here would
    # only make the optimizer copy the whole recovery into its condition.
    r = recovered.withColumn("r", F.from_json("json", schemas.MODEL_RECORD))

    def row(seq, name: Column, value: Column, confidence: float, index=None, part=None) -> Column:
        seq = F.lit(seq) if isinstance(seq, int) else seq
        return F.when(
            F.coalesce(value, F.lit("")) != "",
            F.struct(
                seq.cast("int").alias("seq"),
                name.alias("field_name"),
                (F.lit(None) if index is None else index).cast("int").alias("line_index"),
                F.lit(part).cast("string").alias("part"),
                value.alias("value"),
                F.lit(confidence).alias("confidence"),
            ),
        )

    def single(offset: int, fields) -> Column:
        return F.array(
            *[
                row(offset + i, F.lit(name), F.col(f"r.{name}"), confidence)
                for i, (name, confidence) in enumerate(fields)
            ]
        )

    def parts(line: Column, i: Column) -> Column:
        return F.array(
            *[
                row(
                    100 + i * 3 + j,
                    F.concat(F.lit("tax_lines["), i.cast("string"), F.lit(f"].{part}")),
                    line[part],
                    fv.PROPOSAL_CONF_AMOUNT,
                    i,
                    part,
                )
                for j, part in enumerate(_PARTS)
            ]
        )

    listed = F.flatten(F.transform("r.tax_lines", parts))
    first = single(0, _SINGLE)
    last = single(100_000, _TOTALS)
    made = r.select("doc_id", "page", first.alias("first"), F.coalesce(listed, F.array()).alias("listed"), last.alias("last"))
    return made.select("doc_id", "page", F.inline(F.concat("first", "listed", "last"))).filter(F.col("seq").isNotNull())


def proposal_candidates(proposed: DataFrame) -> DataFrame:
    """Proposals as candidates: discounted confidence, no box, source vlm."""
    return proposed.select(
        "doc_id",
        "field_name",
        "value",
        F.col("value").alias("normalized_value"),
        (F.col("confidence") * fv.PROPOSAL_FACTOR).alias("confidence"),
        F.coalesce("page", F.lit(1)).alias("page"),
        F.lit(None).cast(schemas.BBOX).alias("bbox"),
        F.lit("vlm").alias("source"),
        F.col("seq").alias("cand_seq"),
        "line_index",
        "part",
    )


def best_proposals(candidates: DataFrame) -> DataFrame:
    """Best proposal per document and field; the first of equals stays."""
    best = F.min(F.struct((-F.col("confidence")).alias("worst"), "page", "cand_seq", "value", "confidence"))
    return (
        candidates.groupBy("doc_id", "field_name")
        .agg(best.alias("b"))
        .select("doc_id", "field_name", "b.value", "b.confidence", "b.page")
    )


def model_reasons(
    missing: Column,
    low_fields: Column,
    global_confidence: Column,
    is_scanned: Column,
    tax_unresolved: Column,
    low_ocr: Column | None = None,
) -> Column:
    """Why a model should be asked: array of (code, detail), empty when it should not."""
    required = F.array(*[F.lit(f) for f in fv.REQUIRED_FIELDS])
    critical = F.filter(F.coalesce(missing, F.array().cast("array<string>")), lambda f: F.array_contains(required, f))
    key_low = F.filter(F.coalesce(low_fields, F.array().cast("array<string>")), lambda f: F.array_contains(required, f))

    def reason(when: Column, code: str, detail) -> Column:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    return F.array_compact(
        F.array(
            reason(
                F.size(critical) > 0,
                "missing_field",
                F.concat(F.lit(fv.MSG_MODEL_MISSING_FIELD), F.array_join(critical, ", ")),
            ),
            reason(
                global_confidence < fv.MODEL_GLOBAL_BELOW,
                "low_confidence",
                F.concat(
                    F.lit("Confianza global "),
                    F.format_string("%.2f", global_confidence),
                    F.lit(f" < {fv.MODEL_GLOBAL_BELOW}"),
                ),
            ),
            reason(
                F.size(key_low) > 0,
                "low_confidence_field",
                F.concat(F.lit(fv.MSG_MODEL_LOW_FIELD), F.array_join(key_low, ", ")),
            ),
            reason(is_scanned & tax_unresolved, "complex_scanned", fv.MSG_MODEL_COMPLEX_SCANNED),
            reason(tax_unresolved, "tax_table_unresolved", fv.MSG_MODEL_TABLE),
            reason(F.lit(False) if low_ocr is None else low_ocr, "low_ocr_quality", fv.MSG_MODEL_LOW_OCR),
        )
    )


def ocr_quality(documents: DataFrame, ocr_lines: DataFrame, fewest: int = fv.OCR_LINES_BELOW) -> DataFrame:
    """Per scanned or hybrid document (doc_id, kind): lines read, their mean confidence, and whether they are too few."""
    read = ocr_lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("ocr_lines"), F.avg("confidence").alias("ocr_confidence")
    )
    scans = documents.filter(F.col("kind").isin("scanned", "hybrid")).select("doc_id")
    lines = F.coalesce("ocr_lines", F.lit(0))
    return scans.join(read, "doc_id", "left").select(
        "doc_id", lines.alias("ocr_lines"), "ocr_confidence", (lines < fewest).alias("low_ocr")
    )


def _with_quality(rows: DataFrame, quality: DataFrame | None) -> DataFrame:
    """``rows`` with ``low_ocr``; false for documents that no OCR was asked for."""
    if quality is None:
        return rows.withColumn("low_ocr", F.lit(False))
    told = rows.join(quality.select("doc_id", "low_ocr"), "doc_id", "left")
    return told.withColumn("low_ocr", F.coalesce("low_ocr", F.lit(False)))


def response_signals(responses: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """What finished responses say about the need for a model, and the reasons.

    ``quality`` (doc_id, low_ocr) comes from ``ocr_quality``.
    """
    signals = _with_quality(responses, quality).withColumns(
        {
            "missing": F.array_compact(F.transform("errors", lambda e: e["field"])),
            "low_fields": F.map_keys(F.map_filter("fields", lambda _, v: v < fv.MODEL_FIELD_BELOW)),
            "is_scanned": F.col("kind").isin("scanned", "hybrid"),
            "tax_unresolved": F.coalesce(F.size("invoice.tax_lines"), F.lit(-1)) <= 0,
        }
    )
    return _with_reasons(signals)


def resolution_signals(
    resolved: DataFrame, documents: DataFrame, candidates: DataFrame, quality: DataFrame | None = None
) -> DataFrame:
    """What a resolution says about the need for a model, for every document (doc_id, kind).

    ``resolved`` comes from ``resolve_documents``: required fields it lacks are missing, its
    ``needs_review`` is low.  Tax lines are unresolved where no candidate names one.  A
    document without any candidate misses everything and has confidence 0.
    """
    lined = (
        candidates.filter(F.startswith("field_name", F.lit("tax_lines[")))
        .groupBy("doc_id")
        .agg(F.lit(True).alias("has_lines"))
    )
    met = documents.select("doc_id", "kind").join(resolved, "doc_id", "left").join(lined, "doc_id", "left")
    required = F.array(*[F.lit(f) for f in fv.REQUIRED_FIELDS])
    found = F.coalesce(F.map_keys("values"), F.array().cast("array<string>"))
    signals = _with_quality(met, quality).withColumns(
        {
            "missing": F.array_except(required, found),
            "low_fields": F.coalesce("needs_review", F.array().cast("array<string>")),
            "global_score": F.coalesce("global_score", F.lit(0.0)),
            "is_scanned": F.col("kind").isin("scanned", "hybrid"),
            "tax_unresolved": F.col("has_lines").isNull(),
        }
    )
    return _with_reasons(signals)


def _with_reasons(signals: DataFrame) -> DataFrame:
    names = ("missing", "low_fields", "global_score", "is_scanned", "tax_unresolved", "low_ocr")
    return signals.withColumn("reasons", model_reasons(*[F.col(c) for c in names]))


def work_list(signals: DataFrame) -> DataFrame:
    """Documents a model should look at, with the reasons."""
    return signals.filter(F.size("reasons") > 0).select(
        "doc_id", F.transform("reasons", lambda r: r["code"]).alias("codes"), "reasons"
    )


def model_work_list(responses: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The work list told by finished responses."""
    return work_list(response_signals(responses, quality))
