"""Documents before extraction: kind, route, order, eligibility."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import contains_any, strip


def non_blank(blocks: DataFrame) -> DataFrame:
    """Blocks with text; confidence 1.0 and digital source unless given."""
    return blocks.filter(strip(F.col("text")) != "")


def xml_attachments(attachments: DataFrame) -> DataFrame:
    """Attachments whose trimmed name ends in .xml, with the format of their content."""
    return attachments.filter(
        F.endswith(F.lower(strip(F.col("filename"))), F.lit(".xml"))
    ).withColumn("format", xml_format(F.col("raw_xml")))


def image_counts(page_images: DataFrame) -> DataFrame:
    return page_images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"))


def polygon_bbox(polygon: Column) -> Column:
    """Bounding box of four corners; any other polygon gives the zero box."""

    def edge(pick, axis: str) -> Column:
        return F.when(F.size(polygon) == 4, pick(F.transform(polygon, lambda p: p[axis]))).otherwise(
            F.lit(0.0)
        )

    return F.struct(
        edge(F.array_min, "x").alias("x0"),
        edge(F.array_min, "y").alias("y0"),
        edge(F.array_max, "x").alias("x1"),
        edge(F.array_max, "y").alias("y1"),
    )


def ocr_blocks(ocr_lines: DataFrame) -> DataFrame:
    """OCR lines as text blocks."""
    return ocr_lines.select(
        "doc_id",
        "page",
        F.col("line_seq").alias("block_seq"),
        "text",
        polygon_bbox(F.col("polygon")).alias("bbox"),
        F.lit("ocr").alias("source"),
        "confidence",
    )


def mentions_xml(text: Column) -> Column:
    lowered = F.lower(text)
    return F.contains(text, F.lit("<?xml")) | contains_any(lowered, ("<facturae", "<ubl", "<cii"))


def xml_format(raw: Column, prefix_bytes: int | None = None) -> Column:
    """Format told by the file, or by its first ``prefix_bytes``; the first rule that holds decides."""
    if prefix_bytes is None:
        head = F.lower(raw)
    else:
        first_bytes = F.substring(F.to_binary(raw, F.lit("utf-8")), 1, prefix_bytes)
        head = F.lower(F.make_valid_utf8(first_bytes.cast("string")))

    def has(word: str) -> Column:
        return F.contains(head, F.lit(word))

    return (
        F.when(has("<facturae"), "facturae")
        .when(has("<invoice") & has("xmlns") & (has("ubl") | has("un-cefact")), "ubl")
        .when(has("cross-industry-invoice") | has("zugferd") | has("<crossindustryinvoice"), "cii")
        .when(has("<rsm") & has("documentcontext"), "cii")
        .otherwise("unknown")
    )


def classify(
    page_text: DataFrame,
    page_images: DataFrame,
    attachments: DataFrame,
    blocks: DataFrame | None = None,
    ocr_lines: DataFrame | None = None,
) -> DataFrame:
    """Kind per document: doc_id, has_xml, text_length, images, n_lines, kind.

    Every document that any table names gets a row.  All tables are reduced to a row per
    document in one aggregate, so no text is shuffled.  ``n_lines`` counts OCR lines.
    """
    seen = {"text_length": "bigint", "text_xml": "boolean", "images": "bigint", "file_xml": "boolean", "n_lines": "bigint"}

    def told(table: DataFrame, **known: Column) -> DataFrame:
        return table.select(
            "doc_id", *[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in seen.items()]
        )

    parts = told(
        page_text, text_length=F.length(strip(F.col("text"))), text_xml=mentions_xml(F.col("text"))
    )
    parts = parts.unionByName(told(page_images, images=F.lit(1)))
    parts = parts.unionByName(
        told(attachments, file_xml=F.contains(F.lower("filename"), F.lit("xml")))
    )
    if blocks is not None:
        parts = parts.unionByName(told(blocks))
    if ocr_lines is not None:
        parts = parts.unionByName(told(ocr_lines, n_lines=F.lit(1)))
    no, none = F.lit(False), F.lit(0).cast("bigint")
    return (
        parts.groupBy("doc_id")
        .agg(
            (
                F.coalesce(F.bool_or("text_xml"), no) | F.coalesce(F.bool_or("file_xml"), no)
            ).alias("has_xml"),
            *[F.coalesce(F.sum(c), none).alias(c) for c in ("text_length", "images", "n_lines")],
        )
        .withColumn("kind", document_kind())
    )


def document_kind() -> Column:
    return (
        F.when(F.col("has_xml"), "embedded_xml")
        .when(F.col("text_length") == 0, "scanned")
        .when((F.col("text_length") < fv.HYBRID_TEXT_BELOW) & (F.col("images") > 0), "hybrid")
        .otherwise("digital")
    )


def route(kind: Column, force_ocr: bool = False) -> Column:
    ocr = F.lit(force_ocr) | kind.isin("scanned", "hybrid")
    return F.when(kind == "embedded_xml", "xml").when(ocr, "ocr").otherwise("digital")


def eligible(kind: Column, branch: str, force_ocr: bool = False) -> Column:
    """Kinds a branch takes when it is called directly."""
    if branch == "digital":
        return kind.isin("digital", "hybrid")
    return F.lit(force_ocr) | kind.isin("scanned", "hybrid")


def rejected(kinds: DataFrame, branch: str, force_ocr: bool = False) -> DataFrame:
    """Error rows of documents a branch does not take: doc_id, code, message, field."""
    before, after = fv.MSG_KIND_DIGITAL if branch == "digital" else fv.MSG_KIND_OCR
    return kinds.filter(~eligible(F.col("kind"), branch, force_ocr)).select(
        "doc_id",
        F.lit("unsupported_pdf_kind").alias("code"),
        F.concat(F.lit(before), "kind", F.lit(after)).alias("message"),
        F.lit("file").alias("field"),
    )


def without_text(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """OCR documents in which nothing was read."""
    return documents.join(blocks.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id",
        F.lit("ocr_no_text").alias("code"),
        F.lit(fv.MSG_OCR_NO_TEXT).alias("message"),
        F.lit("file").alias("field"),
    )


def without_xml(documents: DataFrame, attachments: DataFrame) -> DataFrame:
    """Documents of the XML branch without a usable attachment."""
    return documents.join(
        xml_attachments(attachments).select("doc_id"), "doc_id", "left_anti"
    ).select(
        "doc_id",
        F.lit("no_xml_found").alias("code"),
        F.lit(fv.MSG_NO_XML).alias("message"),
        F.lit("file").alias("field"),
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """Dense position of every block on its page: pages ascending, then top edge, then input order."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.col("bbox.y0"), "block_seq")
    return blocks.withColumn("position", F.row_number().over(w))


def page_full_text(blocks: DataFrame) -> DataFrame:
    """Text of each page, blocks joined by a line break."""
    return blocks.groupBy("doc_id", "page").agg(
        F.expr("listagg(text, '\n') within group (order by bbox.y0, block_seq)").alias("text")
    )


def full_text(blocks: DataFrame) -> DataFrame:
    """Text of each document, pages joined by an empty line."""
    return (
        page_full_text(blocks)
        .groupBy("doc_id")
        .agg(F.expr("listagg(text, '\n\n') within group (order by page)").alias("full_text"))
    )
