"""Registered queries.

Every one reads the given tables, whole, or invoices derived from them.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoiceloom import fixed_values as fv
from invoiceloom import functions as fn
from invoiceloom import schemas
from invoiceloom.operators import evaluate as ev
from invoiceloom.operators import metrics, prepare, producers, proposals, resolve, validate, xml_records
from invoiceloom.operators import candidates as cand
from invoiceloom.operators import tax_tables as tt
from invoiceloom.plans import corpus, proposal_plan, xml_plan
from invoiceloom.sources import landed, ledger as led, rendered as ren
from invoiceloom.sources.shared import exists, shared_folder, written

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- inputs -----------------------------------------------------------------
_LEDGERS: dict = {}


def invoices(spark, sf):
    """The derived ledger, one row per invoice, written once to the shared folder for the queries of a session.

    Landed invoice tables take its place outside these checks.  Most queries scan it several times: from
    files each scan reads its own columns, and no executor's memory holds the ledger.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LEDGERS or not all(exists(spark, f) for f in _LEDGERS[key].inputFiles()[:1]):
        _LEDGERS[key] = written(led.ledger(spark, sf), "ledger")
    return _LEDGERS[key]


def printed(spark, sf):
    return ren.rendered_lines(invoices(spark, sf))


def blocks(spark, sf):
    return ren.text_blocks(printed(spark, sf))


def findings(spark, sf):
    return cand.document_findings(blocks(spark, sf))


def corpus_tables(spark, sf):
    inv = invoices(spark, sf)
    lines = ren.rendered_lines(inv)
    return {
        "page_text": ren.page_text(inv, lines),
        "page_images": ren.page_images(inv),
        "attachments": ren.attachments(inv),
        "blocks": ren.pdf_blocks(lines),
        "ocr_lines": ren.ocr_lines(lines),
    }


def kinds(spark, sf):
    t = corpus_tables(spark, sf)
    return prepare.classify(*[t[name] for name in corpus.TABLES])


def cells(spark, sf):
    return tt.cells_from_blocks(ren.table_grids(invoices(spark, sf)))


def table_lines(spark, sf):
    return tt.tax_line_candidates(cells(spark, sf))


def xml_first(spark, sf):
    return xml_records.first_record(
        xml_records.parse_attachments(ren.attachments(invoices(spark, sf)))
    )


def recovered(spark, sf):
    return proposals.recover_json(ren.model_responses(invoices(spark, sf)))


def proposal_candidates(spark, sf):
    return proposals.proposal_candidates(proposals.proposed_fields(recovered(spark, sf)))


def pairs(spark, sf):
    inv = invoices(spark, sf)
    return ev.pair_records(ren.expected_records(inv), ren.planned_predictions(inv))


def field_results(spark, sf):
    return ev.evaluate_fields(pairs(spark, sf))


def text(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def near(col) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def flat(responses: DataFrame, *extra) -> DataFrame:
    """A response as one row of plain values."""
    inv = F.col("invoice")
    line = F.transform(
        inv["tax_lines"],
        lambda x: F.concat_ws(
            ":", fn.plain_rate(x["tax_rate"]), x["tax_base"].cast("string"), x["tax_amount"].cast("string")
        ),
    )
    return responses.select(
        "doc_id",
        *extra,
        "status",
        inv["invoice_data"]["number"].alias("number"),
        text(inv["invoice_data"]["issue_date"]).alias("issue_date"),
        inv["supplier"]["tax_id"].alias("supplier_id"),
        inv["supplier"]["legal_name"].alias("supplier_name"),
        inv["customer"]["tax_id"].alias("customer_id"),
        inv["customer"]["legal_name"].alias("customer_name"),
        F.array_join(line, ";").alias("lines_text"),
        text(inv["totals"]["net_amount"]).alias("net_amount"),
        text(inv["totals"]["tax_amount"]).alias("tax_amount"),
        text(inv["totals"]["gross_amount"]).alias("gross_amount"),
        near("global_score").alias("global_score"),
        F.array_join("needs_review", "|").alias("needs_review"),
        F.array_join("warnings", "|").alias("warnings"),
        F.array_join(
            F.transform("errors", lambda e: F.concat(e["code"], F.lit(":"), e["field"])), "|"
        ).alias("errors"),
    )


# ---- sources ----------------------------------------------------------------
@query
def s1_page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = led.read_table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("block_seq", "text")
    )
    return (
        prepare.non_blank(lines)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))
    )


@query
def s2_page_text(spark, sf):
    inv = invoices(spark, sf)
    return ren.page_text(inv, ren.rendered_lines(inv)).select(
        "doc_id", "page", F.md5("text").alias("digest")
    )


@query
def s3_image_counts(spark, sf):
    return prepare.image_counts(ren.page_images(invoices(spark, sf)))


@query
def s4_xml_attachments(spark, sf):
    return prepare.xml_attachments(ren.attachments(invoices(spark, sf))).select(
        "doc_id", "att_seq", "filename", "format"
    )


@query
def s5_ocr_blocks(spark, sf):
    return prepare.ocr_blocks(ren.ocr_lines(printed(spark, sf))).select(
        "doc_id", "page", "block_seq", "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "confidence"
    )


@query
def s6_table_cells(spark, sf):
    return cells(spark, sf).select(
        "doc_id", "row", "col", "text", near("bbox.x0").alias("x0"), near("bbox.y0").alias("y0"),
        near("bbox.x1").alias("x1"), near("bbox.y1").alias("y1"), "confidence",
    )


@query
def s7_model_responses(spark, sf):
    return ren.model_responses(invoices(spark, sf)).select(
        "doc_id", "page", F.startswith("raw_text", F.lit("```")).alias("fenced")
    )


@query
def s8_expected_records(spark, sf):
    """Ground truth written as JSON and read back, whole records."""
    path = shared_folder(spark, "expected")
    landed.write_expected(ren.expected_records(invoices(spark, sf)), path)
    e = landed.read_expected(spark, path, lines=True)
    lines = F.transform("expected.tax_lines", lambda x: F.concat_ws(":", x["tax_rate"], x["tax_base"], x["tax_amount"]))
    r = "expected"
    return e.select(
        "invoice_file", "invoice_type", f"{r}.invoice_data.number", f"{r}.invoice_data.issue_date",
        f"{r}.invoice_data.due_date", F.col(f"{r}.supplier.tax_id").alias("supplier_id"),
        F.col(f"{r}.supplier.legal_name").alias("supplier_name"), F.col(f"{r}.customer.tax_id").alias("customer_id"),
        F.col(f"{r}.customer.legal_name").alias("customer_name"), F.array_join(lines, ";").alias("lines_text"),
        *[f"{r}.totals.{t}" for t in ("net_amount", "tax_amount", "gross_amount", "withholding_amount")],
    )


def _prediction_files(spark, sf):
    """Predictions written and read back; every eleventh is cut off, those of doc % 7 = 1 are missing."""
    planned = ren.planned_predictions(invoices(spark, sf))
    whole = F.to_json("predicted")
    doc = F.regexp_extract("invoice_file", "[0-9]+", 0).cast("bigint")
    text_ = F.when(doc % 11 == 3, F.left(whole, F.length(whole) - 5)).otherwise(whole)
    folder = shared_folder(spark, "predictions")
    landed.write_predicted(planned.select("invoice_file", text_.alias("text")), folder)
    return landed.read_predicted(spark, folder, bulk=True)


@query
def s9_prediction_keys(spark, sf):
    """Predictions read from JSON by the name of their invoice; broken ones are told."""
    return _prediction_files(spark, sf).select(
        "invoice_key", F.col("broken").isNotNull().alias("broken"),
        F.col("predicted.invoice_data.number").alias("number"),
        F.col("predicted.totals.gross_amount").alias("gross_amount"),
    )


@query
def s10_response_json(spark, sf):
    """Responses written as JSON for a run, twice, and read back whole."""
    path = shared_folder(spark, "responses")
    responses = written(corpus.extract_invoices(corpus_tables(spark, sf)), "extracted")
    for run in ("other", "this", "this"):
        landed.write_responses(responses.filter(F.col("route") == "xml") if run == "other" else responses, path, run_id=run)
    return flat(landed.read_responses(spark, path, "this"), "kind", "route")


@query
def s11_report_levels(spark, sf):
    """A report written for a run, twice, and read back: every row of its levels."""
    folder = shared_folder(spark, "report")
    results = written(field_results(spark, sf), "results")
    for _ in range(2):
        landed.write_report(results, ev.roll_ups(results), folder, "this")
    fields, levels = landed.read_report(spark, folder, "this")
    counted = fields.agg(
        F.lit("results").alias("level"), F.lit(None).cast("string").alias("key"), F.count(F.lit(1)).alias("fields"),
        F.count(F.when(~F.col("match"), 1)).alias("errors"), F.avg("score").alias("score"),
    )
    return levels.select("level", "key", "fields", "errors", "score").unionByName(counted).withColumn("score", near("score"))


# ---- preparation ------------------------------------------------------------
@query
def d1_xml_flag(spark, sf):
    """XML mentions in raw web pages and in prose."""
    pages = led.read_table(spark, sf, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    docs = led.read_table(spark, sf, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    return pages.unionByName(docs).select(
        "origin", "id", prepare.mentions_xml(F.col("text")).alias("has_xml"),
        F.length(fn.strip(F.col("text"))).alias("text_length"),
    )


@query
def d2_classify(spark, sf):
    return kinds(spark, sf).drop("n_lines")


@query
def d3_xml_format(spark, sf):
    a = ren.attachments(invoices(spark, sf))
    return a.select("doc_id", "att_seq", prepare.xml_format(F.col("raw_xml")).alias("format"))


@query
def d4_routes(spark, sf):
    return kinds(spark, sf).select(
        "doc_id",
        prepare.route(F.col("kind")).alias("route"),
        prepare.route(F.col("kind"), force_ocr=True).alias("forced_route"),
    )


@query
def d5_rejections(spark, sf):
    t = corpus_tables(spark, sf)
    k = routed = corpus.routed_documents(t)
    rows = [
        prepare.rejected(k, "digital").withColumn("branch", F.lit("digital")),
        prepare.rejected(k, "ocr").withColumn("branch", F.lit("ocr")),
        prepare.without_text(routed.filter(F.col("route") == "ocr"), t["ocr_lines"]).withColumn(
            "branch", F.lit("ocr")
        ),
        prepare.without_xml(routed.filter(F.col("route") == "xml"), t["attachments"]).withColumn(
            "branch", F.lit("xml")
        ),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query
def d6_reading_order(spark, sf):
    return prepare.reading_order(blocks(spark, sf)).select("doc_id", "page", "block_seq", "position")


@query
def d7_all_blocks(spark, sf):
    return blocks(spark, sf).select("doc_id", "page", "block_seq", "text", "source", "confidence")


@query
def d8_full_text(spark, sf):
    return prepare.full_text(blocks(spark, sf)).select(
        "doc_id", F.length("full_text").alias("chars"), F.md5("full_text").alias("digest")
    )


# ---- scalars ----------------------------------------------------------------
def _money_texts(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    shown = [
        F.concat(ren.grouped_amount(price), F.lit(" €")),
        F.format_number(price, 2),
        ren.plain_amount(price),
        F.concat(F.lit(" EUR"), text(price)),
        F.concat(text("l_orderkey"), F.lit("."), text("l_suppkey")),
        F.concat(F.lit("no es dinero "), text(price)),
        F.concat(F.lit("1,2,3"), text("l_linenumber")),
        F.concat(text("l_linenumber"), F.lit(".005")),
    ]
    pick = (F.col("l_partkey") % len(shown)).cast("int")
    return led.read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.element_at(F.array(*shown), pick + 1).alias("raw")
    )


@query
def f1_money(spark, sf):
    return _money_texts(spark, sf).select(
        "l_orderkey", "l_linenumber", "raw", text(fn.normalize_money(F.col("raw"))).alias("amount")
    )


@query
def f2_table_money(spark, sf):
    return cells(spark, sf).select(
        "doc_id", "row", "col", text(fn.table_money(F.col("text"))).alias("amount")
    )


@query
def f3_withholding_amount(spark, sf):
    return cells(spark, sf).select(
        "doc_id", "row", "col", text(fn.first_withholding_amount(F.col("text"))).alias("amount")
    )


def _ids(spark, sf):
    """Tax ids of all invoices, as printed, with separators and lower case."""
    inv = invoices(spark, sf)
    s = F.col("supplier_tax_id")
    c = F.col("customer_tax_id")
    shown = F.array(
        s,
        c,
        F.concat(F.left(s, F.lit(1)), F.lit("-"), F.substring(s, 2, 7), F.lit("-"), F.right(s, F.lit(1))),
        F.lower(F.concat(F.left(c, F.lit(8)), F.lit(" "), F.right(c, F.lit(1)))),
        F.concat(F.left(c, F.lit(8)), F.lit("A")),
        F.col("number"),
    )
    return inv.select("doc_id", F.posexplode(shown).alias("n", "raw"))


@query
def f4_normalized_tax_id(spark, sf):
    return _ids(spark, sf).select("doc_id", "n", fn.normalize_tax_id(F.col("raw")).alias("tax_id"))


@query
def f5_nif_valid(spark, sf):
    return _ids(spark, sf).select("doc_id", "n", "raw", fn.is_valid_nif(F.col("raw")).alias("valid"))


@query
def f6_nie_valid(spark, sf):
    return _ids(spark, sf).select("doc_id", "n", "raw", fn.is_valid_nie(F.col("raw")).alias("valid"))


@query
def f7_cif_valid(spark, sf):
    return _ids(spark, sf).select("doc_id", "n", "raw", fn.is_valid_cif(F.col("raw")).alias("valid"))


@query
def f8_tax_id_valid(spark, sf):
    return _ids(spark, sf).select("doc_id", "n", "raw", fn.is_valid_tax_id(F.col("raw")).alias("valid"))


@query
def f9_invoice_date(spark, sf):
    o = led.read_table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    shown = [
        F.date_format(d, "yyyy-MM-dd"),
        F.date_format(d, "dd/MM/yyyy"),
        F.date_format(d, "d-M-yyyy"),
        F.concat(F.lit(" "), F.date_format(d, "dd.MM.yyyy")),
        F.concat(F.lit("31/"), F.date_format(d, "MM/yyyy")),
        F.date_format(d, "MM/yyyy"),
    ]
    raw = F.element_at(F.array(*shown), (F.col("o_custkey") % len(shown) + 1).cast("int"))
    return o.select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", "raw", text(fn.parse_invoice_date(F.col("raw"))).alias("day")
    )


@query
def f10_xml_decimal(spark, sf):
    return _money_texts(spark, sf).select(
        "l_orderkey", "l_linenumber", text(fn.xml_decimal(F.col("raw"), "decimal(28,6)")).alias("amount")
    )


@query
def f11_xml_text(spark, sf):
    """Blank-cleaned prose."""
    cleaned = fn.xml_text(F.col("text"))
    return led.read_table(spark, sf, "documents").select(
        "doc_id", F.length(cleaned).alias("chars"), F.md5(cleaned).alias("digest")
    )


@query
def f12_table_rate(spark, sf):
    return cells(spark, sf).select(
        "doc_id", "row", "col", fn.plain_rate(fn.table_rate(F.col("text"))).alias("rate")
    )


@query
def f13_bbox_union(spark, sf):
    return table_lines(spark, sf).select(
        "doc_id", "row", near("bbox.x0").alias("x0"), near("bbox.y0").alias("y0"),
        near("bbox.x1").alias("x1"), near("bbox.y1").alias("y1"),
    )


@query
def f14_legal_name(spark, sf):
    inv = invoices(spark, sf)
    shown = F.array(
        F.col("supplier_name"),
        F.concat("customer_name", F.lit(" y Cia")),
        F.concat(F.lit("  Grupo; "), "supplier_name", F.lit(" - Ltd.x")),
    )
    return inv.select("doc_id", F.posexplode(shown).alias("n", "raw")).select(
        "doc_id", "n", fn.normalize_legal_name(F.col("raw")).alias("name")
    )


@query
def f15_warning_messages(spark, sf):
    inv = invoices(spark, sf)
    w = validate.validate_totals(led.ledger_lines(inv), led.ledger_totals(inv))
    return w.select("doc_id", "rank", validate.warning_message(F.col("code")).alias("message"))


# ---- candidates -------------------------------------------------------------
def _hit(spark, sf, column):
    return findings(spark, sf).filter(F.col(column).isNotNull()).select(
        "doc_id", F.col(f"{column}.page").alias("page"), F.col(f"{column}.value").alias("value"),
        F.col(f"{column}.confidence").alias("confidence"),
    )


@query
def c1_invoice_number(spark, sf):
    return _hit(spark, sf, "number")


@query
def c2_issue_date(spark, sf):
    return _hit(spark, sf, "issue_date")


@query
def c3_supplier_tax_id(spark, sf):
    return _hit(spark, sf, "supplier_tax_id")


@query
def c4_customer_tax_id(spark, sf):
    return _hit(spark, sf, "customer_tax_id")


@query
def c5_sections(spark, sf):
    """Section each name line stands in."""
    facts = cand.findings_in_order(blocks(spark, sf))
    return facts.filter((F.col("fact") == "name") & F.col("section").isNotNull()).select(
        "doc_id", "page", "block_seq", "section"
    )


@query
def c6_legal_names(spark, sf):
    return (
        cand.candidates(findings(spark, sf))
        .filter(F.col("field_name").isin("supplier.legal_name", "customer.legal_name"))
        .select("doc_id", "field_name", "value", "confidence", "page")
    )


def _lines(spark, sf):
    return findings(spark, sf).select("doc_id", F.inline("rates"))


@query
def c7_tax_rates(spark, sf):
    return _lines(spark, sf).select(
        "doc_id", "page", fn.plain_rate(F.col("rate")).alias("rate"), "amount"
    )


@query
def c8_rate_bases(spark, sf):
    return _lines(spark, sf).select("doc_id", fn.plain_rate(F.col("rate")).alias("rate"), "base")


@query
def c9_tax_line_candidates(spark, sf):
    return (
        cand.candidates(findings(spark, sf))
        .filter(F.startswith("field_name", F.lit("tax_lines[")))
        .select("doc_id", "field_name", "value", "confidence", "page")
    )


@query
def c10_net_amount(spark, sf):
    return _hit(spark, sf, "net")


@query
def c11_tax_amount(spark, sf):
    return _hit(spark, sf, "tax")


@query
def c12_gross_amount(spark, sf):
    return _hit(spark, sf, "gross")


@query
def c13_stop_at_gross(spark, sf):
    f = findings(spark, sf)
    return f.select(
        "doc_id", F.col("gross").isNotNull().alias("has_gross"), F.col("net").isNotNull().alias("has_net"),
        F.col("tax").isNotNull().alias("has_tax"),
    )


@query
def c14_all_candidates(spark, sf):
    return cand.candidates(findings(spark, sf)).select(
        "doc_id", "field_name", "value", "confidence", "page"
    )


@query
def c15_best_candidates(spark, sf):
    return cand.best_candidates(cand.candidates(findings(spark, sf))).select(
        "doc_id", "field_name", "value", "confidence", "page"
    )


# ---- fiscal tables ----------------------------------------------------------
@query
def t1_tax_table_score(spark, sf):
    grids = ren.table_grids(invoices(spark, sf)).select(
        F.lit("grid").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    docs = led.read_table(spark, sf, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    pages = led.read_table(spark, sf, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return grids.unionByName(docs).unionByName(pages).select(
        "origin", "id", tt.looks_like_tax_table(F.col("text")).alias("is_table")
    )


@query
def t2_row_offsets(spark, sf):
    """Two tables per page: every invoice's table and its neighbour's below it."""
    one = tt.table_sizes(cells(spark, sf))
    two = one.withColumns(
        {"table_seq": F.lit(1), "kind": F.when(F.col("doc_id") % 3 == 0, "line_items").otherwise("unknown")}
    )
    three = one.withColumn("table_seq", F.lit(2))
    return tt.row_offsets(one.unionByName(two).unionByName(three)).select(
        "doc_id", "table_seq", "table_rows", "row_offset"
    )


@query
def t3_grid_cells(spark, sf):
    g = invoices(spark, sf).select(
        "doc_id",
        F.lit(1).alias("page"),
        F.transform(
            "lines",
            lambda x: F.array(
                F.concat(x["rate"].cast("string"), F.lit(" %")),
                F.lit(" "),
                ren.grouped_amount(x["base"]),
                ren.plain_amount(x["amount"]),
            ),
        ).alias("rows"),
    )
    return tt.tax_line_candidates(tt.cells_from_grid(g)).select(
        "doc_id", "row", fn.plain_rate(F.col("tax_rate")).alias("rate"), text("tax_base").alias("base"),
        text("tax_amount").alias("amount"), near("confidence").alias("confidence"), "source",
    )


@query
def t4_header_rows(spark, sf):
    """Header test over all lines of the tables and of the prose."""
    grids = ren.table_grids(invoices(spark, sf)).select("doc_id", "text")
    rows = grids.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return rows.select(
        "doc_id", "row",
        tt.is_header_text(F.regexp_replace("line", r"[\t|]+", " ")).alias("is_header"),
    )


@query
def t5_table_tax_lines(spark, sf):
    return table_lines(spark, sf).select(
        "doc_id", "row", fn.plain_rate(F.col("tax_rate")).alias("rate"), text("tax_base").alias("base"),
        text("tax_amount").alias("amount"), text("withholding_amount").alias("withheld"),
    )


@query
def t6_row_confidence(spark, sf):
    return table_lines(spark, sf).select("doc_id", "row", near("confidence").alias("confidence"))


@query
def t7_row_source(spark, sf):
    return table_lines(spark, sf).select("doc_id", "row", "source")


@query
def t8_table_totals(spark, sf):
    return tt.table_totals(table_lines(spark, sf)).select(
        "doc_id", "n_lines", text("net_amount").alias("net_amount"), text("tax_amount").alias("tax_amount"),
        near("confidence").alias("confidence"),
    )


@query
def t9_table_warnings(spark, sf):
    """Invoices without a tax table, or with one that tells nothing: defects of the scans."""
    inv = invoices(spark, sf)
    c = tt.cells_from_blocks(ren.damaged_grids(ren.table_grids(inv)))
    return tt.table_warnings(inv, c, tt.tax_line_candidates(c))


# ---- XML --------------------------------------------------------------------
@query
def x1_parsed_attachments(spark, sf):
    return xml_records.parse_attachments(ren.attachments(invoices(spark, sf))).select("doc_id", "att_seq", "format")


@query
def x2_xml_number_date(spark, sf):
    return xml_first(spark, sf).select("doc_id", "invoice_number", "issue_date")


@query
def x3_xml_parties(spark, sf):
    return xml_first(spark, sf).select(
        "doc_id", "supplier_name", "supplier_tax_id", "customer_name", "customer_tax_id"
    )


@query
def x4_xml_tax_lines(spark, sf):
    return xml_first(spark, sf).select("doc_id", F.posexplode("tax_lines").alias("line_no", "t")).select(
        "doc_id", "line_no", fn.plain_rate(F.col("t.tax_rate")).alias("rate"),
        text(F.col("t.tax_base").cast("decimal(28,2)")).alias("base"),
        text(F.col("t.tax_amount").cast("decimal(28,2)")).alias("amount"),
    )


@query
def x5_xml_totals(spark, sf):
    return xml_first(spark, sf).select(
        "doc_id",
        *[text(F.col(c).cast("decimal(28,2)")).alias(c) for c in ("net_amount", "tax_amount", "gross_amount")],
        text("advance_amount").alias("advance_amount"),
    )


@query
def x6_xml_gate(spark, sf):
    """Attachments with and without the minimum content."""
    a = ren.attachments(invoices(spark, sf))
    told = xml_records.parse_attachments(a).select("doc_id", "att_seq", F.lit(True).alias("told"))
    return a.join(told, ["doc_id", "att_seq"], "left").select(
        "doc_id", "att_seq", F.coalesce("told", F.lit(False)).alias("has_record")
    )


@query
def x7_first_record(spark, sf):
    return xml_first(spark, sf).select("doc_id", "att_seq", "invoice_number")


def _xml_responses(spark, sf):
    t = corpus_tables(spark, sf)
    k = prepare.classify(*[t[name] for name in corpus.TABLES])
    return xml_plan.xml_branch(k.filter(F.col("kind") == "embedded_xml"), t["attachments"])


@query
def x8_xml_records(spark, sf):
    return flat(_xml_responses(spark, sf), "kind", "route")


@query
def x9_xml_confidence(spark, sf):
    return _xml_responses(spark, sf).select("doc_id", F.explode("fields").alias("field_name", "confidence"))


@query
def x10_xml_evidence(spark, sf):
    return (
        _xml_responses(spark, sf)
        .select("doc_id", F.explode("evidence").alias("field_name", "e"))
        .select("doc_id", "field_name", "e.text", "e.page", "e.source")
    )


# ---- model proposals --------------------------------------------------------
@query
def m1_recovered_json(spark, sf):
    return recovered(spark, sf).select(
        "doc_id", F.get_json_object("json", "$.invoice_data.number").alias("number"), "error"
    )


@query
def m2_proposed_fields(spark, sf):
    return proposals.proposed_fields(recovered(spark, sf)).select(
        "doc_id", "field_name", "value", "confidence"
    )


def _codes_and_details(work: DataFrame) -> DataFrame:
    """Reasons as text; the rounded score in one of the details is left out."""
    shown = F.regexp_replace(F.array_join(F.transform("reasons", lambda r: r["detail"]), "|"), "global [0-9.]+ <", "global <")
    return work.select("doc_id", F.array_join("codes", "|").alias("codes"), shown.alias("details"))


def _scan_quality(tables, documents):
    return proposals.ocr_quality(documents, tables["ocr_lines"])


@query
def m3_model_work_list(spark, sf):
    """Reasons told by finished responses and by the quality of OCR."""
    t = corpus_tables(spark, sf)
    routed = corpus.routed_documents(t)
    r = corpus.extract_invoices(t, routed=routed)
    return _codes_and_details(proposals.model_work_list(r, _scan_quality(t, routed)))


@query
def m3_resolution_work_list(spark, sf):
    """Reasons told by a resolution of competing sources."""
    t = corpus_tables(spark, sf)
    c, documents = written(_competing(spark, sf), "candidates"), corpus.routed_documents(t)
    signals = proposals.resolution_signals(
        resolve.resolve_documents(c, fv.RECORD_FIELDS), documents, c, _scan_quality(t, documents)
    )
    return _codes_and_details(proposals.work_list(signals))


@query
def m4_proposal_candidates(spark, sf):
    return proposal_candidates(spark, sf).select(
        "doc_id", "field_name", "value", near("confidence").alias("confidence"), "page", "source"
    )


@query
def m5_best_proposals(spark, sf):
    return proposals.best_proposals(proposal_candidates(spark, sf)).select(
        "doc_id", "field_name", "value", near("confidence").alias("confidence")
    )


@query
def m6_proposal_records(spark, sf):
    return flat(proposal_plan.proposal_records(proposal_candidates(spark, sf))).drop("needs_review")


def _merged(spark, sf):
    r = corpus.extract_invoices(corpus_tables(spark, sf))
    return proposal_plan.merge_proposals(
        r, recovered(spark, sf), proposal_plan.proposal_records(proposal_candidates(spark, sf))
    )


@query
def m7_merged_records(spark, sf):
    return flat(_merged(spark, sf), "route", "model_used").drop("needs_review")


@query
def m8_response_signals(spark, sf):
    r = corpus.extract_invoices(corpus_tables(spark, sf))
    return proposals.response_signals(r).select(
        "doc_id", F.array_join("missing", "|").alias("missing"), "is_scanned", "tax_unresolved",
        F.array_join(F.array_sort("low_fields"), "|").alias("low_fields"),
    )


# ---- resolution -------------------------------------------------------------
def _competing(spark, sf):
    """Candidates of all five sources: PDF text, OCR, XML, fiscal tables and models.

    Hybrids hold digital text and OCR, XML invoices text and a record, all of them tables, a third model answers.
    """
    t = corpus_tables(spark, sf)
    texts = t["blocks"].unionByName(prepare.ocr_blocks(t["ocr_lines"]))
    return producers.competing(
        producers.text_candidates(prepare.non_blank(texts)),
        producers.xml_candidates(xml_plan.xml_records(xml_first(spark, sf))),
        producers.table_candidates(table_lines(spark, sf)),
        proposal_candidates(spark, sf),
    )


@query
def r1_source_priority(spark, sf):
    return (
        _competing(spark, sf)
        .select("source", resolve.source_priority(F.col("source")).alias("priority"))
        .groupBy("source", "priority")
        .agg(F.count(F.lit(1)).alias("candidates"))
    )


@query
def r2_resolved_fields(spark, sf):
    return resolve.resolve_fields(_competing(spark, sf)).select(
        "doc_id", "field_name", "value", near("confidence").alias("confidence"), "source"
    )


@query
def r3_resolved_required(spark, sf):
    return resolve.resolve_fields(_competing(spark, sf), fv.REQUIRED_FIELDS).select(
        "doc_id", "field_name", "value", "source"
    )


@query
def r4_adjusted_tax_ids(spark, sf):
    r = resolve.resolve_fields(_competing(spark, sf), ("supplier.tax_id", "customer.tax_id"))
    return resolve.adjust_tax_ids(r).select(
        "doc_id", "field_name", near("confidence").alias("confidence"), "warning"
    )


def _resolved(spark, sf):
    return resolve.resolve_documents(_competing(spark, sf), fv.RECORD_FIELDS)


@query
def r5_field_confidence(spark, sf):
    return _resolved(spark, sf).select("doc_id", F.explode("fields").alias("field_name", "c")).select(
        "doc_id", "field_name", near("c").alias("confidence")
    )


@query
def r6_global_confidence(spark, sf):
    return _resolved(spark, sf).select("doc_id", near("global_score").alias("global_score"))


@query
def r7_needs_review(spark, sf):
    return _resolved(spark, sf).select("doc_id", F.array_join("needs_review", "|").alias("needs_review"))


@query
def r8_evidence(spark, sf):
    return (
        _resolved(spark, sf)
        .select("doc_id", F.explode("evidence").alias("field_name", "e"))
        .select("doc_id", "field_name", "e.text", "e.page", "e.source")
    )


@query
def r9_resolved_documents(spark, sf):
    return _resolved(spark, sf).select(
        "doc_id",
        F.size("values").alias("n_fields"),
        near("global_score").alias("global_score"),
        F.array_join("needs_review", "|").alias("needs_review"),
        F.array_join("warnings", "|").alias("warnings"),
    )


# ---- records ----------------------------------------------------------------
def _branch(spark, sf, name):
    t = corpus_tables(spark, sf)
    k = prepare.classify(*[t[name] for name in corpus.TABLES])
    docs = k.filter(prepare.route(F.col("kind")) == name)
    if name == "digital":
        return corpus.text_branch(docs, t["blocks"], "digital")
    return corpus.ocr_branch(docs, t["ocr_lines"])


@query
def a1_digital_records(spark, sf):
    return flat(_branch(spark, sf, "digital"), "kind", "route")


@query
def a2_ocr_records(spark, sf):
    return flat(_branch(spark, sf, "ocr"), "kind", "route")


@query
def a3_paired_tax_lines(spark, sf):
    r = _branch(spark, sf, "digital").filter(F.col("status") == "ok")
    return r.select("doc_id", F.posexplode("invoice.tax_lines").alias("line_no", "t")).select(
        "doc_id", "line_no", fn.plain_rate(F.col("t.tax_rate")).alias("rate"),
        text("t.tax_base").alias("base"), text("t.tax_amount").alias("amount"),
    )


def _all_responses(spark, sf):
    return corpus.extract_invoices(corpus_tables(spark, sf))


@query
def a4_tax_lines_confidence(spark, sf):
    r = _all_responses(spark, sf).filter(F.col("route") != "xml")
    return r.select("doc_id", "route", F.try_element_at("fields", F.lit("tax_lines")).alias("confidence"))


@query
def a5_totals_confidence(spark, sf):
    r = _all_responses(spark, sf).filter(F.col("route") != "xml")
    return r.select("doc_id", near(F.try_element_at("fields", F.lit("totals"))).alias("confidence"))


@query
def a6_mandatory_gate(spark, sf):
    return _all_responses(spark, sf).select(
        "doc_id", "route", "status",
        F.array_contains("warnings", F.lit(fv.MSG_INCOMPLETE)).alias("incomplete"),
        F.col("invoice.supplier.legal_name").alias("supplier_name"),
        F.col("invoice.customer.legal_name").alias("customer_name"),
    )


@query
def a7_global_scores(spark, sf):
    return _all_responses(spark, sf).select(
        "doc_id", near("global_score").alias("global_score"),
        F.array_join("needs_review", "|").alias("needs_review"),
    )


@query
def a8_evidence(spark, sf):
    return (
        _branch(spark, sf, "digital")
        .select("doc_id", F.explode("evidence").alias("field_name", "e"))
        .select("doc_id", "field_name", "e.text", "e.page", "e.source")
    )


@query
def a9_corpus_records(spark, sf):
    return flat(_all_responses(spark, sf), "kind", "route")


# ---- fiscal checks ----------------------------------------------------------
def _warnings(spark, sf):
    inv = invoices(spark, sf)
    return validate.validate_totals(led.ledger_lines(inv), led.ledger_totals(inv))


@query
def v1_net_mismatch(spark, sf):
    """Stated net against the sum of bases; in every sixth invoice the first base was misread."""
    inv = invoices(spark, sf)
    w = validate.validate_totals(led.misread_lines(led.ledger_lines(inv)), led.ledger_totals(inv))
    return w.filter(F.col("code") == "net_amount_mismatch").select("doc_id", "code", "field")


@query
def v2_tax_mismatch(spark, sf):
    return _warnings(spark, sf).filter(F.col("code") == "tax_amount_mismatch").select("doc_id", "code", "field")


@query
def v3_line_mismatch(spark, sf):
    return validate.line_warnings(led.ledger_lines(invoices(spark, sf))).select("doc_id", "code", "field")


@query
def v4_gross_mismatch(spark, sf):
    """Gross with advances on every fourth invoice and withholding on every fifth."""
    inv = invoices(spark, sf)
    totals = led.ledger_totals(inv).withColumns(
        {
            "advance_amount": F.when(F.col("doc_id") % 4 == 0, F.lit("1.00").cast("decimal(18,2)")),
            "withholding_amount": F.when(F.col("doc_id") % 5 == 0, F.lit("2.00").cast("decimal(18,2)")),
        }
    )
    w = validate.validate_totals(led.ledger_lines(inv), totals)
    return w.filter(F.col("code") == "gross_amount_mismatch").select("doc_id", "code", "field")


@query
def v5_all_warnings(spark, sf):
    return _warnings(spark, sf).select("doc_id", "rank", "code", "field", "message")


# ---- evaluation -------------------------------------------------------------
@query
def e1_paired_records(spark, sf):
    """Ground truth beside predictions read from files; a broken file is no prediction."""
    p = ev.pair_records(ren.expected_records(invoices(spark, sf)), _prediction_files(spark, sf))
    return p.select(
        "invoice_file", "invoice_type", F.col("predicted").isNotNull().alias("has_prediction"), F.col("broken").isNotNull().alias("broken")
    )


@query
def e2_nested_values(spark, sf):
    p = pairs(spark, sf)
    return p.select(
        "invoice_file",
        ev.nested(p, "expected", "customer.tax_id").alias("expected_id"),
        ev.nested(p, "predicted", "customer.tax_id").alias("predicted_id"),
        ev.nested(p, "expected", "customer.address.city").alias("absent"),
        ev.nested(p, "predicted", "invoice_data.number.part").alias("below_text"),
    )


def _field(spark, sf, *paths):
    return field_results(spark, sf).filter(F.col("field_path").isin(*paths)).select(
        "invoice_file", "field_path", "match", near("score").alias("score")
    )


@query
def e3_exact_fields(spark, sf):
    return _field(spark, sf, "invoice_data.number", "invoice_data.issue_date", "supplier.tax_id", "customer.tax_id")


@query
def e4_amounts(spark, sf):
    e, p = "expected.totals.gross_amount", "predicted.totals.gross_amount"
    found = pairs(spark, sf).select("invoice_file", ev.amount_match(F.col(e), F.col(p)).alias("v"))
    return found.select("invoice_file", "v.match", near("v.score").alias("score"))


@query
def e5_legal_names(spark, sf):
    return _field(spark, sf, "supplier.legal_name", "customer.legal_name")


@query
def e5_name_similarity(spark, sf):
    """Similarity of the seller's and the buyer's name of each invoice."""
    inv = invoices(spark, sf)
    ratio = ev.name_ratio(F.col("supplier_name"), F.col("customer_name"))
    return inv.select("doc_id", near(ratio).alias("ratio"))


@query
def e6_tax_lines(spark, sf):
    return _field(spark, sf, "tax_lines")


@query
def e7_totals(spark, sf):
    return _field(spark, sf, "totals")


@query
def e8_field_results(spark, sf):
    """All eight fields, and one without an evaluator of its own."""
    p = pairs(spark, sf)
    extra = ev.evaluate_fields(p, ("totals.advance_amount",))
    return ev.evaluate_fields(p).unionByName(extra).select(
        "invoice_file", "invoice_type", "field_path", "match", near("score").alias("score"), "metric", "detail"
    )


@query
def e8_any_shape(spark, sf):
    """Records as JSON of any shape: fields without an evaluator are compared by the types of their values."""
    return ev.evaluate_fields(ren.loose_records(invoices(spark, sf)), ren.LOOSE_PATHS).select(
        "invoice_file", "field_path", "match", near("score").alias("score"), "metric", "detail"
    )


def _level(spark, sf, name):
    return ev.roll_ups(field_results(spark, sf)).filter(F.col("level") == name)


@query
def e9_invoice_scores(spark, sf):
    return _level(spark, sf, "invoice").select(
        F.col("key").alias("invoice_file"), near("score").alias("score"), "errors"
    )


@query
def e10_type_errors(spark, sf):
    return _level(spark, sf, "type").select(F.col("key").alias("invoice_type"), "fields", "errors")


@query
def e11_field_accuracy(spark, sf):
    return _level(spark, sf, "field").select(
        F.col("key").alias("field_path"), near("accuracy").alias("accuracy")
    )


@query
def e12_global_accuracy(spark, sf):
    return _level(spark, sf, "all").select(near("score").alias("global_accuracy"), "fields")


@query
def e13_error_listing(spark, sf):
    results = field_results(spark, sf)
    gate = ev.passes(results).select(
        F.lit("gate").alias("row"), F.lit(None).cast("string").alias("invoice_file"),
        F.lit(None).cast("string").alias("field_path"), F.col("errors"),
        F.lit(None).cast("int").alias("rank"),
    )
    listed = ev.error_listing(results).select(
        F.lit("error").alias("row"), "invoice_file", "field_path", F.lit(1).cast("bigint").alias("errors"), "rank"
    )
    return listed.unionByName(gate)


@query
def e_extraction_scores(spark, sf):
    """The corpus extracted and scored against the ledger it was printed from."""
    inv = invoices(spark, sf)
    predicted = ev.response_as_text(_all_responses(spark, sf))
    results = ev.evaluate_fields(ev.pair_records(ren.expected_records(inv), predicted))
    return ev.roll_ups(results).filter(F.col("level") != "invoice").select(
        "level", "key", "fields", "errors", near("score").alias("score"), near("accuracy").alias("accuracy")
    )


# ---- run metrics ------------------------------------------------------------
def _stages(spark, sf):
    return led.read_table(spark, sf, "events").select(
        text("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_ms")
    )


@query
def o1_stage_times(spark, sf):
    """Events read as stage times."""
    return metrics.stage_roll_up(_stages(spark, sf), exact=True)


@query
def o1_run_totals(spark, sf):
    return metrics.run_totals(_stages(spark, sf))


@query
def o2_run_summary(spark, sf):
    return metrics.run_summary(_all_responses(spark, sf)).select(
        "route", "kind", "status", "documents", "warnings", "errors", "to_review", "resolved_fields",
        near("mean_score").alias("mean_score"),
    )


@query
def o2_observed_run(spark, sf):
    """A run that writes its responses: what its stages counted while they ran."""
    stages = metrics.StageTimes("run")
    tables = corpus_tables(spark, sf)
    path = shared_folder(spark, "responses")
    responses = corpus.extract_invoices(tables, stages=stages)
    stages.run("responses", responses, lambda df: landed.write_responses(df, path), metrics.response_counts())
    return stages.table(spark).select("stage", F.explode("metadata").alias("metric", "value")).select(
        "stage", "metric", F.col("value").cast("bigint").alias("value")
    )
