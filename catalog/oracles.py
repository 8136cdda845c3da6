"""The SQL each registered query is checked against."""

import re

from invoiceloom import fixed_values as fv

from . import prelude as p
from .prelude import with_tables

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_tables(sql)


_T = fv.MSG_TOTALS
BLANK_RUN = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# ---- sources ----------------------------------------------------------------
oracle(
    "s1_page_blocks",
    f"""SELECT doc_id, count(*) AS blocks, CAST(sum(length(t)) AS BIGINT) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
WHERE {p.strip('t')} <> '' GROUP BY doc_id""",
)
oracle("s2_page_text", "SELECT doc_id, page, md5(text) AS digest FROM ptext")
oracle("s3_image_counts", "SELECT doc_id, count(*) AS images FROM pimages GROUP BY doc_id")
_FORMAT = "CASE WHEN shape = 5 THEN 'ubl' WHEN shape = 1 AND att_seq = 0 THEN 'unknown' ELSE 'facturae' END"
oracle(
    "s4_xml_attachments",
    f"SELECT doc_id, att_seq, filename, {_FORMAT} AS format FROM attached WHERE lower(trim(filename)) LIKE '%.xml'",
)
oracle(
    "s5_ocr_blocks",
    """SELECT doc_id, page, block_seq, text, 10.0 AS x0, y0, 200.0 AS x1, y0 + 20 AS y1, 0.92 AS confidence
FROM rendered WHERE made_as IN ('scanned', 'hybrid')""",
)
oracle(
    "s6_table_cells",
    """SELECT doc_id, "row", col, text, round(10.0 + col * 190.0 / n_parts, 6) AS x0, round(400.0 + "row" * 20.0 / n_lines, 6) AS y0,
round(10.0 + (col + 1) * 190.0 / n_parts, 6) AS x1, round(400.0 + ("row" + 1) * 20.0 / n_lines, 6) AS y1, confidence FROM cells""",
)
oracle("s7_model_responses", "SELECT doc_id, 1 AS page, writing = 1 AS fenced FROM asked")
oracle(
    "s8_expected_records",
    """SELECT invoice_file, invoice_type, number, CAST(issue_date AS VARCHAR) AS issue_date, CAST(NULL AS VARCHAR) AS due_date,
supplier_tax_id AS supplier_id, supplier_name, customer_tax_id AS customer_id, customer_name, lines_text,
CAST(net AS VARCHAR) AS net_amount, CAST(tax AS VARCHAR) AS tax_amount, CAST(gross AS VARCHAR) AS gross_amount, CAST(NULL AS VARCHAR) AS withholding_amount
FROM truth JOIN (SELECT doc_id, string_agg(rate || ':' || base || ':' || amount, ';' ORDER BY line_no) AS lines_text FROM lines GROUP BY doc_id) USING (doc_id)""",
)
oracle(
    "s9_prediction_keys",
    """SELECT 'doc_' || doc_id AS invoice_key, doc_id % 11 = 3 AS broken, CASE WHEN doc_id % 11 = 3 THEN NULL WHEN doc_id % 5 = 1 THEN 'X' ELSE number END AS number,
CASE WHEN doc_id % 11 <> 3 THEN CAST(CAST(gross + CASE WHEN doc_id % 6 = 2 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS VARCHAR) END AS gross_amount
FROM ledger WHERE doc_id % 7 <> 1""",
)
_LEVEL = "SELECT '{0}' AS level, {1} AS key, count(*) AS fields, count(*) FILTER (WHERE NOT matched) AS errors, round(avg(score), 6) AS score FROM field_scores"
oracle(
    "s11_report_levels",
    " UNION ALL ".join(
        [_LEVEL.format(n, c) + f" GROUP BY {c}" for n, c in (("invoice", "invoice_file"), ("type", "invoice_type"), ("field", "field_path"))]
        + [_LEVEL.format(n, "NULL") for n in ("all", "results")]
    ),
)
# ---- preparation ------------------------------------------------------------
_XML = "contains({t}, '<?xml') OR contains(lower({t}), '<facturae') OR contains(lower({t}), '<ubl') OR contains(lower({t}), '<cii')"
oracle(
    "d1_xml_flag",
    f"""SELECT 'page' AS origin, page_id AS id, {_XML.format(t='html')} AS has_xml, length({p.strip('html')}) AS text_length FROM pages
UNION ALL SELECT 'document', doc_id, {_XML.format(t='text')}, length({p.strip('text')}) FROM documents""",
)
oracle("d2_classify", "SELECT doc_id, has_xml, CAST(text_length AS BIGINT) AS text_length, images, kind FROM kinds")
oracle("d3_xml_format", f"SELECT doc_id, att_seq, {_FORMAT} AS format FROM attached")
oracle(
    "d4_routes",
    """SELECT doc_id, CASE kind WHEN 'embedded_xml' THEN 'xml' WHEN 'digital' THEN 'digital' ELSE 'ocr' END AS route,
CASE kind WHEN 'embedded_xml' THEN 'xml' ELSE 'ocr' END AS forced_route FROM kinds""",
)
oracle(
    "d5_rejections",
    f"""SELECT doc_id, 'unsupported_pdf_kind' AS code, '{fv.MSG_KIND_DIGITAL[0]}' || kind || '{fv.MSG_KIND_DIGITAL[1]}' AS message, 'file' AS field, 'digital' AS branch
FROM kinds WHERE kind NOT IN ('digital', 'hybrid')
UNION ALL SELECT doc_id, 'unsupported_pdf_kind', '{fv.MSG_KIND_OCR[0]}' || kind || '{fv.MSG_KIND_OCR[1]}', 'file', 'ocr' FROM kinds WHERE kind NOT IN ('scanned', 'hybrid')
UNION ALL SELECT doc_id, 'ocr_no_text', '{fv.MSG_OCR_NO_TEXT}', 'file', 'ocr' FROM kinds
  WHERE kind IN ('scanned', 'hybrid') AND doc_id NOT IN (SELECT doc_id FROM rendered WHERE made_as IN ('scanned', 'hybrid'))
UNION ALL SELECT doc_id, 'no_xml_found', '{fv.MSG_NO_XML}', 'file', 'xml' FROM kinds
  WHERE kind = 'embedded_xml' AND doc_id NOT IN (SELECT doc_id FROM attached WHERE lower(trim(filename)) LIKE '%.xml')""",
)
oracle(
    "d6_reading_order",
    "SELECT doc_id, page, block_seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, block_seq) AS position FROM rendered",
)
oracle("d7_all_blocks", "SELECT doc_id, page, block_seq, text, 'digital_text' AS source, 1.0 AS confidence FROM rendered")
oracle(
    "d8_full_text",
    """SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (
SELECT doc_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page) AS t FROM (
SELECT doc_id, page, string_agg(text, chr(10) ORDER BY y0, block_seq) AS page_text FROM rendered GROUP BY doc_id, page) GROUP BY doc_id)""",
)

# ---- scalars ----------------------------------------------------------------
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_MONEY_TEXTS = f"""SELECT l_orderkey, l_linenumber, CASE l_partkey % 8
WHEN 0 THEN {p.grouped(_PRICE)} || ' €'
WHEN 1 THEN format('{{:,.2f}}', CAST({_PRICE} AS DOUBLE))
WHEN 2 THEN {p.plain(_PRICE)}
WHEN 3 THEN ' EUR' || {_PRICE}
WHEN 4 THEN l_orderkey || '.' || l_suppkey
WHEN 5 THEN 'no es dinero ' || {_PRICE}
WHEN 6 THEN '1,2,3' || l_linenumber
ELSE l_linenumber || '.005' END AS raw FROM lineitem"""
oracle(
    "f1_money",
    f"SELECT l_orderkey, l_linenumber, raw, CAST({p.money('raw')} AS VARCHAR) AS amount FROM ({_MONEY_TEXTS})",
)
oracle("f2_table_money", 'SELECT doc_id, "row", col, CAST(money AS VARCHAR) AS amount FROM cell_read')
oracle(
    "f3_withholding_amount",
    f"""SELECT doc_id, "row", col, CAST(CASE WHEN {p.matches('text', fv.WITHHOLDING_GROUPED)} THEN {p.money(p.extract('text', fv.WITHHOLDING_GROUPED, 1))}
ELSE {p.money(p.extract('text', fv.WITHHOLDING_PLAIN, 1))} END AS VARCHAR) AS amount FROM cells""",
)
_IDS = """SELECT doc_id, unnest(range(6)) AS n, unnest([supplier_tax_id, customer_tax_id,
left(supplier_tax_id, 1) || '-' || substr(supplier_tax_id, 2, 7) || '-' || right(supplier_tax_id, 1),
lower(left(customer_tax_id, 8) || ' ' || right(customer_tax_id, 1)), left(customer_tax_id, 8) || 'A', number]) AS raw FROM ledger"""
_NORMAL = f"SELECT doc_id, n, raw, {p.normalized_id('raw')} AS tax_id FROM ({_IDS})"
oracle("f4_normalized_tax_id", f"SELECT doc_id, n, tax_id FROM ({_NORMAL})")
for _name, _check in (
    ("f5_nif_valid", p.valid_nif),
    ("f6_nie_valid", p.valid_nie),
    ("f7_cif_valid", p.valid_cif),
    ("f8_tax_id_valid", p.valid_id),
):
    oracle(_name, f"SELECT doc_id, n, raw, {_check('tax_id')} AS valid FROM ({_NORMAL})")
oracle(
    "f9_invoice_date",
    f"""SELECT o_orderkey, raw, CAST({p.parse_date('raw')} AS VARCHAR) AS day FROM (SELECT o_orderkey, CASE o_custkey % 6
WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d/%m/%Y') WHEN 2 THEN day(d) || '-' || month(d) || '-' || year(d)
WHEN 3 THEN ' ' || strftime(d, '%d.%m.%Y') WHEN 4 THEN '31/' || strftime(d, '%m/%Y') ELSE strftime(d, '%m/%Y') END AS raw
FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders))""",
)
_XMLNUM = f"replace({p.strip('raw')}, ',', '.')"
oracle(
    "f10_xml_decimal",
    f"""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN regexp_matches({_XMLNUM}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')
THEN TRY_CAST({_XMLNUM} AS DECIMAL(28,6)) END AS VARCHAR) AS amount FROM ({_MONEY_TEXTS})""",
)
_CLEAN = f"nullif({p.strip(f'''regexp_replace(text, '{BLANK_RUN}', ' ', 'g')''')}, '')"
oracle("f11_xml_text", f"SELECT doc_id, length({_CLEAN}) AS chars, md5({_CLEAN}) AS digest FROM documents")
oracle("f12_table_rate", 'SELECT doc_id, "row", col, CAST(rate AS VARCHAR) AS rate FROM cell_read')
oracle(
    "f13_bbox_union",
    """SELECT t.doc_id, t."row", round(min(10.0 + col * 190.0 / n_parts), 6) AS x0, round(min(400.0 + c."row" * 20.0 / n_lines), 6) AS y0,
round(max(10.0 + (col + 1) * 190.0 / n_parts), 6) AS x1, round(max(400.0 + (c."row" + 1) * 20.0 / n_lines), 6) AS y1
FROM table_lines t JOIN cells c ON c.doc_id = t.doc_id AND c."row" = t."row" GROUP BY t.doc_id, t."row" """,
)
oracle(
    "f14_legal_name",
    f"""SELECT doc_id, n, {p.normalized_name('raw')} AS name FROM (SELECT doc_id, unnest(range(3)) AS n,
unnest([supplier_name, customer_name || ' y Cia', '  Grupo; ' || supplier_name || ' - Ltd.x']) AS raw FROM ledger)""",
)

# ---- fiscal checks ----------------------------------------------------------
_CHECKS = """SELECT l.doc_id, 1 AS rank, 'net_amount_mismatch' AS code, 'totals.net_amount' AS field FROM ledger l JOIN (SELECT doc_id, sum(base) AS s FROM lines GROUP BY doc_id) x USING (doc_id) WHERE abs(s - net) > 0.01
UNION ALL SELECT l.doc_id, 2, 'tax_amount_mismatch', 'totals.tax_amount' FROM ledger l JOIN (SELECT doc_id, sum(amount) AS s FROM lines GROUP BY doc_id) x USING (doc_id) WHERE abs(s - tax) > 0.01
UNION ALL SELECT doc_id, 3, 'tax_line_mismatch', 'tax_lines[' || line_no || '].tax_amount' FROM lines WHERE abs(base * rate * CAST(0.01 AS DECIMAL(3,2)) - amount) > 0.01
UNION ALL SELECT doc_id, 4, 'gross_amount_mismatch', 'totals.gross_amount' FROM ledger WHERE abs(net + tax - gross) > 0.01"""
_MESSAGE = "CASE code " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in _T.items()) + " END"
oracle("v5_all_warnings", f"SELECT doc_id, rank, code, field, {_MESSAGE} AS message FROM ({_CHECKS})")
oracle("f15_warning_messages", f"SELECT doc_id, rank, {_MESSAGE} AS message FROM ({_CHECKS})")
oracle(
    "v1_net_mismatch",
    """SELECT doc_id, 'net_amount_mismatch' AS code, 'totals.net_amount' AS field FROM ledger LEFT JOIN (
SELECT doc_id, sum(CASE WHEN doc_id % 6 = 0 AND line_no = 0 THEN 0 ELSE base END) AS s FROM lines GROUP BY doc_id) x USING (doc_id)
WHERE abs(coalesce(s, 0) - net) > 0.01""",
)
oracle("v2_tax_mismatch", f"SELECT doc_id, code, field FROM ({_CHECKS}) WHERE rank = 2")
oracle("v3_line_mismatch", f"SELECT doc_id, code, field FROM ({_CHECKS}) WHERE rank = 3")
oracle(
    "v4_gross_mismatch",
    """SELECT doc_id, 'gross_amount_mismatch' AS code, 'totals.gross_amount' AS field FROM ledger
WHERE abs(net + tax - CASE WHEN doc_id % 4 = 0 THEN 1.00 ELSE 0.00 END - CASE WHEN doc_id % 5 = 0 THEN 2.00 ELSE 0.00 END - gross) > 0.01""",
)

# ---- candidates -------------------------------------------------------------
oracle("c1_invoice_number", "SELECT doc_id, page, value, 0.85 AS confidence FROM f_number")
oracle("c2_issue_date", "SELECT doc_id, page, value, 0.85 AS confidence FROM f_date")
oracle("c3_supplier_tax_id", "SELECT doc_id, page, value, confidence FROM f_supplier_id")
oracle("c4_customer_tax_id", "SELECT doc_id, page, value, confidence FROM f_customer_id")
oracle(
    "c5_sections",
    f"""SELECT doc_id, page, block_seq, section FROM f_sections
WHERE NOT seller AND NOT buyer AND section IS NOT NULL AND length(line) BETWEEN 5 AND 80
  AND ({p.matches('text', fv.COMPANY_FORM)} OR ({p.matches('line', fv.NAME_START)} AND NOT {p.matches('line', fv.NOT_A_NAME)}))""",
)
oracle("c6_legal_names", "SELECT doc_id, section || '.legal_name' AS field_name, value, confidence, page FROM f_names")
oracle("c7_tax_rates", f"SELECT doc_id, page, {p.plain_rate('rate')} AS rate, CAST(amount AS VARCHAR) AS amount FROM f_rates")
oracle("c8_rate_bases", f"SELECT doc_id, {p.plain_rate('rate')} AS rate, CAST(base AS VARCHAR) AS base FROM f_lines")
_CANDS = "SELECT doc_id, field_name, value, confidence, page FROM"
oracle("c9_tax_line_candidates", f"{_CANDS} cands WHERE field_name LIKE 'tax_lines[%'")
oracle("c10_net_amount", "SELECT doc_id, page, CAST(value AS VARCHAR) AS value, 0.85 AS confidence FROM f_net")
oracle("c11_tax_amount", "SELECT doc_id, page, CAST(value AS VARCHAR) AS value, 0.80 AS confidence FROM f_tax")
oracle("c12_gross_amount", "SELECT doc_id, page, CAST(value AS VARCHAR) AS value, 0.90 AS confidence FROM f_gross")
oracle(
    "c13_stop_at_gross",
    """SELECT d.doc_id, g.doc_id IS NOT NULL AS has_gross, n.doc_id IS NOT NULL AS has_net, t.doc_id IS NOT NULL AS has_tax
FROM (SELECT DISTINCT doc_id FROM rendered) d LEFT JOIN f_gross g USING (doc_id) LEFT JOIN f_net n USING (doc_id) LEFT JOIN f_tax t USING (doc_id)""",
)
oracle("c14_all_candidates", f"{_CANDS} cands")
oracle("c15_best_candidates", f"{_CANDS} best_cands")

# ---- fiscal tables ----------------------------------------------------------
_SCORE = p.count_words("lower(text)", fv.TABLE_SIGNS)
oracle(
    "t1_tax_table_score",
    f"""SELECT origin, id, {_SCORE} >= 2 AS is_table FROM (SELECT 'grid' AS origin, doc_id AS id, text FROM grids
UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)""",
)
oracle(
    "t2_row_offsets",
    """SELECT doc_id, table_seq, table_rows, CAST(coalesce(sum(table_rows + 1) OVER (PARTITION BY doc_id ORDER BY table_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset
FROM (SELECT doc_id, unnest([0, 1, 2]) AS table_seq, table_rows FROM (SELECT doc_id, max("row") + 1 AS table_rows FROM cells GROUP BY doc_id))
WHERE table_seq <> 1 OR doc_id % 3 <> 0""",
)
oracle(
    "t3_grid_cells",
    """SELECT doc_id, line_no AS "row", CAST(rate AS VARCHAR) AS rate, CAST(base AS VARCHAR) AS base, CAST(amount AS VARCHAR) AS amount,
round(CASE WHEN abs(base * rate - amount * 100) <= 50 THEN (0.8 + 0.8 + 0.9) / 3 ELSE 0.7 END, 6) AS confidence, 'synthetic' AS source FROM lines""",
)
oracle(
    "t4_header_rows",
    f"""SELECT doc_id, "row", {p.count_words("lower(regexp_replace(line, '[\\t|]+', ' ', 'g'))", fv.HEADER_WORDS)} >= 2 AS is_header FROM grid_lines""",
)
oracle(
    "t5_table_tax_lines",
    """SELECT doc_id, "row", CAST(rate AS VARCHAR) AS rate, CAST(base AS VARCHAR) AS base, CAST(amount AS VARCHAR) AS amount,
CAST(withheld AS VARCHAR) AS withheld FROM table_lines""",
)
oracle("t6_row_confidence", 'SELECT doc_id, "row", round(confidence, 6) AS confidence FROM table_lines')
oracle("t7_row_source", 'SELECT doc_id, "row", source FROM table_lines')
oracle(
    "t8_table_totals",
    """SELECT doc_id, count(*) AS n_lines, CAST(CAST(sum(coalesce(base, 0)) AS DECIMAL(28,2)) AS VARCHAR) AS net_amount,
CAST(CAST(sum(coalesce(amount, 0)) AS DECIMAL(28,2)) AS VARCHAR) AS tax_amount, round(avg(confidence), 6) AS confidence FROM table_lines GROUP BY doc_id""",
)
_DAMAGED = p.count_words("lower(replace(text, '%', ' '))", fv.TABLE_SIGNS)
oracle(
    "t9_table_warnings",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR {_DAMAGED} < 2 THEN '{fv.MSG_NO_TABLES}' ELSE '{fv.MSG_NO_TABLE_LINES}' END AS message
FROM grids WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
)

# ---- XML --------------------------------------------------------------------
_READABLE = "shape NOT IN (4, 5, 6)"
_SEQ = "CASE WHEN shape = 1 THEN 1 ELSE 0 END"
oracle("x1_parsed_attachments", f"SELECT doc_id, {_SEQ} AS att_seq, 'facturae' AS format FROM xml_docs WHERE {_READABLE}")
oracle("x2_xml_number_date", f"SELECT doc_id, number AS invoice_number, CAST(issue_date AS VARCHAR) AS issue_date FROM xml_docs WHERE {_READABLE}")
oracle("x3_xml_parties", f"SELECT doc_id, supplier_name, supplier_tax_id, customer_name, customer_tax_id FROM xml_docs WHERE {_READABLE}")
oracle(
    "x4_xml_tax_lines",
    """SELECT doc_id, line_no, CAST(rate AS VARCHAR) AS rate, CAST(base AS VARCHAR) AS base, CAST(amount AS VARCHAR) AS amount
FROM xml_lines JOIN (SELECT doc_id, shape FROM xml_docs) USING (doc_id) WHERE shape NOT IN (4, 5, 6)""",
)
oracle(
    "x5_xml_totals",
    f"""SELECT doc_id, CAST(net AS VARCHAR) AS net_amount, CAST(tax AS VARCHAR) AS tax_amount, CAST(gross AS VARCHAR) AS gross_amount,
CAST(NULL AS VARCHAR) AS advance_amount FROM xml_docs WHERE {_READABLE}""",
)
oracle("x6_xml_gate", "SELECT doc_id, att_seq, shape NOT IN (4, 5, 6) AND NOT (shape = 1 AND att_seq = 0) AS has_record FROM attached")
oracle("x7_first_record", f"SELECT doc_id, {_SEQ} AS att_seq, number AS invoice_number FROM xml_docs WHERE {_READABLE}")
_FLAT = (
    "status, number, issue_date, supplier_id, supplier_name, customer_id, customer_name, lines_text, "
    "net_amount, tax_amount, gross_amount, global_score"
)
oracle("x8_xml_records", f"SELECT doc_id, kind, route, {_FLAT}, needs_review, warnings, errors FROM rec_xml")
_NINE = ", ".join(f"'{f}'" for f in fv.RECORD_FIELDS)
oracle(
    "x9_xml_confidence",
    f"""SELECT doc_id, field_name, 0.95 AS confidence FROM (SELECT doc_id, unnest([{_NINE}]) AS field_name FROM xml_docs WHERE {_READABLE}
UNION ALL SELECT doc_id, 'tax_lines[' || rate || ']' FROM xml_lines JOIN (SELECT doc_id, shape FROM xml_docs) USING (doc_id) WHERE {_READABLE}
UNION ALL SELECT DISTINCT doc_id, 'tax_lines' FROM xml_lines JOIN (SELECT doc_id, shape FROM xml_docs) USING (doc_id) WHERE {_READABLE})""",
)
_PARTS = "FROM xml_lines JOIN (SELECT doc_id, shape FROM xml_docs) USING (doc_id) WHERE shape NOT IN (4, 5, 6)"
_XML_EVIDENCE = f"""SELECT doc_id, field_name, text FROM (
SELECT doc_id, unnest([{_NINE}]) AS field_name, unnest([number, CAST(issue_date AS VARCHAR), supplier_tax_id, supplier_name, customer_tax_id,
       customer_name, CAST(net AS VARCHAR), CAST(tax AS VARCHAR), CAST(gross AS VARCHAR)]) AS text FROM xml_docs WHERE {_READABLE}
UNION ALL SELECT doc_id, 'tax_lines[' || rate || '.00].tax_rate', rate || '.00' {_PARTS}
UNION ALL SELECT doc_id, 'tax_lines[' || rate || '.00].tax_base', CAST(base AS VARCHAR) {_PARTS}
UNION ALL SELECT doc_id, 'tax_lines[' || rate || '.00].tax_amount', CAST(amount AS VARCHAR) {_PARTS})"""
oracle("x10_xml_evidence", f"SELECT doc_id, field_name, text, 1 AS page, 'xml' AS source FROM ({_XML_EVIDENCE})")

# ---- model proposals --------------------------------------------------------
oracle(
    "m1_recovered_json",
    "SELECT doc_id, CASE WHEN writing <> 4 THEN number END AS number, CASE WHEN writing = 4 THEN 'no_json' END AS error FROM asked",
)
oracle("m2_proposed_fields", "SELECT doc_id, field_name, value, confidence FROM proposed")
_REQ = fv.REQUIRED_FIELDS
_LOW_OCR = "(r.kind IN ('scanned', 'hybrid') AND r.doc_id % 37 = 10)"
_LOW_CASES = """CASE WHEN w.number IS NULL AND w.route = 'ocr' THEN 'invoice_data.number' END,
  CASE WHEN (w.date_text IS NOT NULL AND w.issue_date IS NULL) OR (w.date_text IS NULL AND w.route = 'ocr') THEN 'invoice_data.issue_date' END,
  CASE WHEN (w.supplier_id IS NOT NULL AND NOT w.supplier_ok) OR (w.supplier_id IS NULL AND w.route = 'ocr') THEN 'supplier.tax_id' END,
  CASE WHEN (w.customer_id IS NOT NULL AND NOT w.customer_ok) OR (w.customer_id IS NULL AND w.route = 'ocr') THEN 'customer.tax_id' END"""
p.CTES["signals"] = f"""
SELECT r.*, r.status = 'error' OR r.lines_text = '' AS tax_unresolved, r.kind IN ('scanned', 'hybrid') AS is_scanned,
       concat_ws(', ', {", ".join(f"CASE WHEN contains(r.errors, 'missing_field:{f}') THEN '{f}' END" for f in _REQ)}) AS missing_required,
       CASE WHEN w.doc_id IS NULL THEN '' ELSE concat_ws(', ', {_LOW_CASES}) END AS low_key,
       {_LOW_OCR} AS low_ocr,
       CASE WHEN w.doc_id IS NULL THEN [] ELSE list_filter([CASE WHEN w.supplier_name_c IS NULL THEN 'supplier.legal_name' END,
         CASE WHEN w.customer_name_c IS NULL THEN 'customer.legal_name' END, CASE WHEN w.n_lines = 0 THEN 'tax_lines' END,
         CASE WHEN (CASE WHEN net IS NULL THEN 0 ELSE 0.85 END + CASE WHEN tax IS NULL THEN 0 ELSE 0.80 END + CASE WHEN gross IS NULL THEN 0 ELSE 0.90 END) / 3 < 0.6 THEN 'totals' END,
         {_LOW_CASES}], lambda x: x IS NOT NULL) END AS low_all
FROM records r LEFT JOIN rec_wide w USING (doc_id)"""


def _reasons(missing: str, low: str) -> str:
    """Codes and details of a work list; ``missing`` and ``low`` are lists of required fields as text."""
    cases = (
        (f"{missing} <> ''", "'missing_field'", f"'{fv.MSG_MODEL_MISSING_FIELD}' || {missing}"),
        ("global_score < 0.6", "'low_confidence'", "'Confianza global < 0.6'"),
        (f"{low} <> ''", "'low_confidence_field'", f"'{fv.MSG_MODEL_LOW_FIELD}' || {low}"),
        ("is_scanned AND tax_unresolved", "'complex_scanned'", f"'{fv.MSG_MODEL_COMPLEX_SCANNED}'"),
        ("tax_unresolved", "'tax_table_unresolved'", f"'{fv.MSG_MODEL_TABLE}'"),
        ("low_ocr", "'low_ocr_quality'", f"'{fv.MSG_MODEL_LOW_OCR}'"),
    )
    told = [", ".join(f"CASE WHEN {c[0]} THEN {c[i]} END" for c in cases) for i in (1, 2)]
    return f"concat_ws('|', {told[0]}) AS codes, concat_ws('|', {told[1]}) AS details"


p.CTES["reasons"] = f"SELECT *, {_reasons('missing_required', 'low_key')} FROM signals"
oracle("m3_model_work_list", "SELECT doc_id, codes, details FROM reasons WHERE codes <> ''")
oracle(
    "m4_proposal_candidates",
    "SELECT doc_id, field_name, value, round(confidence * 0.7, 6) AS confidence, 1 AS page, 'vlm' AS source FROM proposed",
)
oracle("m5_best_proposals", "SELECT doc_id, field_name, value, round(confidence * 0.7, 6) AS confidence FROM proposed")
oracle("m6_proposal_records", f"SELECT doc_id, {_FLAT}, warnings, errors FROM rec_model")
_EITHER = ", ".join(
    f"CASE WHEN m.doc_id IS NOT NULL AND r.codes <> '' THEN m.{c} ELSE r.{c} END AS {c}" for c in _FLAT.split(", ")
)
oracle(
    "m7_merged_records",
    f"""SELECT r.doc_id, r.route, coalesce(m.doc_id IS NOT NULL AND r.codes <> '', false) AS model_used, {_EITHER},
concat_ws('|', nullif(r.warnings, ''), CASE WHEN r.codes <> '' THEN nullif(m.warnings, '') END,
          CASE WHEN r.codes <> '' AND a.writing = 4 THEN '{fv.MSG_MODEL_NOTHING}' END) AS warnings,
concat_ws('|', nullif(r.errors, ''), CASE WHEN r.codes <> '' THEN nullif(m.errors, '') END) AS errors
FROM reasons r LEFT JOIN rec_model m USING (doc_id) LEFT JOIN asked a USING (doc_id)""",
)
oracle(
    "m8_response_signals",
    """SELECT doc_id, regexp_replace(errors, '[a-z_]+:', '', 'g') AS missing, is_scanned, tax_unresolved,
array_to_string(list_sort(low_all), '|') AS low_fields FROM signals""",
)

# ---- resolution -------------------------------------------------------------
_CHAIN = (
    "feat", "f_number", "f_date", "f_supplier_id", "f_customer_id", "f_sections", "f_names", "f_bases", "f_pairs", "f_rates", "f_lines",
    "f_gross", "f_net_any", "f_tax_any", "f_net", "f_tax", "cands",
)
# the same findings for each source of a document: its id doubled, plus 1 for OCR
p.CTES["rendered_s"] = """
SELECT 2 * doc_id + s AS doc_id, made_as, page, block_seq, y0, text, ord FROM rendered,
  (SELECT unnest([0, 1]) AS s) WHERE CASE s WHEN 1 THEN made_as IN ('scanned', 'hybrid')
  ELSE made_as IN ('digital', 'embedded_xml') OR (made_as = 'hybrid' AND starts_with(text, 'FACTURA ')) END"""
for _name in _CHAIN:
    p.CTES[f"{_name}_s"] = re.sub(rf"\b(rendered|{'|'.join(_CHAIN)})\b", r"\1_s", p.CTES[_name])
p.CTES["competing"] = f"""
SELECT doc_id // 2 AS doc_id, field_name, value, CAST(confidence AS DOUBLE) AS confidence, page, seq,
       CASE WHEN doc_id % 2 = 0 THEN 'digital_text' ELSE 'ocr' END AS source, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS priority FROM cands_s
UNION ALL SELECT doc_id, field_name, text, 0.95, 1, 0, 'xml', 1 FROM ({"{xml_evidence}"})
UNION ALL SELECT doc_id, 'tax_lines[' || rate || '.0].' || part, value, confidence, 1, "row", 'layout', 4 FROM (
  SELECT doc_id, "row", rate, confidence, unnest(['tax_rate', 'tax_base', 'tax_amount']) AS part,
         unnest([rate || '.0', CAST(base AS VARCHAR), CAST(amount AS VARCHAR)]) AS value FROM table_lines) WHERE value IS NOT NULL
UNION ALL SELECT doc_id, 'totals.net_amount', CAST(CAST(sum(base) AS DECIMAL(28,2)) AS VARCHAR), avg(confidence), 1, 1000, 'layout', 4
  FROM table_lines GROUP BY doc_id HAVING sum(base) IS NOT NULL
UNION ALL SELECT doc_id, 'totals.tax_amount', CAST(CAST(sum(amount) AS DECIMAL(28,2)) AS VARCHAR), avg(confidence), 1, 1001, 'layout', 4
  FROM table_lines GROUP BY doc_id HAVING sum(amount) IS NOT NULL
UNION ALL SELECT doc_id, field_name, value, confidence * 0.7, 1, 0, 'vlm', 5 FROM proposed""".replace("{xml_evidence}", _XML_EVIDENCE)
p.CTES["winners"] = """
SELECT DISTINCT ON (doc_id, field_name) * FROM competing WHERE trim(value) <> '' ORDER BY doc_id, field_name, priority, confidence DESC, seq"""
_RANKS = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fv.RECORD_FIELDS))
p.CTES["adjusted"] = f"""
SELECT *, CASE field_name {_RANKS} END AS position,
       CASE WHEN bad THEN confidence * 0.5 ELSE CAST(confidence AS DOUBLE) END AS final, CASE WHEN bad THEN '{fv.MSG_INVALID_ID}' || value END AS warning
FROM (SELECT *, field_name LIKE '%tax_id' AND NOT {p.valid_id('value')} AS bad FROM winners WHERE field_name IN ({_NINE}))"""
oracle("r1_source_priority", "SELECT source, priority, count(*) AS candidates FROM competing GROUP BY source, priority")
oracle("r2_resolved_fields", "SELECT doc_id, field_name, value, round(confidence, 6) AS confidence, source FROM winners")
_REQUIRED = ", ".join(f"'{f}'" for f in fv.REQUIRED_FIELDS)
oracle("r3_resolved_required", f"SELECT doc_id, field_name, value, source FROM winners WHERE field_name IN ({_REQUIRED})")
oracle(
    "r4_adjusted_tax_ids",
    "SELECT doc_id, field_name, round(final, 6) AS confidence, warning FROM adjusted WHERE field_name LIKE '%tax_id'",
)
oracle("r5_field_confidence", "SELECT doc_id, field_name, round(final, 6) AS confidence FROM adjusted")
oracle("r6_global_confidence", "SELECT doc_id, round(avg(final), 6) AS global_score FROM adjusted GROUP BY doc_id")
_REVIEW = "coalesce(string_agg(CASE WHEN final < 0.7 THEN field_name END, '|' ORDER BY position), '')"
oracle("r7_needs_review", f"SELECT doc_id, {_REVIEW} AS needs_review FROM adjusted GROUP BY doc_id")
oracle("r8_evidence", "SELECT doc_id, field_name, value AS text, page, source FROM adjusted")
oracle(
    "r9_resolved_documents",
    f"""SELECT doc_id, count(*) AS n_fields, round(avg(final), 6) AS global_score, {_REVIEW} AS needs_review,
coalesce(string_agg(warning, '|' ORDER BY position), '') AS warnings FROM adjusted GROUP BY doc_id""",
)

_BY_POSITION = [f for f in fv.RECORD_FIELDS if f in fv.REQUIRED_FIELDS]
_NEEDED = ", ".join(f"CASE WHEN count(*) FILTER (WHERE field_name = '{f}') = 0 THEN '{f}' END" for f in fv.REQUIRED_FIELDS)
_LOW_KEYS = ", ".join(f"CASE WHEN count(*) FILTER (WHERE field_name = '{f}' AND final < 0.7) > 0 THEN '{f}' END" for f in _BY_POSITION)
p.CTES["resolved"] = f"""
SELECT k.doc_id, k.kind, coalesce(avg(final), 0) AS global_score, concat_ws(', ', {_NEEDED}) AS missing_required, concat_ws(', ', {_LOW_KEYS}) AS low_key,
       k.kind IN ('scanned', 'hybrid') AS is_scanned, k.doc_id NOT IN (SELECT doc_id FROM competing WHERE field_name LIKE 'tax_lines[%') AS tax_unresolved,
       k.kind IN ('scanned', 'hybrid') AND k.doc_id % 37 = 10 AS low_ocr
FROM kinds k LEFT JOIN adjusted a USING (doc_id) GROUP BY k.doc_id, k.kind"""
oracle(
    "m3_resolution_work_list",
    f"SELECT doc_id, codes, details FROM (SELECT *, {_reasons('missing_required', 'low_key')} FROM resolved) WHERE codes <> ''",
)

# ---- records ----------------------------------------------------------------
_ALL = f"SELECT doc_id, kind, route, {_FLAT}, needs_review, warnings, errors FROM"
oracle("a1_digital_records", f"{_ALL} rec_digital")
oracle("a2_ocr_records", f"{_ALL} rec_ocr")
oracle("a9_corpus_records", f"{_ALL} records")
oracle("s10_response_json", f"{_ALL} records")
oracle(
    "a3_paired_tax_lines",
    """SELECT l.doc_id, l.i AS line_no, l.rate_text AS rate, CAST(l.base AS VARCHAR) AS base, CAST(l.amount AS VARCHAR) AS amount
FROM rec_lines l JOIN rec_digital r USING (doc_id) WHERE r.status = 'ok'""",
)
oracle(
    "a4_tax_lines_confidence",
    f"""SELECT doc_id, route, CASE WHEN n_lines = 0 THEN 0 WHEN route = 'ocr' THEN {fv.CONF_TAX_LINES_OCR} ELSE {fv.CONF_TAX_LINES_DIGITAL} END AS confidence FROM rec_wide
UNION ALL SELECT doc_id, 'ocr', NULL FROM kinds WHERE kind <> 'embedded_xml' AND doc_id % 37 = 10""",
)
oracle(
    "a5_totals_confidence",
    """SELECT doc_id, round((CASE WHEN net IS NULL THEN 0 ELSE 0.85 END + CASE WHEN tax IS NULL THEN 0 ELSE 0.80 END + CASE WHEN gross IS NULL THEN 0 ELSE 0.90 END) / 3, 6) AS confidence FROM rec_wide
UNION ALL SELECT doc_id, NULL FROM kinds WHERE kind <> 'embedded_xml' AND doc_id % 37 = 10""",
)
oracle(
    "a6_mandatory_gate",
    f"SELECT doc_id, route, status, warnings LIKE '%{fv.MSG_INCOMPLETE}%' AS incomplete, supplier_name, customer_name FROM records",
)
oracle("a7_global_scores", "SELECT doc_id, global_score, needs_review FROM records")
oracle(
    "a8_evidence",
    f"""SELECT b.doc_id, field_name, value AS text, page, 'digital_text' AS source FROM best_cands b
JOIN (SELECT doc_id FROM rec_digital) USING (doc_id)""",
)

# ---- evaluation -------------------------------------------------------------
oracle(
    "e1_paired_records",
    "SELECT invoice_file, invoice_type, doc_id % 7 <> 1 AND doc_id % 11 <> 3 AS has_prediction, doc_id % 7 <> 1 AND doc_id % 11 = 3 AS broken FROM truth",
)
oracle(
    "e2_nested_values",
    "SELECT invoice_file, customer_tax_id AS expected_id, CASE WHEN doc_id % 7 <> 1 AND doc_id % 14 <> 9 THEN customer_tax_id END AS predicted_id, "
    "CAST(NULL AS VARCHAR) AS absent, CAST(NULL AS VARCHAR) AS below_text FROM truth",
)


def _scores(*paths: str) -> str:
    listed = ", ".join(f"'{f}'" for f in paths)
    return f"SELECT invoice_file, field_path, matched AS match, round(score, 6) AS score FROM field_scores WHERE field_path IN ({listed})"


oracle("e3_exact_fields", _scores("invoice_data.number", "invoice_data.issue_date", "supplier.tax_id", "customer.tax_id"))
oracle(
    "e4_amounts",
    """SELECT invoice_file, doc_id % 7 <> 1 AND doc_id % 6 <> 2 AS match, round(CASE WHEN doc_id % 7 = 1 THEN 0
WHEN doc_id % 6 = 2 THEN greatest(0.0, 1 - 5.0 / CAST(gross AS DOUBLE)) ELSE 1 END, 6) AS score FROM truth""",
)
oracle("e5_legal_names", _scores("supplier.legal_name", "customer.legal_name"))
oracle("e6_tax_lines", _scores("tax_lines"))
oracle("e7_totals", _scores("totals"))
_GOT = "CASE WHEN has_prediction AND {0} THEN {1} ELSE '' END"
_WHY = " ".join(
    f"WHEN '{path}' THEN 'expected ''' || {true} || ''', got ''' || {_GOT.format(*got)} || ''''"
    for path, true, *got in (
        ("invoice_data.number", "number", "true", "CASE WHEN doc_id % 5 = 1 THEN 'X' ELSE number END"),
        ("invoice_data.issue_date", "CAST(issue_date AS VARCHAR)", "doc_id % 8 <> 3", "CAST(issue_date AS VARCHAR)"),
        ("supplier.tax_id", "supplier_tax_id", "true", "supplier_tax_id"),
        ("customer.tax_id", "customer_tax_id", "doc_id % 14 <> 9", "customer_tax_id"),
    )
)
oracle(
    "e8_field_results",
    f"""SELECT f.invoice_file, f.invoice_type, field_path, matched AS match, round(score, 6) AS score, field_path AS metric,
CASE WHEN matched THEN '' ELSE CASE field_path {_WHY}
  WHEN 'tax_lines' THEN CASE WHEN NOT has_prediction OR doc_id % 12 = 7 THEN 'line count mismatch: expected ' || n_lines || ', got 0'
                             ELSE 'avg_score=' || format('{{:.2f}}%', score * 100) END
  WHEN 'totals' THEN '' ELSE 'similarity ' || format('{{:.2f}}%', score * 100) END END AS detail
FROM field_scores f JOIN truth t USING (invoice_file) JOIN (SELECT doc_id, doc_id % 7 <> 1 AS has_prediction FROM ledger) p USING (doc_id)
JOIN (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id) n USING (doc_id)
UNION ALL SELECT invoice_file, invoice_type, 'totals.advance_amount', true, 1.0, 'exact', 'both null' FROM truth""",
)
_SHORT = "regexp_replace({0}, '\\.?0+$', '')"
oracle(
    "e8_any_shape",
    f"""SELECT invoice_file, 'net' AS field_path, doc_id % 4 IN (0, 2) AS match,
  round(CASE doc_id % 4 WHEN 1 THEN greatest(0.0, 1 - 1.0 / CAST(net AS DOUBLE)) WHEN 3 THEN 0 ELSE 1 END, 6) AS score, 'tolerance' AS metric,
  CASE doc_id % 4 WHEN 1 THEN 'expected ' || {_SHORT.format('n')} || ', got ' || {_SHORT.format('m')} || ', diff '
    || CASE length(regexp_extract({_SHORT.format('n')}, '\\.([0-9]+)$', 1)) WHEN 0 THEN '1' WHEN 1 THEN '1.0' ELSE '1.00' END
  WHEN 3 THEN 'decimal parse error' ELSE '' END AS detail
FROM (SELECT *, CAST(net AS VARCHAR) AS n, CAST(CAST(net + 1 AS DECIMAL(18,2)) AS VARCHAR) AS m FROM truth)
UNION ALL SELECT invoice_file, 'note', doc_id % 3 = 0, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 3 = 2 THEN 'tolerance' ELSE 'exact' END,
  CASE doc_id % 3 WHEN 1 THEN 'expected ''' || number || ''', got ''other''' WHEN 2 THEN 'decimal parse error' ELSE '' END FROM truth
UNION ALL SELECT invoice_file, 'lines', doc_id % 5 <> 2, CASE WHEN doc_id % 5 <> 2 THEN 1 ELSE 0 END, 'structural',
  CASE WHEN doc_id % 5 = 2 THEN 'mismatch: <class ''list''> vs <class ''list''>' ELSE '' END FROM truth
UNION ALL SELECT invoice_file, 'nothing', true, 1, 'exact', 'both null' FROM truth
UNION ALL SELECT invoice_file, 'deep.place', doc_id % 7 <> 3, CASE WHEN doc_id % 7 <> 3 THEN 1 ELSE 0 END, CASE WHEN doc_id % 7 = 3 THEN 'structural' ELSE 'exact' END,
  CASE WHEN doc_id % 7 = 3 THEN 'mismatch: <class ''str''> vs <class ''NoneType''>' ELSE '' END FROM truth""",
)
oracle(
    "e9_invoice_scores",
    "SELECT invoice_file, round(avg(score), 6) AS score, count(*) FILTER (WHERE NOT matched) AS errors FROM field_scores GROUP BY invoice_file",
)
oracle(
    "e10_type_errors",
    "SELECT invoice_type, count(*) AS fields, count(*) FILTER (WHERE NOT matched) AS errors FROM field_scores GROUP BY invoice_type",
)
oracle(
    "e11_field_accuracy",
    "SELECT field_path, round(avg(CASE WHEN matched THEN 1 ELSE 0 END), 6) AS accuracy FROM field_scores GROUP BY field_path",
)
oracle("e12_global_accuracy", "SELECT round(avg(score), 6) AS global_accuracy, count(*) AS fields FROM field_scores")
oracle(
    "e13_error_listing",
    """SELECT 'error' AS "row", invoice_file, field_path, 1 AS errors,
row_number() OVER (PARTITION BY invoice_file ORDER BY score, field_path) AS rank FROM field_scores WHERE NOT matched
UNION ALL SELECT 'gate', NULL, NULL, count(*) FILTER (WHERE NOT matched), NULL FROM field_scores""",
)

# ---- run metrics ------------------------------------------------------------
oracle(
    "o1_stage_times",
    """SELECT event_type AS stage, count(*) AS runs, round(avg(value), 2) AS mean_ms,
round(quantile_cont(value, 0.5), 2) AS median_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms, round(sum(value), 2) AS total_ms FROM events GROUP BY event_type""",
)
oracle(
    "o1_run_totals",
    "SELECT CAST(user_id AS VARCHAR) AS run_id, round(sum(value), 2) AS total_ms, count(*) AS stages FROM events GROUP BY user_id",
)
_COUNT = "CAST(sum(CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, '|')) END) AS BIGINT)"
_SEEN = ("number", "issue_date", "supplier_id", "supplier_name", "customer_id", "customer_name", "net", "tax", "gross", "coalesce(net, tax, gross)")
p.CTES["resolved_counts"] = f"""
SELECT r.doc_id, CASE WHEN r.route = 'xml' AND r.status = 'ok' THEN 9 WHEN w.doc_id IS NULL THEN 0 ELSE w.n END AS resolved
FROM records r LEFT JOIN (SELECT doc_id, {" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _SEEN)} AS n FROM rec_wide) w USING (doc_id)"""
oracle(
    "o2_run_summary",
    f"""SELECT route, kind, status, count(*) AS documents, {_COUNT.format('warnings')} AS warnings, {_COUNT.format('errors')} AS errors,
{_COUNT.format('needs_review')} AS to_review, CAST(sum(resolved) AS BIGINT) AS resolved_fields, round(avg(global_score), 6) AS mean_score
FROM records JOIN resolved_counts USING (doc_id) GROUP BY route, kind, status""",
)
oracle(
    "o2_observed_run",
    f"""SELECT 'candidates' AS stage, unnest(['documents', 'candidates']) AS metric, unnest([count(DISTINCT doc_id), count(*)]) AS value
FROM cands JOIN (SELECT doc_id FROM kinds WHERE kind <> 'embedded_xml') USING (doc_id)
UNION ALL SELECT 'responses', unnest(['documents', 'ok', 'warnings', 'errors', 'to_review', 'resolved_fields']),
  unnest([count(*), count(*) FILTER (WHERE status = 'ok'), {_COUNT.format('warnings')}, {_COUNT.format('errors')}, {_COUNT.format('needs_review')}, CAST(sum(resolved) AS BIGINT)])
FROM records JOIN resolved_counts USING (doc_id)""",
)
