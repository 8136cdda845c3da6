"""SQL building blocks for the checks: the derived tables as common table expressions.

Each entry of ``CTES`` is one expression; ``with_tables`` puts those a check needs,
and the ones they need, in front of it.
"""

import re

from invoiceloom import fixed_values as fv


def pattern(java: str) -> str:
    """The same pattern for a regular-expression engine without Unicode classes."""
    return java.replace("(?iU)", "(?i)").replace("(?U)", "")


def matches(text: str, java: str) -> str:
    return f"regexp_matches({text}, '{pattern(java)}')"


def extract(text: str, java: str, group: int = 0) -> str:
    return f"regexp_extract({text}, '{pattern(java)}', {group})"


def extract_all(text: str, java: str, group: int) -> str:
    return f"regexp_extract_all({text}, '{pattern(java)}', {group})"


def strip(x: str) -> str:
    return f"trim({x}, '{fv.BLANKS}')"


def money(x: str) -> str:
    bare = strip(f"replace(replace(replace(replace({strip(x)}, '€', ''), 'EUR', ''), 'eur', ''), ' ', '')")
    numeral = (
        f"CASE WHEN regexp_matches({bare}, ',[^.]*$') THEN replace(replace({bare}, '.', ''), ',', '.') "
        f"ELSE replace({bare}, ',', '') END"
    )
    return (
        f"CASE WHEN regexp_matches({numeral}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') "
        f"THEN TRY_CAST({numeral} AS DECIMAL(28,2)) END"
    )


def first_money(amounts: str) -> str:
    return f"([{money('z')} FOR z IN {amounts} IF {money('z')} IS NOT NULL])[1]"


def grouped(x: str) -> str:
    return f"translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,')"


def plain(x: str) -> str:
    return f"replace(CAST({x} AS VARCHAR), '.', ',')"


def control_digit(digits: str) -> str:
    terms = []
    for place in range(1, 8):
        d = f"TRY_CAST(substr({digits}, {place}, 1) AS INT)"
        terms.append(f"((2 * {d}) // 10 + (2 * {d}) % 10)" if place % 2 else d)
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def normalized_id(x: str) -> str:
    return f"upper(regexp_replace({x}, '[\\s\\-.]', '', 'g'))"


def valid_nif(x: str) -> str:
    return (
        f"(regexp_matches({x}, '^[0-9]{{8}}[A-Z]$') AND right({x}, 1) = "
        f"substr('{fv.NIF_LETTERS}', CAST(TRY_CAST(left({x}, 8) AS BIGINT) % 23 AS INT) + 1, 1))"
    )


def valid_nie(x: str) -> str:
    return (
        f"(regexp_matches({x}, '^[XYZ][0-9]{{7}}[A-Z]$') AND right({x}, 1) = substr('{fv.NIF_LETTERS}', "
        f"CAST(TRY_CAST(translate(left({x}, 8), 'XYZ', '012') AS BIGINT) % 23 AS INT) + 1, 1))"
    )


def valid_cif(x: str) -> str:
    digit = control_digit(f"substr({x}, 2, 7)")
    letter = f"substr('{fv.CIF_LETTERS}', {digit} + 1, 1)"
    end = f"right({x}, 1)"
    return (
        f"(regexp_matches({x}, '^[ABCDEFGHJKLMNPQRSUVW][0-9]{{7}}[0-9A-J]$') AND CASE "
        f"WHEN contains('{fv.CIF_TYPES_LETTER_ONLY}', left({x}, 1)) THEN {end} = {letter} "
        f"WHEN contains('{fv.CIF_TYPES_DIGIT_ONLY}', left({x}, 1)) THEN {end} = CAST({digit} AS VARCHAR) "
        f"ELSE {end} = {letter} OR {end} = CAST({digit} AS VARCHAR) END)"
    )


def valid_id(x: str) -> str:
    return f"coalesce({valid_nif(x)} OR {valid_nie(x)} OR {valid_cif(x)}, false)"


def count_words(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in words) + ")"


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def parse_date(x: str) -> str:
    t = strip(x)
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') "
        f"THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
        f"WHEN regexp_matches({t}, '^[0-9]{{1,2}}(/[0-9]{{1,2}}/|-[0-9]{{1,2}}-|\\.[0-9]{{1,2}}\\.)[0-9]{{4}}$') "
        f"THEN CAST(try_strptime(translate({t}, '/.', '--'), '%d-%m-%Y') AS DATE) END"
    )


def plain_rate(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.?0+$', '')"


def pointed_rate(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '(\\.[0-9]+?)0+$', '\\1')"


def normalized_name(x: str) -> str:
    suffixes = pattern(fv.NAME_SUFFIXES).replace("(?i)", "")
    return (
        f"upper({strip(f'''regexp_replace(regexp_replace({x}, '{suffixes}', '', 'gi'), '{pattern(fv.NAME_SEPARATORS)}', ' ', 'g')''')})"
    )


CTES: dict[str, str] = {}

CTES["per_order"] = """
SELECT doc_id, min(first_line) AS first_line,
       sum(CASE WHEN rate = 21 THEN amount END) AS base21,
       sum(CASE WHEN rate = 10 THEN amount END) AS base10,
       sum(CASE WHEN rate = 4 THEN amount END) AS base4
FROM (SELECT l_orderkey AS doc_id,
             CAST(l_linenumber AS BIGINT) * 1099511627776 + l_suppkey AS first_line,
             CASE CAST(round(l_tax * 100) AS INT) % 3 WHEN 0 THEN 21 WHEN 1 THEN 10 ELSE 4 END AS rate,
             CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                  AS DECIMAL(18,2)) AS amount
      FROM lineitem)
GROUP BY doc_id"""

CTES["dated"] = """
SELECT p.*, p.first_line % 1099511627776 AS suppkey, o.o_custkey AS custkey,
       CAST(o.o_orderdate AS DATE) AS day, c.c_mktsegment, s.s_nationkey
FROM per_order p
JOIN orders o ON o.o_orderkey = p.doc_id
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN supplier s ON s.s_suppkey = p.first_line % 1099511627776"""

CTES["true_lines"] = """
SELECT doc_id, rate, base,
       CAST(base * rate * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS true_amount,
       row_number() OVER (PARTITION BY doc_id ORDER BY rate DESC) - 1 AS line_no
FROM (SELECT doc_id, 21 AS rate, CAST(base21 AS DECIMAL(18,2)) AS base FROM dated WHERE base21 IS NOT NULL
      UNION ALL SELECT doc_id, 10, CAST(base10 AS DECIMAL(18,2)) FROM dated WHERE base10 IS NOT NULL
      UNION ALL SELECT doc_id, 4, CAST(base4 AS DECIMAL(18,2)) FROM dated WHERE base4 IS NOT NULL)"""

CTES["lines"] = """
SELECT doc_id, line_no, rate, base,
       CAST(true_amount + CASE WHEN line_no = 0 AND doc_id % 13 = 7 THEN 0.02 ELSE 0.00 END AS DECIMAL(18,2)) AS amount
FROM true_lines"""

CTES["sums"] = """
SELECT doc_id, CAST(sum(base) AS DECIMAL(18,2)) AS net, CAST(sum(true_amount) AS DECIMAL(18,2)) AS tax
FROM true_lines GROUP BY doc_id"""

_SUPPLIER_DIGITS = "lpad(CAST(suppkey % 10000000 AS VARCHAR), 7, '0')"
_CONTROL = f"(({control_digit(_SUPPLIER_DIGITS)} + CASE WHEN doc_id % 17 = 3 THEN 1 ELSE 0 END) % 10)"

CTES["ledger"] = f"""
SELECT d.doc_id,
       strftime(day, '%Y') || '/' || lpad(CAST(d.doc_id % 1000000 AS VARCHAR), 6, '0') AS number,
       day AS issue_date,
       CASE WHEN d.doc_id % 41 = 11 THEN '31/02/' || strftime(day, '%Y') ELSE strftime(day, '%d/%m/%Y') END AS printed_date,
       substr('BPF', CAST(suppkey % 3 AS INT) + 1, 1) || {_SUPPLIER_DIGITS} ||
         CASE WHEN suppkey % 3 = 1 THEN substr('{fv.CIF_LETTERS}', CAST({_CONTROL} AS INT) + 1, 1)
              ELSE CAST({_CONTROL} AS VARCHAR) END AS supplier_tax_id,
       'Almacenes Nacion ' || s_nationkey || ' ' || suppkey || ' S.L.' AS supplier_name,
       CASE WHEN custkey % 5 = 0
            THEN substr('XYZ', CAST((custkey // 5) % 3 AS INT) + 1, 1) || lpad(CAST(custkey % 10000000 AS VARCHAR), 7, '0') ||
                 substr('{fv.NIF_LETTERS}', CAST((((custkey // 5) % 3) * 10000000 + custkey % 10000000) % 23 AS INT) + 1, 1)
            ELSE lpad(CAST(custkey % 100000000 AS VARCHAR), 8, '0') ||
                 substr('{fv.NIF_LETTERS}', CAST((custkey % 100000000) % 23 AS INT) + 1, 1) END AS customer_tax_id,
       'Comercial ' || c_mktsegment || ' ' || custkey || ' S.A.' AS customer_name,
       net, tax,
       CAST(net + tax + CASE WHEN d.doc_id % 11 = 5 THEN 1.00 ELSE 0.00 END AS DECIMAL(18,2)) AS gross,
       CASE d.doc_id % 10 WHEN 0 THEN 'embedded_xml' WHEN 1 THEN 'scanned' WHEN 2 THEN 'hybrid' ELSE 'digital' END AS made_as
FROM dated d JOIN sums USING (doc_id)"""

_UNIT = "CASE WHEN doc_id % 7 = 3 THEN ' €' ELSE ' EUR' END"
CTES["entries"] = f"""
SELECT doc_id, made_as, 0.0 AS slot, 0 AS tie, 'FACTURA ' || number AS text FROM ledger WHERE doc_id % 43 <> 12
UNION ALL SELECT doc_id, made_as, 1, 0, 'Fecha: ' || printed_date FROM ledger
UNION ALL SELECT doc_id, made_as, 2, 0, 'EMISOR ' || supplier_tax_id FROM ledger
UNION ALL SELECT doc_id, made_as, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 3 END, 1, supplier_name FROM ledger
UNION ALL SELECT doc_id, made_as, 4, 0, 'CLIENTE ' || CASE WHEN doc_id % 29 = 8 AND regexp_matches(customer_tax_id, '^[0-9]')
       THEN left(customer_tax_id, 8) || '-' || right(customer_tax_id, 1) ELSE customer_tax_id END FROM ledger
UNION ALL SELECT doc_id, made_as, CASE WHEN doc_id % 6 = 0 THEN 4 ELSE 5 END, 1, customer_name FROM ledger WHERE doc_id % 23 <> 6
UNION ALL SELECT doc_id, made_as, 6, 0, 'Base imponible ' || {grouped('net')} || {_UNIT} FROM ledger
UNION ALL SELECT doc_id, made_as, 7, 0, 'Impuesto repercutido: ' || {grouped('tax')} || {_UNIT} FROM ledger
UNION ALL SELECT doc_id, made_as, CASE WHEN doc_id % 31 = 9 THEN 5.5 ELSE 20 END, 0, 'TOTAL FACTURA ' || {grouped('gross')} || {_UNIT} FROM ledger
UNION ALL SELECT doc_id, made_as, 21, 0, 'Gracias por su confianza' FROM ledger WHERE doc_id % 2 = 0
UNION ALL SELECT l.doc_id, made_as, 8 + 2 * line_no + CASE WHEN l.doc_id % 19 = 4 THEN 1 ELSE 0 END, 0,
       'IVA ' || rate || '% ' || CASE WHEN l.doc_id % 5 = 2 THEN {grouped('amount')} ELSE {plain('amount')} END || {_UNIT.replace('doc_id', 'l.doc_id')}
       FROM lines l JOIN ledger USING (doc_id)
UNION ALL SELECT l.doc_id, made_as, 9 + 2 * line_no - CASE WHEN l.doc_id % 19 = 4 THEN 1 ELSE 0 END, 0,
       'Base imponible: ' || {grouped('base')} || {_UNIT.replace('doc_id', 'l.doc_id')}
       FROM lines l JOIN ledger USING (doc_id)"""

CTES["rendered"] = """
SELECT *, page * 100000000000 + CAST(y0 * 100 AS BIGINT) * 10000 + block_seq AS ord
FROM (SELECT doc_id, made_as, CASE WHEN doc_id % 4 = 0 AND slot >= 20 THEN 2 ELSE 1 END AS page,
             CASE WHEN doc_id % 3 = 1 THEN 1000 - CAST(slot * 10 + tie AS INT) ELSE CAST(slot * 10 + tie AS INT) END AS block_seq,
             CAST(10 + 35 * slot AS DOUBLE) AS y0, text
      FROM entries WHERE doc_id % 37 <> 10)"""

CTES["ptext"] = """
SELECT doc_id, page, string_agg(text, chr(10) ORDER BY y0, block_seq) AS text
FROM rendered WHERE made_as IN ('digital', 'embedded_xml') GROUP BY doc_id, page
UNION ALL
SELECT doc_id, 1, CASE WHEN made_as = 'hybrid' AND doc_id % 37 <> 10 THEN '  FACTURA ' || number || chr(10) ELSE ' ' || chr(10) END
FROM ledger WHERE made_as IN ('scanned', 'hybrid') OR doc_id % 37 = 10"""

CTES["pimages"] = """
SELECT doc_id, 1 AS page, 1240 AS width, 1754 AS height FROM ledger WHERE made_as IN ('scanned', 'hybrid')
UNION ALL SELECT doc_id, 1, 120, 60 FROM ledger WHERE doc_id % 15 = 0"""

CTES["xml_docs"] = "SELECT *, (doc_id // 10) % 7 AS shape FROM ledger WHERE made_as = 'embedded_xml'"

CTES["attached"] = """
SELECT doc_id, shape, 0 AS att_seq, CASE shape WHEN 6 THEN 'xml-notas.txt' WHEN 1 THEN 'anexo.xml' ELSE 'factura.xml' END AS filename FROM xml_docs
UNION ALL SELECT doc_id, shape, 1, ' Factura.XML ' FROM xml_docs WHERE shape = 1"""

CTES["kinds"] = f"""
SELECT doc_id, has_xml, text_length, images,
       CASE WHEN has_xml THEN 'embedded_xml' WHEN text_length = 0 THEN 'scanned'
            WHEN text_length < {fv.HYBRID_TEXT_BELOW} AND images > 0 THEN 'hybrid' ELSE 'digital' END AS kind
FROM (SELECT t.doc_id, t.has_text_xml OR a.doc_id IS NOT NULL AS has_xml, t.text_length, coalesce(i.images, 0) AS images
      FROM (SELECT doc_id, sum(length({strip('text')})) AS text_length,
                   bool_or(contains(text, '<?xml') OR contains(lower(text), '<facturae') OR contains(lower(text), '<ubl') OR contains(lower(text), '<cii')) AS has_text_xml
            FROM ptext GROUP BY doc_id) t
      LEFT JOIN (SELECT doc_id, count(*) AS images FROM pimages GROUP BY doc_id) i USING (doc_id)
      LEFT JOIN (SELECT DISTINCT doc_id FROM attached WHERE contains(lower(filename), 'xml')) a USING (doc_id))"""

# ---- findings of text -------------------------------------------------------
CTES["feat"] = f"""
SELECT *, {strip('text')} AS line, {matches('text', fv.SELLER_WORDS)} AS seller, {matches('text', fv.BUYER_WORDS)} AS buyer,
       {matches('text', fv.BASE_WORDS)} AS is_base, {matches('text', fv.TAX_WORDS)} AS is_tax
FROM rendered"""

CTES["f_number"] = f"""
SELECT DISTINCT ON (doc_id) doc_id, page, trim({extract('text', fv.INVOICE_NUMBER)}) AS value
FROM feat WHERE {matches('text', fv.INVOICE_NUMBER)} ORDER BY doc_id, ord"""

CTES["f_date"] = f"""
SELECT DISTINCT ON (doc_id) doc_id, page,
       translate(CASE WHEN {matches('text', fv.DATE_DAY_FIRST)} THEN {extract('text', fv.DATE_DAY_FIRST)}
                      ELSE {extract('text', fv.DATE_YEAR_FIRST)} END, '/.', '--') AS value
FROM feat WHERE {matches('text', fv.DATE_WORDS)}
  AND ({matches('text', fv.DATE_DAY_FIRST)} OR {matches('text', fv.DATE_YEAR_FIRST)}) ORDER BY doc_id, ord"""

CTES["f_supplier_id"] = f"""
SELECT DISTINCT ON (doc_id) doc_id, page, coalesce(plain, replace(dashed, '-', '')) AS value,
       CASE WHEN plain IS NOT NULL THEN 0.85 ELSE 0.80 END AS confidence
FROM (SELECT *, nullif({extract('text', fv.TAX_ID_IN_TEXT)}, '') AS plain, nullif({extract('text', fv.DASHED_NIF_IN_TEXT)}, '') AS dashed
      FROM feat WHERE seller)
WHERE plain IS NOT NULL OR dashed IS NOT NULL ORDER BY doc_id, ord"""

CTES["f_customer_id"] = f"""
SELECT DISTINCT ON (doc_id) doc_id, page, coalesce(plain, replace(dashed, '-', '')) AS value,
       CASE WHEN plain IS NOT NULL THEN 0.85 ELSE 0.80 END AS confidence
FROM (SELECT *, nullif({extract('rest', fv.TAX_ID_IN_TEXT)}, '') AS plain, nullif({extract('rest', fv.DASHED_NIF_IN_TEXT)}, '') AS dashed
      FROM (SELECT *, substr(text, strpos(text, {extract('text', fv.BUYER_WORDS)}) + 1) AS rest FROM feat WHERE buyer))
WHERE plain IS NOT NULL OR dashed IS NOT NULL ORDER BY doc_id, ord"""

CTES["f_sections"] = """
SELECT *, last_value(CASE WHEN seller THEN 'supplier' WHEN buyer THEN 'customer' END IGNORE NULLS)
          OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
FROM feat"""

CTES["f_names"] = f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS name_rank
  FROM (SELECT doc_id, section, ord, page, line AS value,
               CASE WHEN {matches('text', fv.COMPANY_FORM)} THEN 0.85
                    WHEN {matches('line', fv.NAME_START)} AND NOT {matches('line', fv.NOT_A_NAME)} THEN 0.60 END AS confidence
        FROM f_sections
        WHERE NOT seller AND NOT buyer AND section IS NOT NULL AND length(line) BETWEEN 5 AND 80)
  WHERE confidence IS NOT NULL)
WHERE name_rank <= 2"""

CTES["f_best_names"] = """
SELECT DISTINCT ON (doc_id, section) doc_id, section, page, value, confidence
FROM f_names ORDER BY doc_id, section, confidence DESC, name_rank"""

CTES["f_bases"] = f"""
SELECT * FROM (SELECT doc_id, page, ord, {first_money(extract_all('text', fv.BASE_AMOUNT, 2))} AS base FROM feat WHERE is_base)
WHERE base IS NOT NULL"""

CTES["f_pairs"] = f"""
SELECT doc_id, page, ord, pos, TRY_CAST(replace(raw_rate, ',', '.') AS DECIMAL(7,4)) AS rate,
       TRY_CAST(replace(raw_amount, ',', '.') AS DECIMAL(28,2)) AS amount
FROM (SELECT doc_id, page, ord, unnest({extract_all('text', fv.TAX_RATE_AND_AMOUNT, 1)}) AS raw_rate,
             unnest({extract_all('text', fv.TAX_RATE_AND_AMOUNT, 2)}) AS raw_amount,
             generate_subscripts({extract_all('text', fv.TAX_RATE_AND_AMOUNT, 1)}, 1) AS pos
      FROM feat WHERE is_tax)
WHERE TRY_CAST(replace(raw_rate, ',', '.') AS DECIMAL(7,4)) BETWEEN 1 AND 27"""

CTES["f_rates"] = """
SELECT DISTINCT ON (doc_id, rate) doc_id, page, ord, pos, rate, amount FROM f_pairs ORDER BY doc_id, rate, ord, pos"""

CTES["f_lines"] = """
SELECT r.doc_id, r.page, r.ord, r.pos, r.rate, r.amount, arg_min(b.base, b.ord) AS base
FROM f_rates r LEFT JOIN f_bases b ON b.doc_id = r.doc_id AND b.ord >= r.ord
GROUP BY ALL"""

CTES["f_gross"] = f"""
SELECT DISTINCT ON (doc_id) doc_id, page, ord, value FROM (
  SELECT *, {first_money(extract_all('text', fv.TOTAL_AMOUNT, 2))} AS value FROM feat WHERE {matches('text', fv.TOTAL_WORDS)})
WHERE value IS NOT NULL ORDER BY doc_id, ord"""

CTES["f_net_any"] = "SELECT DISTINCT ON (doc_id) doc_id, page, ord, base AS value FROM f_bases ORDER BY doc_id, ord"

CTES["f_tax_any"] = f"""
SELECT DISTINCT ON (doc_id) doc_id, page, ord, value FROM (
  SELECT *, {first_money(extract_all('text', fv.EURO_AMOUNT, 1))} AS value FROM feat WHERE is_tax AND NOT is_base)
WHERE value IS NOT NULL ORDER BY doc_id, ord"""

CTES["f_net"] = """
SELECT n.* FROM f_net_any n LEFT JOIN f_gross g USING (doc_id) WHERE g.ord IS NULL OR n.ord // 1 <= g.ord"""

CTES["f_tax"] = """
SELECT t.* FROM f_tax_any t LEFT JOIN f_gross g USING (doc_id) WHERE g.ord IS NULL OR t.ord <= g.ord"""

# ---- candidates, long -------------------------------------------------------
CTES["cands"] = f"""
SELECT doc_id, 'invoice_data.number' AS field_name, value, 0.85 AS confidence, page, 0 AS seq FROM f_number
UNION ALL SELECT doc_id, 'invoice_data.issue_date', value, 0.85, page, 1 FROM f_date
UNION ALL SELECT doc_id, 'supplier.tax_id', value, confidence, page, 2 FROM f_supplier_id
UNION ALL SELECT doc_id, 'customer.tax_id', value, confidence, page, 3 FROM f_customer_id
UNION ALL SELECT doc_id, section || '.legal_name', value, confidence, page, name_rank + 10 FROM f_names
UNION ALL SELECT doc_id, 'tax_lines[' || {pointed_rate('rate')} || '].tax_rate', {pointed_rate('rate')}, 0.80, page, 100 FROM f_lines
UNION ALL SELECT doc_id, 'tax_lines[' || {pointed_rate('rate')} || '].tax_base', CAST(base AS VARCHAR), 0.80, page, 101 FROM f_lines WHERE base IS NOT NULL
UNION ALL SELECT doc_id, 'tax_lines[' || {pointed_rate('rate')} || '].tax_amount', CAST(amount AS VARCHAR), 0.80, page, 102 FROM f_lines
UNION ALL SELECT doc_id, 'totals.net_amount', CAST(value AS VARCHAR), 0.85, page, 1000 FROM f_net
UNION ALL SELECT doc_id, 'totals.tax_amount', CAST(value AS VARCHAR), 0.80, page, 1001 FROM f_tax
UNION ALL SELECT doc_id, 'totals.gross_amount', CAST(value AS VARCHAR), 0.90, page, 1002 FROM f_gross"""

CTES["best_cands"] = """
SELECT DISTINCT ON (doc_id, field_name) * FROM cands ORDER BY doc_id, field_name, confidence DESC, seq"""

# ---- text records -----------------------------------------------------------
CTES["rec_lines"] = f"""
SELECT doc_id, {plain_rate('rate')} AS rate_text, rate, base, amount,
       row_number() OVER (PARTITION BY doc_id ORDER BY {plain_rate('rate')}) - 1 AS i
FROM f_lines WHERE base IS NOT NULL"""

CTES["rec_sums"] = """
SELECT doc_id, count(*) AS n_lines, sum(base) AS sum_base, sum(amount) AS sum_amount,
       string_agg(rate_text || ':' || base || ':' || amount, ';' ORDER BY rate_text) AS lines_text,
       string_agg(CASE WHEN abs(base * rate - amount * 100) > 1 THEN '%s' END, '|' ORDER BY rate_text) AS line_warnings
FROM rec_lines GROUP BY doc_id""" % fv.MSG_TOTALS["tax_line_mismatch"]

CTES["rec_wide"] = f"""
SELECT k.doc_id, k.kind,
       CASE WHEN k.kind IN ('scanned', 'hybrid') THEN 'ocr' ELSE 'digital' END AS route,
       nu.value AS number, da.value AS date_text, {parse_date('da.value')} AS issue_date,
       si.value AS supplier_id, si.confidence AS supplier_id_c, {valid_id('si.value')} AS supplier_ok,
       ci.value AS customer_id, ci.confidence AS customer_id_c, {valid_id('ci.value')} AS customer_ok,
       sn.value AS supplier_name, sn.confidence AS supplier_name_c,
       cn.value AS customer_name, cn.confidence AS customer_name_c,
       ne.value AS net, ta.value AS tax, gr.value AS gross,
       coalesce(l.n_lines, 0) AS n_lines, coalesce(l.sum_base, 0) AS sum_base, coalesce(l.sum_amount, 0) AS sum_amount,
       coalesce(l.lines_text, '') AS lines_text, l.line_warnings
FROM kinds k
LEFT JOIN f_number nu USING (doc_id) LEFT JOIN f_date da USING (doc_id)
LEFT JOIN f_supplier_id si USING (doc_id) LEFT JOIN f_customer_id ci USING (doc_id)
LEFT JOIN (SELECT * FROM f_best_names WHERE section = 'supplier') sn USING (doc_id)
LEFT JOIN (SELECT * FROM f_best_names WHERE section = 'customer') cn USING (doc_id)
LEFT JOIN f_net ne USING (doc_id) LEFT JOIN f_tax ta USING (doc_id) LEFT JOIN f_gross gr USING (doc_id)
LEFT JOIN rec_sums l USING (doc_id)
WHERE k.kind <> 'embedded_xml' AND k.doc_id % 37 <> 10"""

_M, _T = fv.MSG_MISSING, fv.MSG_TOTALS


def _text_record(branch: str) -> str:
    ocr = branch == "ocr"
    zero = "0.0" if ocr else "NULL"
    const = fv.CONF_TAX_LINES_OCR if ocr else fv.CONF_TAX_LINES_DIGITAL

    def missing(field, column, always=False):
        return f"CASE WHEN {column} IS NULL THEN '{_M[field]}' END" if ocr or always else "NULL"

    def err(field, column):
        return f"CASE WHEN {column} IS NULL THEN 'missing_field:{field}' END"

    errors = [err("invoice_data.issue_date", "date_text")] if ocr else [
        err("invoice_data.number", "number"),
        err("invoice_data.issue_date", "date_text"),
        err("supplier.tax_id", "supplier_id"),
        err("customer.tax_id", "customer_id"),
    ]
    total = "round(({0} + {1} + {2}) / 3, 6)".format(
        "CASE WHEN net IS NULL THEN 0 ELSE 0.85 END",
        "CASE WHEN tax IS NULL THEN 0 ELSE 0.80 END",
        "CASE WHEN gross IS NULL THEN 0 ELSE 0.90 END",
    )
    parts = {
        "invoice_data.number": f"CASE WHEN number IS NULL THEN {zero} ELSE 0.85 END",
        "invoice_data.issue_date": f"CASE WHEN date_text IS NULL THEN {zero} WHEN issue_date IS NULL THEN 0 ELSE 0.85 END",
        "supplier.tax_id": f"CASE WHEN supplier_id IS NULL THEN {zero} WHEN supplier_ok THEN supplier_id_c ELSE supplier_id_c * 0.5 END",
        "supplier.legal_name": "coalesce(supplier_name_c, 0)",
        "customer.tax_id": f"CASE WHEN customer_id IS NULL THEN {zero} WHEN customer_ok THEN customer_id_c ELSE customer_id_c * 0.5 END",
        "customer.legal_name": "coalesce(customer_name_c, 0)",
        "tax_lines": f"CASE WHEN n_lines > 0 THEN {const} ELSE 0 END",
        "totals.net_amount": "CASE WHEN net IS NOT NULL THEN 0.85 END",
        "totals.tax_amount": "CASE WHEN tax IS NOT NULL THEN 0.80 END",
        "totals.gross_amount": "CASE WHEN gross IS NOT NULL THEN 0.90 END",
        "totals": total,
    }
    total_sum = " + ".join(f"coalesce(CAST({p} AS DOUBLE), 0)" for p in parts.values())
    total_n = " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in parts.values())
    review = ", ".join(f"CASE WHEN {p} < 0.7 THEN '{k}' END" for k, p in parts.items())
    n, t, g = "coalesce(net, 0)", "coalesce(tax, 0)", "coalesce(gross, 0)"
    complete = "(number IS NOT NULL AND issue_date IS NOT NULL AND supplier_id IS NOT NULL AND customer_id IS NOT NULL)"
    warnings = ", ".join(
        [
            missing("invoice_data.number", "number"),
            f"CASE WHEN date_text IS NOT NULL AND issue_date IS NULL THEN '{fv.MSG_INVALID_DATE}{fv.MSG_DATE_DETAIL}''' || date_text || '''' END",
            missing("invoice_data.issue_date", "date_text"),
            f"CASE WHEN supplier_id IS NOT NULL AND NOT supplier_ok THEN '{fv.MSG_INVALID_SUPPLIER_ID}' || supplier_id END",
            missing("supplier.tax_id", "supplier_id"),
            missing("supplier.legal_name", "supplier_name", True),
            f"CASE WHEN customer_id IS NOT NULL AND NOT customer_ok THEN '{fv.MSG_INVALID_CUSTOMER_ID}' || customer_id END",
            missing("customer.tax_id", "customer_id"),
            missing("customer.legal_name", "customer_name", True),
            f"CASE WHEN n_lines = 0 THEN '{fv.MSG_NO_TAX_LINES}' END",
            f"CASE WHEN abs(sum_base - {n}) > 0.01 THEN '{_T['net_amount_mismatch']}' END",
            f"CASE WHEN abs(sum_amount - {t}) > 0.01 THEN '{_T['tax_amount_mismatch']}' END",
            "line_warnings",
            f"CASE WHEN abs({n} + {t} - {g}) > 0.01 THEN '{_T['gross_amount_mismatch']}' END",
            f"CASE WHEN NOT {complete} THEN '{fv.MSG_INCOMPLETE}' END",
        ]
    )
    return f"""
SELECT doc_id, kind, '{branch}' AS route, CASE WHEN {complete} THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN {complete} THEN number END AS number,
       CASE WHEN {complete} THEN CAST(issue_date AS VARCHAR) END AS issue_date,
       CASE WHEN {complete} THEN supplier_id END AS supplier_id,
       CASE WHEN {complete} THEN coalesce(supplier_name, '{fv.UNKNOWN_NAME}') END AS supplier_name,
       CASE WHEN {complete} THEN customer_id END AS customer_id,
       CASE WHEN {complete} THEN coalesce(customer_name, '{fv.UNKNOWN_NAME}') END AS customer_name,
       CASE WHEN {complete} THEN lines_text END AS lines_text,
       CASE WHEN {complete} THEN CAST(CAST({n} AS DECIMAL(28,2)) AS VARCHAR) END AS net_amount,
       CASE WHEN {complete} THEN CAST(CAST({t} AS DECIMAL(28,2)) AS VARCHAR) END AS tax_amount,
       CASE WHEN {complete} THEN CAST(CAST({g} AS DECIMAL(28,2)) AS VARCHAR) END AS gross_amount,
       round(CASE WHEN {total_n} + n_lines > 0 THEN ({total_sum} + 0.8 * n_lines) / ({total_n} + n_lines) ELSE 0 END, 6) AS global_score,
       concat_ws('|', {review}) AS needs_review,
       concat_ws('|', {warnings}) AS warnings,
       concat_ws('|', {', '.join(errors)}) AS errors
FROM rec_wide WHERE route = '{branch}'"""


CTES["rec_digital"] = _text_record("digital")
_NULLS = ", ".join(
    f"NULL AS {c}"
    for c in (
        "number", "issue_date", "supplier_id", "supplier_name", "customer_id", "customer_name",
        "lines_text", "net_amount", "tax_amount", "gross_amount",
    )
)
CTES["rec_ocr"] = _text_record("ocr") + f"""
UNION ALL
SELECT doc_id, kind, 'ocr' AS route, 'error' AS status, {_NULLS}, 0.0 AS global_score, '' AS needs_review,
       '{fv.MSG_OCR_NO_TEXT_WARNING}' AS warnings, 'ocr_no_text:file' AS errors
FROM kinds WHERE kind <> 'embedded_xml' AND doc_id % 37 = 10"""

# ---- XML records ------------------------------------------------------------
CTES["xml_lines"] = """
SELECT l.doc_id, l.line_no, l.rate, l.base, l.amount FROM lines l JOIN xml_docs x USING (doc_id) WHERE x.shape <> 3"""

CTES["xml_sums"] = f"""
SELECT doc_id, count(*) AS n_lines, sum(base) AS sum_base, sum(amount) AS sum_amount,
       string_agg(rate || ':' || base || ':' || amount, ';' ORDER BY line_no) AS lines_text,
       string_agg(CASE WHEN abs(base * rate - amount * 100) > 1 THEN '{_T['tax_line_mismatch']}' END, '|' ORDER BY line_no) AS line_warnings
FROM xml_lines GROUP BY doc_id"""

CTES["rec_xml"] = f"""
SELECT doc_id, 'embedded_xml' AS kind, 'xml' AS route, 'ok' AS status, number, CAST(issue_date AS VARCHAR) AS issue_date,
       supplier_tax_id AS supplier_id, supplier_name, customer_tax_id AS customer_id, customer_name,
       coalesce(lines_text, '') AS lines_text, CAST(CAST(net AS DECIMAL(28,2)) AS VARCHAR) AS net_amount,
       CAST(CAST(tax AS DECIMAL(28,2)) AS VARCHAR) AS tax_amount, CAST(CAST(gross AS DECIMAL(28,2)) AS VARCHAR) AS gross_amount,
       0.95 AS global_score, '' AS needs_review,
       concat_ws('|', CASE WHEN NOT {valid_id('supplier_tax_id')} THEN '{fv.MSG_INVALID_SUPPLIER_ID}' || supplier_tax_id END,
                      CASE WHEN NOT {valid_id('customer_tax_id')} THEN '{fv.MSG_INVALID_CUSTOMER_ID}' || customer_tax_id END,
                      CASE WHEN lines_text IS NULL THEN '{fv.MSG_MISSING_XML['tax_lines']}' END,
                      CASE WHEN abs(coalesce(sum_base, 0) - net) > 0.01 THEN '{_T['net_amount_mismatch']}' END,
                      CASE WHEN abs(coalesce(sum_amount, 0) - tax) > 0.01 THEN '{_T['tax_amount_mismatch']}' END,
                      line_warnings,
                      CASE WHEN abs(net + tax - gross) > 0.01 THEN '{_T['gross_amount_mismatch']}' END) AS warnings,
       '' AS errors
FROM xml_docs LEFT JOIN xml_sums USING (doc_id) WHERE shape NOT IN (4, 5, 6)
UNION ALL
SELECT doc_id, 'embedded_xml', 'xml', 'error', {_NULLS}, 0.0, '',
       CASE shape WHEN 6 THEN '{fv.MSG_NO_XML_WARNING}' WHEN 5 THEN '{fv.MSG_XML_FORMAT_WARNING}ubl' ELSE '{fv.MSG_XML_FORMAT_WARNING}facturae' END,
       CASE shape WHEN 6 THEN 'no_xml_found:file' ELSE 'xml_parse_failed:file' END
FROM xml_docs WHERE shape IN (4, 5, 6)"""

CTES["records"] = "SELECT * FROM rec_digital UNION ALL SELECT * FROM rec_ocr UNION ALL SELECT * FROM rec_xml"

# ---- table cells ------------------------------------------------------------
CTES["grids"] = f"""
SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 5 <> 1 THEN 'IVA' || bar || 'Base' || bar || 'Cuota' END, body, '', 'Fin de la tabla') AS text,
       CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.88 END AS confidence
FROM (SELECT doc_id, any_value(bar) AS bar,
             string_agg(rate || '%' || bar || {grouped('base')} || bar || CASE WHEN doc_id % 9 = 4 THEN '' ELSE {plain('amount')} END ||
                        CASE WHEN doc_id % 8 = 3 AND line_no = 0 THEN bar || 'Retención ' || {plain('amount')} ELSE '' END, chr(10) ORDER BY line_no) AS body
      FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN chr(9) ELSE ' | ' END AS bar FROM lines) GROUP BY doc_id)"""

CTES["grid_lines"] = """
SELECT doc_id, confidence, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "row",
       len(string_split(text, chr(10))) AS n_lines
FROM grids"""

CTES["cells"] = f"""
SELECT doc_id, "row", col, confidence, n_lines, n_parts, trim(raw) AS text FROM (
  SELECT doc_id, "row", confidence, n_lines, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS col, len(parts) AS n_parts
  FROM (SELECT *, regexp_split_to_array({strip('line')}, '[\\t|]+') AS parts FROM grid_lines WHERE {strip('line')} <> ''))
WHERE trim(raw) <> ''"""

CTES["cell_read"] = f"""
SELECT *, CASE WHEN TRY_CAST(nullif(regexp_extract(lower(text), '{pattern(fv.TABLE_RATE)}', 1), '') AS INT) IN (21, 10, 4, 0)
               THEN TRY_CAST(regexp_extract(lower(text), '{pattern(fv.TABLE_RATE)}', 1) AS INT) END AS rate,
       {money('text')} AS money,
       CASE WHEN contains(lower(text), 'reten') THEN
            CASE WHEN {matches('text', fv.WITHHOLDING_GROUPED)} THEN {money(extract('text', fv.WITHHOLDING_GROUPED, 1))}
                 ELSE {money(extract('text', fv.WITHHOLDING_PLAIN, 1))} END END AS withheld,
       row_number() OVER (PARTITION BY doc_id, "row" ORDER BY col) - 1 AS i
FROM cells"""

CTES["row_texts"] = """
SELECT doc_id, "row", lower(string_agg(text, ' ' ORDER BY col)) AS joined FROM cells GROUP BY doc_id, "row" """

CTES["table_lines"] = f"""
SELECT doc_id, "row", rate, base, amount, withheld, source,
       CASE WHEN base IS NULL OR amount IS NULL THEN (c0 + 0.8) / 2
            WHEN abs(base * rate - amount * 100) <= 50 THEN least(0.95, (c0 + 0.8 + 0.9) / 3)
            ELSE least(0.7, (c0 + 0.8 + 0.6) / 3) END AS confidence
FROM (SELECT c.doc_id, c."row", any_value(r.rate) AS rate, arg_min(c.confidence, c.i) AS c0,
             (list(c.money ORDER BY c.i) FILTER (WHERE c.i <> r.i AND c.money IS NOT NULL))[1] AS base,
             (list(c.money ORDER BY c.i) FILTER (WHERE c.i <> r.i AND c.money IS NOT NULL))[2] AS amount,
             arg_max(c.withheld, c.i) FILTER (WHERE c.i <> r.i AND c.i > 0 AND c.withheld IS NOT NULL) AS withheld,
             CASE WHEN max(c.confidence) < 1 THEN 'synthetic' ELSE 'layout' END AS source
      FROM cell_read c
      JOIN (SELECT doc_id, "row", min(i) AS i, arg_min(rate, i) AS rate FROM cell_read WHERE rate IS NOT NULL GROUP BY doc_id, "row") r USING (doc_id, "row")
      JOIN row_texts t USING (doc_id, "row")
      WHERE {count_words('t.joined', fv.HEADER_WORDS)} < 2
      GROUP BY c.doc_id, c."row")"""

# ---- model answers ----------------------------------------------------------
CTES["asked"] = "SELECT *, (doc_id // 3) % 5 AS writing FROM ledger WHERE doc_id % 3 = 0"

CTES["proposed"] = """
SELECT doc_id, 'invoice_data.number' AS field_name, number AS value, 1.0 AS confidence FROM asked WHERE writing <> 4
UNION ALL SELECT doc_id, 'invoice_data.issue_date', CAST(issue_date AS VARCHAR), 1.0 FROM asked WHERE writing <> 4
UNION ALL SELECT doc_id, 'supplier.legal_name', supplier_name, 1.0 FROM asked WHERE writing <> 4
UNION ALL SELECT doc_id, 'supplier.tax_id', supplier_tax_id, 1.0 FROM asked WHERE writing <> 4 AND doc_id % 4 <> 1
UNION ALL SELECT doc_id, 'customer.legal_name', customer_name, 1.0 FROM asked WHERE writing <> 4
UNION ALL SELECT doc_id, 'customer.tax_id', customer_tax_id, 1.0 FROM asked WHERE writing <> 4
UNION ALL SELECT l.doc_id, 'tax_lines[' || line_no || '].tax_rate', CAST(rate AS VARCHAR), 0.9 FROM lines l JOIN asked USING (doc_id) WHERE writing <> 4
UNION ALL SELECT l.doc_id, 'tax_lines[' || line_no || '].tax_base', CAST(base AS VARCHAR), 0.9 FROM lines l JOIN asked USING (doc_id) WHERE writing <> 4
UNION ALL SELECT l.doc_id, 'tax_lines[' || line_no || '].tax_amount', CAST(amount AS VARCHAR), 0.9 FROM lines l JOIN asked USING (doc_id) WHERE writing <> 4
UNION ALL SELECT doc_id, 'totals.net_amount', CAST(net AS VARCHAR), 0.9 FROM asked WHERE writing <> 4
UNION ALL SELECT doc_id, 'totals.tax_amount', CAST(tax AS VARCHAR), 0.9 FROM asked WHERE writing <> 4
UNION ALL SELECT doc_id, 'totals.gross_amount', CAST(gross AS VARCHAR), 0.9 FROM asked WHERE writing <> 4"""

CTES["prop_sums"] = f"""
SELECT doc_id, count(*) AS n_lines, sum(base) AS sum_base, sum(amount) AS sum_amount,
       string_agg(rate || ':' || base || ':' || amount, ';' ORDER BY line_no) AS lines_text,
       string_agg(CASE WHEN abs(base * rate - amount * 100) > 1 THEN '{_T['tax_line_mismatch']}' END, '|' ORDER BY line_no) AS line_warnings
FROM lines GROUP BY doc_id"""

CTES["rec_model"] = f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 4 <> 1 THEN number END AS number,
       CASE WHEN doc_id % 4 <> 1 THEN CAST(issue_date AS VARCHAR) END AS issue_date,
       CASE WHEN doc_id % 4 <> 1 THEN supplier_tax_id END AS supplier_id,
       CASE WHEN doc_id % 4 <> 1 THEN supplier_name END AS supplier_name,
       CASE WHEN doc_id % 4 <> 1 THEN customer_tax_id END AS customer_id,
       CASE WHEN doc_id % 4 <> 1 THEN customer_name END AS customer_name,
       CASE WHEN doc_id % 4 <> 1 THEN lines_text END AS lines_text,
       CASE WHEN doc_id % 4 <> 1 THEN CAST(net AS VARCHAR) END AS net_amount,
       CASE WHEN doc_id % 4 <> 1 THEN CAST(tax AS VARCHAR) END AS tax_amount,
       CASE WHEN doc_id % 4 <> 1 THEN CAST(gross AS VARCHAR) END AS gross_amount,
       round((0.7 * CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 6 END + 0.63 * (3 * n_lines + 3)) /
             (CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 6 END + 3 * n_lines + 3), 6) AS global_score,
       concat_ws('|', CASE WHEN doc_id % 4 <> 1 AND NOT {valid_id('supplier_tax_id')} THEN '{fv.MSG_INVALID_SUPPLIER_ID}' || supplier_tax_id END,
                      CASE WHEN NOT {valid_id('customer_tax_id')} THEN '{fv.MSG_INVALID_CUSTOMER_ID}' || customer_tax_id END,
                      CASE WHEN abs(sum_base - net) > 0.01 THEN '{_T['net_amount_mismatch']}' END,
                      CASE WHEN abs(sum_amount - tax) > 0.01 THEN '{_T['tax_amount_mismatch']}' END,
                      line_warnings,
                      CASE WHEN abs(net + tax - gross) > 0.01 THEN '{_T['gross_amount_mismatch']}' END) AS warnings,
       CASE WHEN doc_id % 4 = 1 THEN 'missing_field:supplier.tax_id' ELSE '' END AS errors
FROM asked JOIN prop_sums USING (doc_id) WHERE writing <> 4"""

# ---- scoring ----------------------------------------------------------------
CTES["truth"] = """
SELECT 'doc_' || doc_id || '.pdf' AS invoice_file,
       CASE doc_id % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'hybrid' ELSE 'scanned' END AS invoice_type, * FROM ledger"""

CTES["scored"] = f"""
SELECT t.invoice_file, t.invoice_type, t.doc_id, p.has_prediction,
       CASE WHEN has_prediction AND t.doc_id % 5 <> 1 THEN 1.0 ELSE 0.0 END AS s_number,
       CASE WHEN has_prediction AND t.doc_id % 8 <> 3 THEN 1.0 ELSE 0.0 END AS s_date,
       CASE WHEN NOT has_prediction THEN 0.0 WHEN t.doc_id % 9 = 5 THEN 2.0 * cut_length / (name_length + cut_length)
            ELSE 1.0 END AS s_supplier_name,
       CASE WHEN has_prediction THEN 1.0 ELSE 0.0 END AS s_supplier_id,
       CASE WHEN has_prediction AND t.doc_id % 10 <> 5 THEN 1.0 ELSE 0.0 END AS s_customer_name,
       CASE WHEN has_prediction AND t.doc_id % 14 <> 9 THEN 1.0 ELSE 0.0 END AS s_customer_id,
       CASE WHEN has_prediction AND t.doc_id % 12 <> 7 THEN
            CASE WHEN t.doc_id % 11 = 6 THEN (n_lines - 1.0) / n_lines ELSE 1.0 END ELSE 0.0 END AS s_lines,
       CASE WHEN NOT has_prediction THEN 0.0
            WHEN t.doc_id % 6 = 2 THEN (2.0 + greatest(0.0, 1 - 5.0 / CAST(gross AS DOUBLE))) / 3 ELSE 1.0 END AS s_totals
FROM truth t
JOIN (SELECT doc_id, doc_id % 7 <> 1 AS has_prediction FROM ledger) p USING (doc_id)
JOIN (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id) USING (doc_id)
JOIN (SELECT doc_id, length(short) AS name_length,
             length(trim(substr(short, 1, CAST(length(short) - 2 - 2 * (doc_id % 4) AS INTEGER)))) AS cut_length
      FROM (SELECT doc_id, {normalized_name('supplier_name')} AS short FROM ledger)) USING (doc_id)"""

CTES["field_scores"] = """
SELECT *, score >= CASE WHEN field_path LIKE '%.legal_name' THEN 0.85 ELSE 1 END AS matched FROM (
SELECT invoice_file, invoice_type, 'invoice_data.number' AS field_path, s_number AS score FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'invoice_data.issue_date', s_date FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'supplier.legal_name', s_supplier_name FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'supplier.tax_id', s_supplier_id FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'customer.legal_name', s_customer_name FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'customer.tax_id', s_customer_id FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'tax_lines', s_lines FROM scored
UNION ALL SELECT invoice_file, invoice_type, 'totals', s_totals FROM scored)"""


def _needed(sql: str, seen: list[str]) -> None:
    for name in CTES:
        if re.search(rf"\b{name}\b", sql) and name not in seen:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def with_tables(sql: str) -> str:
    """A check with the expressions it refers to in front."""
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in names)
    return f"WITH {body}\n{sql}"
