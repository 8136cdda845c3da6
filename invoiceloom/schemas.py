"""Schemas of the tables the jobs read; never inferred."""

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"

BLOCKS = f"doc_id bigint, page int, block_seq int, text string, bbox {BBOX}, source string, confidence double"
PAGE_TEXT = "doc_id bigint, page int, text string"
PAGE_IMAGES = f"doc_id bigint, page int, width int, height int, bbox {BBOX}"
ATTACHMENTS = "doc_id bigint, att_seq int, filename string, raw_xml string"
OCR_LINES = (
    "doc_id bigint, page int, line_seq int, polygon array<struct<x:double,y:double>>, "
    "text string, confidence double"
)
TABLE_CELLS = (
    f"doc_id bigint, page int, table_seq int, table_rows int, kind string, row int, col int, "
    f"text string, bbox {BBOX}, confidence double"
)
MODEL_RESPONSES = "doc_id bigint, page int, raw_text string"
CANDIDATES = (
    f"doc_id bigint, field_name string, value string, normalized_value string, confidence double, "
    f"page int, bbox {BBOX}, source string, cand_seq int"
)
TAX_LINES = (
    "doc_id bigint, line_no int, tax_rate decimal(7,4), tax_base decimal(28,2), tax_amount decimal(28,2)"
)
TOTALS = (
    "doc_id bigint, net_amount decimal(28,2), tax_amount decimal(28,2), gross_amount decimal(28,2), "
    "advance_amount decimal(28,2), withholding_amount decimal(28,2)"
)

# A record as people write it down for scoring: amounts and rates are text.
RECORD_TEXT = (
    "struct<invoice_data:struct<number:string,issue_date:string,due_date:string>,"
    "supplier:struct<legal_name:string,tax_id:string>,"
    "customer:struct<legal_name:string,tax_id:string>,"
    "tax_lines:array<struct<tax_rate:string,tax_base:string,tax_amount:string>>,"
    "totals:struct<net_amount:string,tax_amount:string,gross_amount:string,"
    "advance_amount:string,withholding_amount:string>>"
)
EXPECTED = f"invoice_file string, invoice_type string, expected {RECORD_TEXT}"
PREDICTED = f"invoice_file string, predicted {RECORD_TEXT}"

# A model's answer; amounts may come as numbers or as text, both land as text.
MODEL_RECORD = (
    "invoice_data struct<number:string,issue_date:string>, "
    "supplier struct<legal_name:string,tax_id:string>, "
    "customer struct<legal_name:string,tax_id:string>, "
    "tax_lines array<struct<tax_rate:string,tax_base:string,tax_amount:string>>, "
    "totals struct<net_amount:string,tax_amount:string,gross_amount:string>"
)

# A finished record.
INVOICE = (
    "struct<supplier:struct<legal_name:string,tax_id:string>,"
    "customer:struct<legal_name:string,tax_id:string>,"
    "invoice_data:struct<number:string,issue_date:date,due_date:date>,"
    "tax_lines:array<struct<tax_rate:decimal(7,4),tax_base:decimal(28,2),tax_amount:decimal(28,2)>>,"
    "totals:struct<net_amount:decimal(28,2),tax_amount:decimal(28,2),gross_amount:decimal(28,2),"
    "advance_amount:decimal(28,2),withholding_amount:decimal(28,2)>>"
)
EVIDENCE = f"map<string,struct<text:string,page:int,bbox:{BBOX},source:string>>"
ERRORS = "array<struct<code:string,message:string,field:string>>"
RESPONSES = (
    f"doc_id bigint, kind string, route string, status string, invoice {INVOICE}, "
    f"global_score double, fields map<string,double>, needs_review array<string>, "
    f"warnings array<string>, errors {ERRORS}, evidence {EVIDENCE}"
)
