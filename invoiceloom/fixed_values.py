"""Values that decide results: patterns, word lists, thresholds, messages.

Everything below is a FIXED VALUE.  It has to stay exactly as it is for records
to come out the same, so it is kept together here as plain text and never
derived.  Patterns are Java regular expressions; ``(?U)`` makes word borders,
digits and blanks follow Unicode, ``(?iU)`` also folds case over Unicode.
"""

# ---- blanks stripped from the ends of a text -------------------------------
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)

# ---- tax identifiers -------------------------------------------------------
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
CIF_TYPES_LETTER_ONLY = "KPQRSNW"
CIF_TYPES_DIGIT_ONLY = "ABEH"
NIF_SHAPE = r"^[0-9]{8}[A-Z]\z"
NIE_SHAPE = r"^[XYZ][0-9]{7}[A-Z]\z"
CIF_SHAPE = r"^[ABCDEFGHJKLMNPQRSUVW][0-9]{7}[0-9A-J]\z"
TAX_ID_IN_TEXT = (
    r"(?U)\b([ABCDEFGHJKLMNPQRSUVW]\d{7}[0-9A-J])\b|\b(\d{8}[A-Z])\b|\b([XYZ]\d{7}[A-Z])\b"
)
DASHED_NIF_IN_TEXT = r"(?U)\b(\d{8})-([A-Z])\b"
XML_TAX_ID_SHAPE = r"^[ABCDEFGHJKLMNPQRSUVW]\d{7}[\dA-J]$"

# ---- words and patterns looked for in text blocks --------------------------
INVOICE_NUMBER = (
    r"(?iU)\b(\d{2,4}[/\-]\d{3,6})\b|\b(F\s*[/\-]?\s*\d{3,6})\b|\b([A-Z]?\d{2,4}[/\-]\d{3,6})\b"
)
DATE_WORDS = (
    r"(?iU)\b(fecha\s*(de)?\s*(factura|emisión|expedición|emision)?)"
    r"|\b(f\.? ?em\.?)\b|\b(issue\s*date)\b"
)
DATE_DAY_FIRST = r"(?U)\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"
DATE_YEAR_FIRST = r"(?U)\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
SELLER_WORDS = (
    r"(?iU)\b(emitid[oa]|emisor|proveedor|vendedor|vendor|de\s+parte\s+de|ship\s*from|supplier|seller)\b"
)
BUYER_WORDS = (
    r"(?iU)\b(domicilio\s+(de\s+)?(entrega|cliente|destino)|cliente|comprador|buyer|customer|purchaser"
    r"|bill\s*to|ship\s*to|billed\s*to)\b"
)
COMPANY_FORM = (
    r"(?iU)\b(S\.?L\.?|S\.?A\.?|S\.?L\.?U\.?|S\.?A\.?U\.?|limitada|anónima|bis断续|sl|sa|slu|sau)\b"
)
NOT_A_NAME = r"(?iU)\d+[.,]\d+\s*(€|eur)|\b(base|iva|total|factura|importe|tax|amount)\b|^\d"
NAME_START = r"^[A-ZÁÉÍÓÚÑ]"
NAME_MIN_LENGTH, NAME_MAX_LENGTH = 5, 80
NAMES_KEPT_PER_SECTION = 2
BASE_WORDS = r"(?iU)\b(base\s+(imponible)?|base\s+tax|taxable\s+base|imponible)\b"
BASE_AMOUNT = r"(?iU)(?:base\s+(imponible)?\s*[:;]?\s*)([0-9.,]+\s*€?|EUR\s*[0-9.,]+)"
TAX_WORDS = r"(?iU)\b(iva|impuesto|tax|vat|i\.?v\.?a\.?)\b"
TAX_RATE_AND_AMOUNT = (
    r"(?iU)(?:(?:tipo\s+)?iva|impuesto|tax|vat)\s*(\d{1,2}[.,]?\d{0,2})\s*%?\s*[:]?\s*"
    r"([0-9]+[.,]\d{2})\s*(?:€|eur|EUR)?"
)
TEXT_RATE_MIN, TEXT_RATE_MAX = 1, 27
TOTAL_WORDS = (
    r"(?iU)\b(total\s+(factura|general|bruto)|importe\s+total|total\s+(a\s+)?pagar|grand\s+total"
    r"|amount\s+due|total\s*[=:]\s*[0-9.,]+\s*€?)\b"
)
TOTAL_AMOUNT = (
    r"(?iU)(?:total\s+(factura|general|bruto|importe)?\s*[:]?\s*)([0-9.,]+\s*€?|EUR\s*[0-9.,]+)"
)
EURO_AMOUNT = r"(?iU)([0-9]{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)\s*(?:€|eur|EUR)"

# ---- confidence of what a text block yields --------------------------------
CONF_NUMBER = 0.85
CONF_DATE = 0.85
CONF_TAX_ID = 0.85
CONF_TAX_ID_DASHED = 0.80
CONF_NAME_COMPANY = 0.85
CONF_NAME_PLAIN = 0.60
CONF_TAX_LINE = 0.80
CONF_NET = 0.85
CONF_TAX = 0.80
CONF_GROSS = 0.90
CONF_TAX_LINES_DIGITAL = 0.75
CONF_TAX_LINES_OCR = 0.65
CONF_XML = 0.95
INVALID_TAX_ID_FACTOR = 0.5
REVIEW_BELOW = 0.7

# ---- fiscal tables ---------------------------------------------------------
TABLE_RATES = (21, 10, 4, 0)
TABLE_RATE = r"(?U)(\d+)[.,]?\d*\s*%"
HEADER_WORDS = (
    "iva", "tipo", "base", "cuota", "total", "impuesto", "tax", "rate", "porcentaje", "%",
    "base imponible",
)
TABLE_SIGNS = (
    "iva", "base", "cuota", "tipo", "%", "impuesto", "tax", "rate", "base imponible",
    "21%", "10%", "4%", "21,", "10,", "4,",
)
TABLE_KINDS = ("tax_table", "unknown")
CELL_BREAK = r"[\t|]+"
WITHHOLDING_MARK = "reten"
WITHHOLDING_GROUPED = r"(?U)([0-9]{1,3}(?:[.,]\d{3})*[.,]\d{2})"
WITHHOLDING_PLAIN = r"(?U)(\d+[.,]\d+)"
GRID_CELL_CONFIDENCE = 0.8
ROW_RATE_CONFIDENCE = 0.8
ROW_MATCH_WEIGHT, ROW_MATCH_CAP = 0.9, 0.95
ROW_MISMATCH_WEIGHT, ROW_MISMATCH_CAP = 0.6, 0.7
ROW_AMOUNT_TOLERANCE = "0.50"

# ---- document kinds, sources, routes ---------------------------------------
HYBRID_TEXT_BELOW = 50
SOURCE_PRIORITY = {"xml": 1, "digital_text": 2, "ocr": 3, "layout": 4, "vlm": 5}

# ---- nine resolved fields, in this order -----------------------------------
RECORD_FIELDS = (
    "invoice_data.number",
    "invoice_data.issue_date",
    "supplier.tax_id",
    "supplier.legal_name",
    "customer.tax_id",
    "customer.legal_name",
    "totals.net_amount",
    "totals.tax_amount",
    "totals.gross_amount",
)
REQUIRED_FIELDS = (
    "invoice_data.number",
    "invoice_data.issue_date",
    "supplier.tax_id",
    "customer.tax_id",
)
EVALUATED_FIELDS = (
    "invoice_data.number",
    "invoice_data.issue_date",
    "supplier.legal_name",
    "supplier.tax_id",
    "customer.legal_name",
    "customer.tax_id",
    "tax_lines",
    "totals",
)

# ---- evaluation ------------------------------------------------------------
MONEY_TOLERANCE = "0.01"
NAME_RATIO_MIN = 0.85
NAME_SUFFIXES = r"(?iU)\b(S\.L\.|S\.A\.|S\.L\.L\.|Ltd\.|Inc\.|Corp\.)\b"
NAME_SEPARATORS = r"(?U)[\s\-.,;]+"

# ---- model proposals -------------------------------------------------------
PROPOSAL_FENCE = r"(?is)```(?:json)?\s*(.*?)```"
TRAILING_COMMA = r",(\s*[}\]])"
PROPOSAL_FACTOR = 0.7
PROPOSAL_CONF_FIELD = 1.0
PROPOSAL_CONF_AMOUNT = 0.9
MODEL_GLOBAL_BELOW = 0.6
MODEL_FIELD_BELOW = 0.6
OCR_LINES_BELOW = 5  # own choice: a scan with fewer lines was read badly

# ---- messages --------------------------------------------------------------
UNKNOWN_NAME = "Desconocido"
MSG_INVALID_SUPPLIER_ID = "CIF/NIF del emisor potencialmente inválido: "
MSG_INVALID_CUSTOMER_ID = "CIF/NIF del cliente potencialmente inválido: "
MSG_INVALID_ID = "Tax ID potencialmente inválido: "
MSG_INVALID_DATE = "Fecha inválida: "
MSG_INVALID_DATE_XML = "Fecha inválida del XML: "
MSG_INVALID_DATE_MODEL = "Fecha inválida (VLM): "
MSG_DATE_DETAIL = "Fecha de factura inválida: "
MSG_NO_TAX_LINES = "No se detectaron líneas de IVA."
MSG_INCOMPLETE = "Faltan campos obligatorios; respuesta marcada como error."
MSG_MISSING = {
    "invoice_data.number": "Número de factura no encontrado.",
    "invoice_data.issue_date": "Fecha no encontrada.",
    "supplier.tax_id": "CIF/NIF del emisor no encontrado.",
    "supplier.legal_name": "Razón social del emisor no encontrada.",
    "customer.tax_id": "CIF/NIF del cliente no encontrado.",
    "customer.legal_name": "Razón social del cliente no encontrada.",
}
MSG_MISSING_XML = {
    "invoice_data.number": "Número de factura no encontrado en XML.",
    "invoice_data.issue_date": "Fecha de factura no encontrada en XML.",
    "supplier.tax_id": "Tax ID del emisor no encontrado en XML.",
    "supplier.legal_name": "Razón social del emisor no encontrada en XML.",
    "customer.tax_id": "Tax ID del cliente no encontrado en XML.",
    "customer.legal_name": "Razón social del cliente no encontrada en XML.",
    "tax_lines": "No se encontraron líneas de IVA en XML.",
    "record": "Faltan campos obligatorios en XML.",
}
MSG_MISSING_MODEL = {
    "invoice_data.number": "Número de factura no encontrado (VLM).",
    "invoice_data.issue_date": "Fecha no encontrada (VLM).",
    "supplier.tax_id": "CIF/NIF del emisor no encontrado (VLM).",
    "customer.tax_id": "CIF/NIF del cliente no encontrado (VLM).",
}
MSG_TOTALS = {
    "net_amount_mismatch": "La base imponible total no coincide con la suma de bases fiscales.",
    "tax_amount_mismatch": "El IVA total no coincide con la suma de cuotas fiscales.",
    "tax_line_mismatch": "La cuota de IVA no coincide con base * porcentaje.",
    "gross_amount_mismatch": "El total factura no cuadra con base + IVA - adelantos - retenciones.",
}
MSG_NO_TABLES = "No se detectaron tablas fiscales en el layout."
MSG_NO_TABLE_LINES = (
    "Se detectaron tablas pero no se pudo extraer líneas fiscales. "
    "Verificar que las tablas contengan columnas de IVA/base/cuota."
)
MSG_GRID_EMPTY = "Tabla sintética vacía."
MSG_GRID_BLANK = "Tabla sintética sin celdas con texto."
MSG_GRID_NO_LINES = (
    "No se pudieron extraer líneas fiscales desde la tabla sintética. "
    "Verificar que las columnas contengan tasas de IVA válidas (21%, 10%, 4%) "
    "y valores monetarios en formato español (1.234,56)."
)
MSG_KIND_DIGITAL = ("El PDF es de tipo ", "; se esperaba digital o híbrido.")
MSG_KIND_OCR = ("El PDF es de tipo ", "; se esperaba escaneado o híbrido, o force_ocr=True.")
MSG_OCR_NO_TEXT = "El OCR no detectó texto en el documento escaneado."
MSG_OCR_NO_TEXT_WARNING = "OCR no detectó texto en el documento."
MSG_NO_XML = "El PDF no contiene XML embebido."
MSG_NO_XML_WARNING = "No se encontraron XMLs embebidos en el PDF."
MSG_XML_FORMAT = "No se reconoció el formato XML: "
MSG_XML_FORMAT_WARNING = "XML encontrado pero no pudo ser parseado: "
MSG_MODEL_MISSING_FIELD = "Campos obligatorios faltantes: "
MSG_MODEL_LOW_FIELD = "Campos clave con baja confianza: "
MSG_MODEL_COMPLEX_SCANNED = "Factura escaneada con tabla fiscal no resuelta"
MSG_MODEL_TABLE = "Tabla fiscal no resuelta por layout/OCR"
MSG_MODEL_LOW_OCR = "OCR con baja calidad (pocos bloques detectados)"
MSG_MODEL_NOTHING = "VLM no propuso candidatos."
