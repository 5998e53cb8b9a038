"""The closed lists, labels and thresholds results depend on.

Every value below has to equal the published behaviour exactly; change them
through function arguments, not here.
"""

# Closed lists.
DIMENSIONS = ("month", "country", "category", "payment_method", "shipping_zone")
CHART_KINDS = (
    "monthly_sales",
    "sales_by_country",
    "sales_by_category",
    "top_products",
    "returns_by_reason",
    "payment_share",
    "delivery_days_hist",
)
VERDICTS = ("PASS", "PARTIAL", "FAIL", "ERROR", "NEEDS_REVIEW")
JUDGE_VERDICTS = ("PASS", "PARTIAL", "FAIL")

# Return reason -> bucket; anything else, missing included, is "Other".
RETURN_BUCKETS = {
    "not_as_described": "Product / listing quality",
    "defective_product": "Product / listing quality",
    "arrived_damaged": "Shipping damage",
    "changed_mind": "Customer choice",
    "wrong_size_or_model": "Customer choice",
}
CUSTOMER_BUCKET = "Customer choice"
OTHER = "Other"

# Alert thresholds (percent, percent, days, days) and trend length.
CANCEL_RATE_LIMIT = 8.0
RETURN_RATE_LIMIT = 10.0
TRANSIT_DAYS_LIMIT = 10
PROCESSING_DAYS_LIMIT = 2
CONCENTRATION_SHARE = 0.5
TREND_WEEKS = 4
FLAT_BELOW = 0.05

# Lengths, caps, windows and the audit's tolerance.
MAX_LISTED = 50
CHART_PRODUCTS_MIN, CHART_PRODUCTS_MAX = 3, 15
ARCHIVE_DAYS = 14
ARCHIVE_CHARS = 500
INSIGHT_DAYS = 30
QUESTION_CHARS = 160
ERROR_CHARS = 120
REPLY_CHARS = 60
UNREAD_REPLY = "unparseable judge reply: "
JUDGE_ERROR = "judge error: "
AUDIT_TOLERANCE = 0.01

# Tool name -> topic of the team questions; anything else is "Other".
TOOL_TOPICS = {
    "search_policies": "Internal policies",
    "late_return_requests": "Returns",
    "returns_report": "Returns",
    "top_products": "Sales & products",
    "sales_breakdown": "Sales & products",
    "sales_overview": "Sales & products",
    "order_lookup": "Order lookup",
    "generate_chart": "Reports & charts",
}

# Spanish display labels.
LABELS_ES = {
    "credit_card": "Tarjeta de crédito",
    "debit_card": "Tarjeta de débito",
    "digital_wallet": "Billetera digital",
    "bank_transfer": "Transferencia",
    "cash_on_delivery": "Contra entrega",
    "defective_product": "Producto defectuoso",
    "not_as_described": "No corresponde a la descripción",
    "changed_mind": "Arrepentimiento",
    "wrong_size_or_model": "Talla o modelo incorrecto",
    "arrived_damaged": "Llegó dañado",
    "Electronics": "Electrónica",
    "Home": "Hogar",
    "Fashion": "Moda",
    "Sports": "Deportes",
    "Beauty": "Belleza",
    "Accessories": "Accesorios",
}

# Policy document titles by file stem; an unknown stem is its own title.
DOCUMENT_TITLES = {
    "politica_reembolsos_devoluciones": "Política de Reembolsos y Devoluciones",
    "programa_afiliados": "Programa de Afiliados",
    "guia_tiempos_costos_envio": "Guía de Tiempos y Costos de Envío",
    "faq_metodos_pago": "FAQ de Métodos de Pago",
    "manual_garantia_productos": "Manual de Garantía de Productos",
}

# Passages.
SECTION_BREAK = r'\n(?=\d{1,2}(?:\.\d{1,2})?\.?\s+[A-ZÁÉÍÓÚÑ¿«"])'
HEADING = r"^(\d{1,2}(?:\.\d{1,2})?\.?\s+[^\n]{3,80})"
DEFAULT_SECTION = "Introducción"
MIN_FRAGMENT_CHARS = 80
CHUNK_CHARS = 1000
CHUNK_OVERLAP = 150
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
TOP_PASSAGES = 5
DEFAULT_TITLE = "Documento interno"
DEFAULT_PAGE = "?"
PASSAGE_BREAK = "\n\n---\n\n"
NO_PASSAGES = "NO_RESULTS: nothing relevant found in the policy corpus."

# Fixed value: where the question text sits in the printed inputs of a root run.
TRACE_QUESTION = r"""content['"]:\s*['"]([^\n]+?)(?:\\n\\n\[System note|['"])"""

# Cell texts a sheet export uses for "nothing here".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
