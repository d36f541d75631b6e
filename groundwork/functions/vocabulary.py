"""Words and patterns that decide results. All are defaults of arguments."""

from __future__ import annotations

# Results follow from these lists, patterns and limits.

YEAR_MIN, YEAR_MAX = 2018, 2027

#: A row label with one of these is another kind of number than the headline it names.
EXCLUDED_LABEL_TERMS = ("per share", "per diluted", "diluted", "basic", "margin", "percent", "%", "effective tax", " rate", "shares outstanding", "weighted-average")

#: Code and row-label keywords; the first code with a keyword in the label counts.
LINE_ITEMS = (
    ("TOTAL_REVENUE", ("total revenues", "total net sales", "total revenue")),
    ("COST_OF_REVENUE", ("total cost of revenues", "cost of revenues", "cost of sales", "cost of revenue")),
    ("GROSS_PROFIT", ("gross profit",)),
    ("RND_EXPENSE", ("research and development",)),
    ("OPERATING_INCOME", ("total operating income", "operating income", "operating profit", "income from operations")),
    ("NET_INCOME", ("net income",)),
    ("OPERATING_CASH_FLOW", ("net cash provided by operating activities", "cash provided by operating activities", "operating activities")),
    ("TOTAL_ASSETS", ("total assets",)),
    ("TOTAL_LIABILITIES", ("total liabilities",)),
)

#: Code and the phrases by which questions name it.
METRIC_PHRASES = (
    ("TOTAL_REVENUE", ("revenue", "revenues", "net sales", "total sales", "top line", "turnover")),
    ("COST_OF_REVENUE", ("cost of revenue", "cost of sales", "cost of goods")),
    ("GROSS_PROFIT", ("gross profit", "gross margin")),
    ("RND_EXPENSE", ("research and development", "r&d", "rnd", "r and d")),
    ("OPERATING_INCOME", ("operating income", "operating profit", "income from operations", "lose money", "lost money", "losing money", "profitable", "profitability")),
    ("NET_INCOME", ("net income", "net earnings", "net profit", "bottom line")),
    ("OPERATING_CASH_FLOW", ("operating cash flow", "cash flow from operations", "cash from operations", "cash provided by operating")),
    ("TOTAL_ASSETS", ("total assets",)),
    ("TOTAL_LIABILITIES", ("total liabilities",)),
)

#: Names of companies in questions.
COMPANY_ALIASES = {
    "apple": "AAPL", "aapl": "AAPL", "iphone": "AAPL",
    "microsoft": "MSFT", "msft": "MSFT", "azure": "MSFT",
    "nvidia": "NVDA", "nvda": "NVDA",
    "amazon": "AMZN", "amzn": "AMZN", "aws": "AMZN",
    "alphabet": "GOOGL", "google": "GOOGL", "googl": "GOOGL", "goog": "GOOGL",
}

VALID_YEARS = ("2023", "2024", "2025", "2026")
RANGE_WORDS = r"(?:to|through|thru|until|-|–|—)"
MAX_SCOPES = 12

#: Questions that ask for reasons; that touch topics told in prose; that ask for the content of prose.
CAUSAL = r"(?i)\b(why|reason|driver|drove|because|due to|explain|contribut|attribut|impact|affect|cause)"
QUALITATIVE = r"(?i)\b(risk|strateg|competit|litigat|regulat|outlook|guidance|describe|discuss|opinion|concern|worried|governance|lawsuit|acquisition|management'?s? view)\b"
DESCRIPTIVE = r"(?i)\b(say[s]? about|describe|discuss|disclose|identif|characteri|cite[s]?|view on|talk about|mention|address(es)?)\b"

#: Section tags and the headings that open them; a heading's blank may be a no-break space.
SECTIONS = (
    ("business", r"Item\s+1[\.\s\u00A0]+Business"),
    ("risk_factors", r"Item\s+1A[\.\s\u00A0]+Risk\s+Factors"),
    ("mda", r"Item\s+7[\.\s\u00A0]+Management"),
    ("market_risk", r"Item\s+7A[\.\s\u00A0]+Quantitative"),
    ("financial_statements", r"Item\s+8[\.\s\u00A0]+Financial\s+Statements"),
)

MIN_PROSE_CHARS, MIN_TABLE_CHARS, LEAD_OTHER_CHARS, TABLE_LOCATE_PREFIX = 100, 20, 200, 60
TABLE_MAX_TOKENS, PROSE_TOKENS, PROSE_OVERLAP, EMBED_LIMIT = 500, 450, 60, 512
RRF_K = 60
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
CACHE_THRESHOLD = 0.97
REFUSAL_TEXT = "I can't answer that from these filings."
FACTS_HEADING = "Structured financial data (exact values from the filing tables):"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
