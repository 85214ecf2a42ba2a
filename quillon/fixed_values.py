"""Values that have to be exactly these for results to agree with existing data.

Nothing in this module is logic. Every constant is stated once, as plain text,
and every other module takes it from here.
"""

# --- fixed values: answer extraction -------------------------------------------------

# Words before which a doubled apostrophe is taken to be a closing quote.
REPAIR_WORDS = (
    "AND", "OR", "NOT", "IN", "LIKE", "IS", "BETWEEN", "FROM", "WHERE", "JOIN",
    "ON", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION",
)

# The characters Python's str.strip() and str.split() treat as white space; Java and RE2
# know fewer under plain \s. Once as a plain string, once as the inside of a character class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Patterns of a fenced block, of a bare SELECT, and of quotes to repair, as Java regular expressions.
_BLANK = f"[{WHITESPACE_CLASS}]"
_REPAIR = "|".join(REPAIR_WORDS)
FENCE = rf"(?isu)```(?:sql)?{_BLANK}*.*?```"
FENCE_TAGGED = r"(?isu)```sql(?![\p{L}\p{N}_]).*?```"
FENCE_HEAD = rf"(?iu)\A```(?:sql)?{_BLANK}*"
BARE_SELECT = r"(?isu)(SELECT\b.+?)(?:;|\n\n|\z)"
BARE_SELECT_CLOSED = rf"(?isu)(SELECT{_BLANK}+.+?;)"
IN_WORD_QUOTE = "(?<=[A-Za-z])'(?=[A-Za-z])"
CLOSING_QUOTE = rf"(?iu)'([^'\n\r]*)''(?={_BLANK}*(?:{_REPAIR}|;|,|\)))"
SPACED_QUOTE = rf"(?iu)(?<=[A-Za-z])'{_BLANK}+(?!(?:{_REPAIR})\b)(?=[A-Za-z])"
CLOSING_QUOTE_OR_END = rf"(?iu)'([^'\n\r]*)''(?={_BLANK}*(?:{_REPAIR}|\n?\z|;|,|\)))"

PREVIEW_LIMIT = 240

# --- fixed values: chat prompts ------------------------------------------------------

SYSTEM_PROMPT = (
    "You are an expert SQLite SQL generator. Your ONLY task is to convert a natural language "
    "question into a **single valid SQLite query** using the provided database schema.\n\n"
    "STRICT RULES:\n"
    "- Output **ONLY** one SQL query wrapped in a ```sql ... ``` code block. Nothing else.\n"
    "- Do NOT write any explanation, prose, comments, Python, or markdown outside the code block.\n"
    "- Do NOT include multiple queries.\n"
    "- Your entire response must be exactly one ```sql ... ``` block.\n\n"
    "SQLITE-SPECIFIC RULES (must follow):\n"
    "- Use **pure SQLite syntax only**. Never use YEAR(), MONTH(), CONTAINS, backticks (`), :: casting, or PARTITION BY.\n"
    "- For year extraction, use strftime('%Y', column_name).\n"
    "- Always use **table aliases** (t1, t2, etc.) and qualify every column: t1.column_name.\n"
    "- Never invent tables or columns that are not in the provided schema.\n"
    "- If you are unsure about a column or join, output a simple safe query instead of guessing.\n"
    "- Use explicit JOIN ... ON syntax. Avoid implicit joins.\n"
    "- Keep queries as simple and correct as possible.\n"
)

SHORT_SYSTEM_PROMPT = (
    "You are an expert SQL assistant. Given a database schema and a natural language "
    "question, write a correct SQL query that answers the question.\n"
    "Return ONLY the SQL query inside a ```sql ... ``` code block."
)

# --- fixed values: sources and file layouts ------------------------------------------

SOURCES = ("spider", "bird")

NOISE_COLUMNS_A = ("query_toks_no_value", "query_toks", "question_toks", "sql")
NOISE_COLUMNS_B = ("difficulty", "evidence", "question_id")

DATABASE_PATHS = {
    "spider": "{root}/spider/spider_data/database/{db_id}/{db_id}.sqlite",
    "bird": "{root}/bird/dev_databases/{db_id}/{db_id}.sqlite",
}

EXAMPLES_A_FILES = ("spider/spider_data/dev.json",)
EXAMPLES_B_FILES = ("bird/dev_20240627/dev.json", "bird/dev_20240627/dev_tied_append.json")
TABLES_JSON_NAME = "dev_tables.json"

SQLITE_SUFFIXES = ("db", "sqlite", "sqlite3", "sqlllite")
SQLITE_MAGIC = "SQLite format 3"

EXCLUDED_DATABASES = ("european_football_2",)

PROMPT_RECORD_COLUMNS = ("prompt", "solution", "schema", "source", "db_id")

# --- fixed values: score weights -----------------------------------------------------

# The configured set, used unless weights are given.
DEFAULT_WEIGHTS = {
    "format": 0.20,
    "exec": 0.40,
    "schema_fidelity": 0.30,
    "sql_fence": 0.10,
    "no_sql_penalty": -1.0,
    "unknown_schema_item_penalty": -0.3,
}

# The set built into the scoring call itself, for runs without a configuration.
BUILT_IN_WEIGHTS = {
    "format": 0.15,
    "exec": 0.50,
    "schema_fidelity": 0.25,
    "sql_fence": 0.10,
    "no_sql_penalty": -2.0,
    "unknown_schema_item_penalty": 0.0,
}

# --- fixed values: token prices (US dollars per million tokens) ----------------------

TOKEN_PRICES = (
    # deployment, per million prompt tokens, per million completion tokens
    ("hosted", 1.25, 10.00),
)

# --- fixed values: SQL words ---------------------------------------------------------

# Words that open a clause; between two of them a comma separates items of one kind.
CLAUSE_WORDS = (
    "SELECT", "FROM", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION",
    "INTERSECT", "EXCEPT", "SET", "VALUES", "RETURNING", "WINDOW", "WITH",
)

# Words directly followed by a table name.
TABLE_WORDS = ("FROM", "JOIN", "INTO", "UPDATE", "TABLE")

# Words that are never a table or column name.
SQL_WORDS = (
    "ALL", "ALTER", "AND", "ANY", "AS", "ASC", "BETWEEN", "BY", "CASE", "CAST", "COLLATE",
    "CREATE", "CROSS", "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "DELETE", "DESC",
    "DISTINCT", "DROP", "ELSE", "END", "ESCAPE", "EXCEPT", "EXISTS", "FALSE", "FETCH",
    "FOLLOWING", "FROM", "FULL", "GLOB", "GROUP", "HAVING", "IN", "INNER", "INSERT",
    "INTERSECT", "INTO", "IS", "ISNULL", "JOIN", "LEFT", "LIKE", "LIMIT", "MATCH", "NATURAL",
    "NOT", "NOTNULL", "NULL", "NULLS", "OFFSET", "ON", "OR", "ORDER", "OUTER", "OVER",
    "PARTITION", "PRAGMA", "PRECEDING", "RANGE", "RECURSIVE", "REGEXP", "REPLACE", "RETURNING",
    "RIGHT", "ROWS", "SELECT", "SET", "TABLE", "THEN", "TRUE", "UNBOUNDED", "UNION", "UNIQUE",
    "UPDATE", "USING", "VALUES", "WHEN", "WHERE", "WINDOW", "WITH",
)

# Words that make the literal after them one of a type, and names elsewhere.
TYPED_LITERAL_WORDS = ("DATE", "TIME", "TIMESTAMP", "INTERVAL")

# Words at the beginning of what TRIM is given, and names elsewhere.
TRIM_WORDS = ("BOTH", "LEADING", "TRAILING")
