"""Finding SQL in an answer, and reading names out of SQL text, without a parser.

All functions work on whole texts. Patterns avoid repeated groups, so the regular
expression engine needs no stack depth that grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.fixed_values import (
    BARE_SELECT, BARE_SELECT_CLOSED, CLAUSE_WORDS, CLOSING_QUOTE, CLOSING_QUOTE_OR_END, FENCE, FENCE_HEAD, FENCE_TAGGED, IN_WORD_QUOTE,
    SPACED_QUOTE, SQL_WORDS, TRIM_WORDS, TYPED_LITERAL_WORDS,
)
from quillon.functions.text import strip


def fence_block(text: Column) -> Column:
    """The first fenced block with its fences, or ''. One scan serves all that follows."""
    return F.regexp_extract(text, FENCE, 0)


def has_fence(text: Column, strict: bool = False) -> Column:
    """Whether a fenced block is there; ``strict`` wants the ``sql`` tag on a fence."""
    return text.rlike(FENCE_TAGGED) if strict else fence_block(text) != ""


def _fence_body(block: Column) -> Column:
    inner = F.substring(block, F.lit(1), F.char_length(block) - 3)
    return F.regexp_replace(inner, FENCE_HEAD, "")


def _repair_quotes(sql: Column) -> Column:
    sql = F.replace(sql, F.lit("\\'"), F.lit("''"))
    return F.regexp_replace(sql, IN_WORD_QUOTE, "''")


def unrepaired_sql(text: Column, block: Column) -> Column:
    """Stripped SQL of an answer whose :func:`fence_block` is already at hand, or ''."""
    raw = F.when(block != "", _fence_body(block)).otherwise(F.regexp_extract(text, BARE_SELECT, 1))
    return strip(raw)


def repaired_sql(bare: Column) -> Column:
    """:func:`unrepaired_sql`, held in a column, with its quotes repaired; '' gives null."""
    repaired = F.regexp_replace(_repair_quotes(bare), CLOSING_QUOTE, "'$1'")
    return F.when(F.contains(bare, F.lit("'")), repaired).when(bare != "", bare)


def extract_sql(text: Column) -> Column:
    """First fenced block, else a bare SELECT up to ``;``, a blank line or the end.

    Stripped; empty gives null; then backslash quotes become doubled quotes, quotes inside
    words are doubled, and a doubled quote before a keyword or delimiter is a closing one.
    """
    return repaired_sql(unrepaired_sql(text, fence_block(text)))


def extract_sql_simple(text: Column) -> Column:
    """First fenced block, else ``SELECT ... ;``; no repairs, and an empty fence gives ''."""
    block = fence_block(text)
    bare = F.nullif(F.regexp_extract(text, BARE_SELECT_CLOSED, 1), F.lit(""))
    return F.when(block != "", strip(_fence_body(block))).when(F.contains(text, F.lit(";")), strip(bare))


def extract_sql_spaced(text: Column) -> Column:
    """As :func:`extract_sql_simple`, with repairs that also know spaced apostrophes and
    a doubled quote at the end of the text."""
    sql = _repair_quotes(extract_sql_simple(text))
    sql = F.regexp_replace(sql, SPACED_QUOTE, "'' ")
    return F.regexp_replace(sql, CLOSING_QUOTE_OR_END, "'$1'")


# --- reading SQL text ----------------------------------------------------------------

_COMMENT = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_LITERALS_AND_COMMENTS = rf"'[^']*'|\"[^\"]*\"|{_COMMENT}"
_TOKEN = (
    rf"'[^']*'|\"[^\"]*\"|`[^`]*`|{_COMMENT}"
    r"|[\p{L}_][\p{L}\p{N}_$]*|[0-9]+(?:\.[0-9]+)?|[<>=!|]+|[^\s]"
)


def tokenizes(sql: Column) -> Column:
    """Whether every quote is closed once literals, quoted names and comments are removed."""
    has_quotes = F.contains(sql, F.lit("'")) | F.contains(sql, F.lit('"'))
    left_over = F.regexp_replace(sql, _LITERALS_AND_COMMENTS, "").rlike("['\"]")
    return F.when(has_quotes, ~left_over).when(sql.isNotNull(), True)


def sql_tokens(sql: Column) -> Column:
    """Tokens in order, comments left out."""
    tokens = F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))
    may_have_comments = F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*"))
    return F.when(
        may_have_comments, F.filter(tokens, lambda t: ~(t.startswith("--") | t.startswith("/*")))
    ).otherwise(tokens)


def canonical_sql(sql: Column) -> Column:
    """A text for comparing SQL: no comments, tokens set apart by single blanks outside
    literals, keywords in upper case, no trailing semicolons."""
    tokens = F.transform(
        sql_tokens(sql), lambda t: F.when(F.upper(t).isin(*SQL_WORDS), F.upper(t)).otherwise(t)
    )
    return F.rtrim(F.array_join(tokens, " "), F.lit("; "))


_MARKED_WORDS = {
    "FROM": "F", "JOIN": "T", "INTO": "I", "UPDATE": "I", "TABLE": "I", "SELECT": "S", "VALUES": "S", "WITH": "W", "WINDOW": "N",
    "DISTINCT": "D", "COLLATE": "L", "OVER": "V", "ROWS": "R", "RANGE": "R", "GROUPS": "R", "AS": "A", "END": "E", "EXTRACT": "X",
}


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def token_line(tokens: str) -> Column:
    """The tokens as one string with a character for the kind of each, so that the rules below compare single characters.

    ``F`` FROM, ``T`` JOIN, ``I`` INTO, UPDATE, TABLE, ``S`` a word that opens a query in parentheses, ``W`` WITH, ``N`` WINDOW, ``C`` another clause
    word, ``D`` DISTINCT, ``L`` COLLATE, ``V`` OVER, ``R`` a word that opens a window frame, ``A`` AS, ``E`` END, ``X`` EXTRACT before its parenthesis,
    ``k`` any other keyword, ``n`` a name, ``l`` a literal or number, ``. , ( ) *`` themselves, ``o`` anything else.
    """
    words = "".join(f"WHEN w = '{word}' THEN '{mark}' " for word, mark in _MARKED_WORDS.items())
    kinds = f"""
        transform(transform({tokens}, t -> upper(t)), w -> CASE
            WHEN left(w, 1) IN ('.', ',', '(', ')', '*') THEN left(w, 1)
            WHEN left(w, 1) IN ('"', '`') THEN 'n'
            {words}
            WHEN w IN ({_listed(TYPED_LITERAL_WORDS)}) THEN 'i'
            WHEN w IN ({_listed(TRIM_WORDS)}) THEN 'b'
            WHEN w IN ({_listed(CLAUSE_WORDS)}) THEN 'C'
            WHEN w IN ({_listed(SQL_WORDS)}) THEN 'k'
            WHEN left(w, 1) RLIKE r'[\\p{{L}}_]' THEN 'n'
            WHEN left(w, 1) RLIKE "['0-9]" THEN 'l'
            ELSE 'o' END)"""
    line = F.array_join(F.expr(kinds), "")
    # Words that are names unless their neighbours say otherwise.
    settled = F.regexp_replace(line, r"(?<=\()b(?![,.)])|i(?=l)", "k")
    return F.translate(F.regexp_replace(settled, r"X(?!\()", "n"), "ib", "nn")


def scoped_line(line: str) -> Column:
    """The line with its parentheses told apart, by a left fold that keeps a stack of scopes.

    A scope is what the last clause word of an open parenthesis makes of it, or what the parenthesis is: ``F`` a list of tables
    (after FROM, or a parenthesis where a table is due that holds no query), ``W`` a list of WITH names, ``N`` a list of windows, ``f`` arguments of a function
    (``X``: of EXTRACT), ``l`` a list of names (columns of a target, an alias or a WITH name), ``w`` a window, ``q`` its frame, ``-`` anything else.

    In the result ``;`` is a comma and ``<`` a parenthesis with a table after it, ``{`` opens a list of names, ``k`` is a FROM that is no clause, and ``x``
    a name that binds something or refers to a window, a unit or a frame, and so is no reference.

    Marks are put together in pieces of about the square root of the length, as a fold that only ever
    added to one text would copy it once per token. Lines without a parenthesis, a list or a binding word need no fold.
    """
    previous, following, before = "get(c, i - 1)", "get(c, i + 1)", "get(c, i - 2)"
    tokens = f"transform({line}_c, (k, i) -> struct(k, coalesce({previous}, '') AS p, coalesce({following}, '') AS n, coalesce({before}, '') AS pp))"
    tokens = tokens.replace("get(c,", f"get({line}_c,")
    due = "(s.top = 'F' AND t.p IN ('F', 'T', ',', '(') OR t.p = 'T')"  # a table is due here
    named_list = "(s.head = 'I' OR s.head = 'A' OR s.top = 'W' OR s.top = 'F' AND t.pp IN ('n', ')'))"
    opened = f"""CASE
        WHEN t.n IN ('S', 'W') THEN '-'
        WHEN t.p = 'X' THEN 'X'
        WHEN t.p = 'n' THEN CASE WHEN {named_list} THEN 'l' ELSE 'f' END
        WHEN t.p = 'V' OR t.p = 'A' AND s.top = 'N' THEN 'w'
        WHEN {due} THEN 'F'
        ELSE '-' END"""
    top = f"""CASE
        WHEN t.k = '(' THEN {opened}
        WHEN t.k = ')' THEN CASE WHEN s.under = '' THEN '-' ELSE right(s.under, 1) END
        WHEN t.k = 'S' THEN '-'
        WHEN s.top IN ('f', 'X', 'l', 'q') THEN s.top
        WHEN s.top = 'w' THEN CASE WHEN t.k = 'R' THEN 'q' ELSE 'w' END
        WHEN t.k = 'F' THEN CASE WHEN t.p = 'D' THEN s.top ELSE 'F' END
        WHEN t.k IN ('W', 'N') THEN t.k
        WHEN t.k = 'C' THEN '-'
        ELSE s.top END"""
    under = """CASE
        WHEN t.k = '(' THEN concat(s.under, s.top)
        WHEN t.k = ')' AND s.under <> '' THEN left(s.under, char_length(s.under) - 1)
        ELSE s.under END"""
    mark = f"""CASE
        WHEN t.k = ',' AND s.top = 'F' THEN ';'
        WHEN t.k = '(' AND t.p = 'n' AND t.n <> 'S' AND {named_list} THEN '{{'
        WHEN t.k = '(' AND t.n NOT IN ('S', 'W') AND t.p NOT IN ('n', 'X', 'V') AND {due} THEN '<'
        WHEN t.k = 'F' AND (s.top IN ('f', 'X', 'l', 'w', 'q') OR t.p = 'D') THEN 'k'
        WHEN t.k = 'n' AND (s.top IN ('W', 'N', 'l', 'q') OR s.top IN ('w', 'X') AND t.p = '(') THEN 'x'
        WHEN t.k = 'X' AND s.top IN ('W', 'N', 'l', 'q') THEN 'x'
        ELSE t.k END"""
    full = f"octet_length(s.piece) * octet_length(s.piece) > size({line}_c)"
    folded = f"""
        aggregate({tokens}, struct('-' AS top, '' AS under, '' AS head, '' AS done, '' AS piece),
            (s, t) -> struct({top} AS top, {under} AS under, CASE WHEN t.k IN ('n', '.') THEN s.head ELSE t.k END AS head,
                CASE WHEN {full} THEN concat(s.done, s.piece) ELSE s.done END AS done,
                CASE WHEN {full} THEN {mark} ELSE concat(s.piece, {mark}) END AS piece),
            s -> concat(s.done, s.piece))"""
    return F.expr(f"CASE WHEN {line} RLIKE '[(WN]|F.*,|DF' THEN {folded} ELSE {line} END")


def name_roles(line: Column) -> Column:
    """One mark per token of a :func:`scoped_line`: ``t`` a table, ``c`` a column, anything else no reference.

    The rules read a name's neighbours, which are characters of the line, so each group of
    them is one replacement. First that fits: before ``.`` a qualifier; where a table is due, and not before ``(``,
    a table, as is the last of names with dots that stand there; after ``.`` a column; before ``(`` a function; after AS, ``)``, END, a
    name or a literal an alias; after COLLATE or OVER no reference; else a column. ``t.*`` is a column ``*``.

    Known limits: keywords used as names, vendor syntax.
    """
    due = "FTI;<"
    starts = "|".join(f"(?<=[{due}]{'n.' * depth})".replace("n.", r"n\.") for depth in range(4))
    tables = F.regexp_replace(line, rf"(?:{starts})n(?![.(])", "t")
    qualified = F.regexp_replace(tables, r"(?<=\.)(?:n(?![.(])|\*)", "c")
    marked = F.regexp_replace(qualified, r"(?<![.A)EnlxtcLV])n(?![.({]|A\()", "c")
    return F.split(marked, "")


def names_with_mark(tokens: str, marks: str, mark: str) -> Column:
    """Distinct names with one mark, lower-cased and without their quotes."""
    return F.expr(f"""
        array_distinct(transform(
            filter({tokens}, (t, i) -> get({marks}, i) = '{mark}'),
            t -> lower(CASE WHEN left(t, 1) IN ('"', '`') THEN substring(t, 2, char_length(t) - 2) ELSE t END)))""")
