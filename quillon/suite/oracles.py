"""The registered queries in plain SQL, written for DuckDB over the same tables."""

from __future__ import annotations

from quillon.fixed_values import (
    BUILT_IN_WEIGHTS, CLAUSE_WORDS, DEFAULT_WEIGHTS, REPAIR_WORDS, SQL_WORDS, SYSTEM_PROMPT, TABLE_WORDS,
    WHITESPACE, WHITESPACE_CLASS,
)
from quillon.operators.conversations import TURN_BYTES
from quillon.suite.golden import ANSWERS, DATABASES, EXPECTED, KNOWN_COLUMNS, KNOWN_TABLES, QUOTED_ANSWERS, STATEMENTS, TABLE_COLUMNS

def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(lit(v) for v in values)


WS = lit(WHITESPACE)
SPLIT_SIZE = 40
CONVERSATION_BYTES = 2000
_S = f"[{WHITESPACE_CLASS}]"
_REPAIR = "|".join(REPAIR_WORDS)


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


# --- views ---------------------------------------------------------------------------

SEGMENTED = """
segmented AS (
  SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
)"""

_TEXTS = "[" + ", ".join(lit(a) for a in ANSWERS) + "]"

COMPLETIONS = f"""
completions AS (
  SELECT o_orderkey AS row_id, CAST(o_orderkey % 16 AS INTEGER) AS k, c_mktsegment AS source,
         CASE WHEN o_orderkey % 64 = 3 THEN 'web' ELSE 'tpch' END AS db_id,
         coalesce(({_TEXTS})[CAST(o_orderkey % 16 AS INTEGER) + 1], '') AS answer
  FROM segmented
)"""

# The tuned run uses the next text on every fifth row.
RUNS = f"""
runs AS (
  SELECT 'baseline' AS run, row_id, k, source, db_id, answer FROM completions
  UNION ALL
  SELECT 'tuned', row_id, j, source, db_id, coalesce(({_TEXTS})[j + 1], '')
  FROM (SELECT *, CASE WHEN row_id % 5 = 0 THEN (k + 1) % 16 ELSE k END AS j FROM completions)
)"""

RAW_EXAMPLES = """
raw_examples AS (
  SELECT (['tpch', 'web', 'missing'])[CAST(o_orderkey % 3 AS INTEGER) + 1] AS db_id,
         '  How many orders have priority ' || o_orderpriority
           || CASE WHEN o_orderkey % 2 = 0 THEN '?' ELSE ' ' END AS question,
         'SELECT COUNT(*) FROM orders WHERE o_orderpriority = ''' || o_orderpriority || '''' AS "SQL",
         CASE WHEN o_orderkey % 4 < 2 THEN 'a' ELSE 'b' END AS source,
         o_orderkey
  FROM orders
)"""

# Questions of the raw examples once stripped and ended.
CLEAN_QUESTION = "rtrim(trim(question), '?') || '?'"

GROUPS = """
groups AS (
  SELECT 'db_' || CAST(c_custkey AS VARCHAR) AS db_id, c_mktsegment AS source, o_orderkey FROM segmented
)"""

DATABASE_COLUMNS = """
database_columns AS (
  SELECT DISTINCT 'db_' || CAST(o_custkey AS VARCHAR) AS db_id,
         CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS table_pos,
         'Orders_' || left(o_orderpriority, 1) AS table_name,
         CAST(o_orderkey % 7 AS INTEGER) * 3
           + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS col_pos,
         CASE o_orderkey % 7 WHEN 3 THEN 'it''s_' WHEN 4 THEN 'say"x"_' WHEN 5 THEN 'both''"_' ELSE 'Col_' END
           || o_orderstatus || '_' || CAST(o_orderkey % 7 AS VARCHAR) AS column_name
  FROM orders
)"""

PLACED_COLUMNS = """
placed_columns AS (
  SELECT db_id, table_name, column_name,
         CAST(dense_rank() OVER (PARTITION BY db_id ORDER BY table_pos) - 1 AS INTEGER) AS table_pos,
         CAST(row_number() OVER (PARTITION BY db_id, table_pos ORDER BY col_pos) - 1 AS INTEGER) AS col_pos
  FROM database_columns
)"""

SCHEMA_TABLES = """
schema_tables AS (
  SELECT db_id, table_pos, table_name, list(column_name ORDER BY col_pos) AS cols
  FROM database_columns GROUP BY db_id, table_pos, table_name
)"""

# Repr-like quoting of a name in a dictionary literal; the test names hold no backslash.
_QUOTED = (
    "CASE WHEN contains({0}, '''') AND NOT contains({0}, '\"') THEN '\"' || {0} || '\"' "
    "WHEN contains({0}, '''') THEN '''' || replace({0}, '''', '\\''') || '''' ELSE '''' || {0} || '''' END"
)

LITERALS = f"""
literals AS (
  SELECT db_id, '{{' || string_agg({_QUOTED.format("table_name")} || ': [' || array_to_string(
           list_transform(cols, lambda c: {_QUOTED.format("c")}), ', ') || ']', ', ' ORDER BY table_pos) || '}}'
         AS literal, count(*) AS tables
  FROM schema_tables GROUP BY db_id
)"""

ROLLOUTS = """
rollouts AS (
  SELECT l_orderkey AS prompt_id, 'db_' || CAST(l_suppkey % 31 AS VARCHAR) AS db_id,
         CAST(CASE WHEN l_orderkey % 7 = 0 THEN 5000 ELSE (l_partkey * 37 + l_linenumber * 101) % 10001 END
              AS BIGINT) AS reward_units
  FROM lineitem
)"""

TOKENS = """
tokens AS (
  SELECT source, CAST(floor(n_chars / 4) AS BIGINT) AS prompt_tokens, doc_id % 200 AS completion_tokens,
         CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'SELECT 1' END AS completion
  FROM documents
)"""

FLAT_METRICS = """
flat_metrics AS (
  SELECT event_id AS step, event_type AS metric, floor(value * 100) AS value FROM events
  UNION ALL SELECT event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events
  UNION ALL SELECT event_id, 'flag', CAST(1 - event_id % 2 AS DOUBLE) FROM events
)"""

# --- extraction, tokens, references --------------------------------------------------

_FENCE = rf"(?is)```(?:sql)?{_S}*(.*?)```"
_SELECT = r"(?is)(SELECT\b.+?)(?:;|\n\n|\z)"
_LITERALS = r"'[^']*'|" + '"[^"]*"' + r"|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
_CLOSED = rf"(?is)(SELECT{_S}+.+?;)"


def _extracted(rows: str) -> str:
    """Extraction steps over a view with ``answer``; look-around is spelled out by captures."""
    return f"""
bare_{rows} AS (
  SELECT *, nullif(trim(CASE WHEN regexp_matches(answer, {lit(_FENCE)}) THEN regexp_extract(answer, {lit(_FENCE)}, 1)
    ELSE regexp_extract(answer, {lit(_SELECT)}, 1) END, {WS}), '') AS bare
  FROM {rows}
),
sql_{rows} AS (
  SELECT *, regexp_replace(
      regexp_replace(regexp_replace(replace(bare, '\\''', ''''''),
        '([A-Za-z])''([A-Za-z])', '\\1''''\\2', 'g'), '([A-Za-z])''([A-Za-z])', '\\1''''\\2', 'g'),
      {lit(rf"(?i)'([^'\n\r]*)''({_S}*(?:{_REPAIR}|;|,|\)))")}, '''\\1''\\2', 'g') AS sql
  FROM bare_{rows}
),
parsed_{rows} AS (
  SELECT *, NOT regexp_matches(
      regexp_replace(sql, {lit(_LITERALS)}, '', 'g'),
      '[''"]') AS tokenizes
  FROM sql_{rows}
)"""


_TOKEN = (
    r"""'[^']*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|[\p{L}_][\p{L}\p{N}_$]*"""
    r"""|[0-9]+(?:\.[0-9]+)?|[<>=!|]+|[^\s]"""
)


def _references(rows: str) -> str:
    """Names and roles per distinct SQL text, from a row per token and windows over them."""
    name = r"regexp_matches({0}, '^[\p{{L}}_\"`]') AND ({0}[1] IN ('\"', '`') OR upper({0}) NOT IN ({1}))"
    is_name = name.format("t", words(SQL_WORDS))
    prev_name = name.format("p1", words(SQL_WORDS))
    return f"""
statements AS (SELECT DISTINCT sql FROM parsed_{rows} WHERE tokenizes),
token_lists AS (
  SELECT sql, list_filter(regexp_extract_all(sql, {lit(_TOKEN)}),
    lambda t: NOT (t LIKE '--%' OR t LIKE '/*%')) AS toks
  FROM statements
),
tokens_at AS (
  SELECT sql, i, toks[i] AS t,
         sum(CASE toks[i] WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY sql ORDER BY i) AS depth
  FROM token_lists, unnest(range(1, len(toks) + 1)) AS u(i)
),
grouped AS (
  SELECT *, max(CASE WHEN t = '(' THEN i END) OVER (PARTITION BY sql, depth ORDER BY i) AS grp FROM tokens_at
),
around AS (
  SELECT *, lag(t) OVER w AS p1, lag(t, 3) OVER w AS p3, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2,
         last_value(CASE WHEN upper(t) IN ({words(CLAUSE_WORDS)}) THEN upper(t) END IGNORE NULLS)
           OVER (PARTITION BY sql, depth, grp ORDER BY i) AS clause
  FROM grouped WINDOW w AS (PARTITION BY sql ORDER BY i)
),
roles AS (
  SELECT sql, i, lower(CASE WHEN t[1] IN ('"', '`') THEN t[2:len(t) - 1] ELSE t END) AS name,
    CASE
      WHEN t = '*' AND p1 = '.' THEN 'column'
      WHEN NOT ({is_name}) OR n1 = '.' THEN NULL
      WHEN upper(p1) IN ({words(TABLE_WORDS)}) OR (p1 = ',' AND clause = 'FROM') THEN 'table'
      WHEN p1 = '.' AND (upper(p3) IN ({words(TABLE_WORDS)}) OR (p3 = ',' AND clause = 'FROM')) THEN 'table'
      WHEN p1 = '.' THEN 'column'
      WHEN n1 = '(' OR (upper(n1) = 'AS' AND n2 = '(') THEN NULL
      WHEN upper(p1) IN ('AS', ')', 'END') OR regexp_matches(p1, '^[''0-9]') OR ({prev_name}) THEN NULL
      ELSE 'column'
    END AS role
  FROM around
),
refs AS (
  SELECT sql, coalesce(list(DISTINCT name) FILTER (WHERE role = 'table'), []) AS ref_tables,
         coalesce(list(DISTINCT name) FILTER (WHERE role = 'column'), []) AS ref_columns
  FROM roles GROUP BY sql
)"""


_CATALOG = " UNION ALL ".join(
    f"SELECT {lit(db)} AS db_id, [{words(names)}] AS schema_tables, "
    f"[{words(c for n in names for c in TABLE_COLUMNS[n].split())}] AS schema_columns"
    for db, names in DATABASES.items()
)

# Whether each text's SQL runs is labelled by hand; everything else is worked out.
_EXEC = "[" + ", ".join("NULL" if e[2] == -1.0 else str(e[2]) for e in EXPECTED) + "]"


def _scored(rows: str, weights: dict[str, float], run_sql: bool = True) -> str:
    w = {k: f"CAST({v!r} AS DOUBLE)" for k, v in weights.items()}
    ran = f"({_EXEC})[k + 1]" if run_sql else "0.0"
    return f"""
catalog AS ({_CATALOG}),
matched AS (
  SELECT p.*, CASE WHEN regexp_matches(answer, {lit(_FENCE)}) THEN 1.0::DOUBLE ELSE 0.0 END AS sql_fence,
         CASE WHEN coalesce(tokenizes, false) THEN 1.0::DOUBLE ELSE 0.0 END AS format,
         CASE WHEN p.sql IS NULL THEN {w["no_sql_penalty"]} ELSE CAST({ran} AS DOUBLE) END AS exec,
         coalesce(ref_tables, []) AS rt, coalesce(ref_columns, []) AS rc, schema_tables, schema_columns
  FROM parsed_{rows} p LEFT JOIN refs ON p.sql = refs.sql LEFT JOIN catalog ON p.db_id = catalog.db_id
),
counted AS (
  SELECT *, len(list_distinct(list_concat(rt, rc))) AS every,
         len(list_distinct(list_concat(list_intersect(rt, schema_tables), list_intersect(rc, schema_columns)))) AS valid
  FROM matched
),
faithful AS (
  SELECT *, CASE WHEN sql IS NULL THEN 0.0::DOUBLE WHEN schema_tables IS NULL OR every = 0 THEN 0.5
    ELSE CAST(valid AS DOUBLE) / every
         + {w["unknown_schema_item_penalty"]} * (1.0::DOUBLE - CAST(valid AS DOUBLE) / every) END AS schema_fidelity
  FROM counted
),
scored AS (
  SELECT *, floor(({w["format"]} * format + {w["exec"]} * exec + {w["schema_fidelity"]} * schema_fidelity
    + {w["sql_fence"]} * sql_fence) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS combined
  FROM faithful
)"""


def _round4(value: str) -> str:
    return f"floor(({value}) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE"


def _units(value: str) -> str:
    return f"CAST(floor({value} * 1e4::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def _mean(total: str, count: str) -> str:
    return f"CAST({total} AS DOUBLE) / 1e4::DOUBLE / CAST({count} AS DOUBLE)"


_DEVIATION = (
    "CASE WHEN {n} > 1 THEN sqrt(CAST(CAST({n} AS HUGEINT) * {sq} - CAST({s} AS HUGEINT) * {s} AS DOUBLE) "
    "/ (CAST({n} AS DOUBLE) * CAST({n} - 1 AS DOUBLE))) END"
)

_BASE = (SEGMENTED, COMPLETIONS)
_PARSED = (*_BASE, _extracted("completions"))
_SCORED = (*_PARSED, _references("completions"), _scored("completions", DEFAULT_WEIGHTS))
_RUN_SCORES = (
    *_BASE, RUNS, _extracted("runs"), _references("runs"), _scored("runs", DEFAULT_WEIGHTS),
    "run_scores AS (SELECT run, row_id, source, combined AS reward FROM scored)",
)
_REPORT = (
    *_RUN_SCORES,
    f"""report AS (
  SELECT run, CASE WHEN grouping(source) = 1 THEN 'overall' ELSE 'source' END AS level,
         CASE WHEN grouping(source) = 1 THEN 'avg' ELSE source END AS source, count(reward) AS rows,
         {_round4(_mean(f"sum({_units('reward')})", "count(reward)"))} AS mean_reward
  FROM run_scores GROUP BY GROUPING SETS ((run, source), (run))
)""",
)


# --- splits --------------------------------------------------------------------------


def _split(
    size: int, train: float = 0.7, val: float = 0.15, seed: int = 42, cap: bool = False, everything: bool = False
) -> tuple[str, ...]:
    quota = "total" if size == -1 else str(size)
    taken = "available" if everything else "least(q, available)"
    n_val = f"CAST(floor(taken * CAST({val} AS DOUBLE)) AS BIGINT)"
    n_val = f"least({n_val}, taken - n_train)" if cap else n_val
    return (
        SEGMENTED, GROUPS,
        "units AS (SELECT db_id, min(source) AS source FROM groups GROUP BY db_id)",
        f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('{seed}:' || db_id), db_id) AS position FROM units
)""",
        """sizes AS (
  SELECT source, count(*) AS available, row_number() OVER (ORDER BY source) AS place,
         count(*) OVER () AS n_sources, sum(count(*)) OVER () AS total
  FROM units GROUP BY source
)""",
        f"""quotas AS (
  SELECT *, CAST({quota} AS BIGINT) // n_sources
            + CASE WHEN place <= CAST({quota} AS BIGINT) % n_sources THEN 1 ELSE 0 END AS q FROM sizes
)""",
        f"takes AS (SELECT source, CAST({taken} AS BIGINT) AS taken FROM quotas)",
        f"""cuts AS (
  SELECT *, greatest(1, {n_val}) AS n_val FROM (
    SELECT *, greatest(1, CAST(floor(taken * CAST({train} AS DOUBLE)) AS BIGINT)) AS n_train FROM takes)
)""",
        """labels AS (
  SELECT db_id, CASE WHEN position <= n_train THEN 'train' WHEN position <= n_train + n_val THEN 'val'
                     ELSE 'test' END AS split
  FROM ranked JOIN cuts USING (source) WHERE position <= taken
)""",
        """labelled AS (
  SELECT o_orderkey, groups.db_id, source, split FROM groups JOIN labels ON groups.db_id = labels.db_id
)""",
    )


_LABELLED = "SELECT o_orderkey, db_id, source, split FROM labelled"

_RECORDS = (
    *_split(-1, everything=True), DATABASE_COLUMNS, SCHEMA_TABLES, LITERALS,
    """records AS (
  SELECT split, labelled.db_id, source, 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey AS solution,
         '### Question' || chr(10) || 'Which order is ' || o_orderkey || '?' || chr(10) || '### Schema' || chr(10)
           || literal AS user_text,
         tables
  FROM labelled JOIN literals ON labelled.db_id = literals.db_id
)""",
)
_SAMPLED_RECORDS = (*_split(SPLIT_SIZE), *_RECORDS[-4:])
_RECORD_DIGEST = "SELECT split, db_id, source, solution, user_text, tables FROM records"

_EXAMPLES = f"""SELECT DISTINCT db_id, {CLEAN_QUESTION} AS question, "SQL", {{source}} AS source FROM raw_examples"""

_CATALOG_LOWER = with_(
    DATABASE_COLUMNS, PLACED_COLUMNS,
    select="SELECT db_id, table_pos, lower(table_name) AS table_name, col_pos, lower(column_name) AS column_name "
    "FROM placed_columns",
)
_NUMBER = "CAST(substring(db_id, 4) AS BIGINT)"

_CANONICAL = f"""
canonical AS (
  SELECT row_id, source, rtrim(array_to_string(list_transform(list_filter(
      regexp_extract_all(sql, {lit(_TOKEN)}), lambda t: NOT (t LIKE '--%' OR t LIKE '/*%')),
    lambda t: CASE WHEN upper(t) IN ({words(SQL_WORDS)}) THEN upper(t) ELSE t END), ' '), '; ') AS canonical
  FROM parsed_completions WHERE sql IS NOT NULL
)"""

_SPACED = f"""
spaced AS (
  SELECT row_id, CASE WHEN regexp_matches(answer, {lit(_FENCE)}) THEN trim(regexp_extract(answer, {lit(_FENCE)}, 1), {WS})
    WHEN regexp_matches(answer, {lit(_CLOSED)}) THEN trim(regexp_extract(answer, {lit(_CLOSED)}, 1), {WS}) END AS sql
  FROM completions
)"""

_USAGE = """
usage AS (
  SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE source END AS source, count(*) AS rows, count(*) FILTER (WHERE len(completion) > 0) AS answered,
         CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
         CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
         CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens
  FROM tokens GROUP BY GROUPING SETS ((source), ())
)"""


def _summary(rows: str, reward: str) -> str:
    quartile = "quantile_cont(u, {0}) / 1e4::DOUBLE"
    return f"""
SELECT n AS count, {_round4(_mean("s", "n"))} AS mean,
       {_round4(_DEVIATION.format(n="n", s="s", sq="sq") + " / 1e4::DOUBLE")} AS std,
       low / 1e4::DOUBLE AS min, {_round4("a")} AS p25, {_round4("b")} AS p50, {_round4("c")} AS p75,
       high / 1e4::DOUBLE AS max
FROM (
  SELECT count(*) AS n, sum(u) AS s, sum(CAST(u AS HUGEINT) * u) AS sq, min(u) AS low, max(u) AS high,
         {quartile.format(0.25)} AS a, {quartile.format(0.5)} AS b, {quartile.format(0.75)} AS c
  FROM (SELECT {reward} AS u FROM {rows})
)"""


def _stated_scores() -> str:
    """Scores of the answers that hold generated statements, from how each answer was made."""
    w = {k: f"CAST({v!r} AS DOUBLE)" for k, v in DEFAULT_WEIGHTS.items()}
    return f"""WITH stated AS ({_stated_references(rounded=False)}),
made AS (
  SELECT doc_id, doc_id % 5 > 0 AS has_sql, CASE WHEN doc_id % 5 = 0 THEN 'no_sql' WHEN doc_id % 6 < 4 THEN 'ok' WHEN doc_id % 6 < 5 THEN 'error'
    ELSE 'not_run' END AS exec_status, schema_fidelity AS f
  FROM stated
),
parts AS (
  SELECT doc_id, exec_status, CASE WHEN has_sql THEN 1.0::DOUBLE ELSE 0.0 END AS form,
    CASE exec_status WHEN 'no_sql' THEN {w["no_sql_penalty"]} WHEN 'ok' THEN 1.0::DOUBLE ELSE 0.0 END AS exec,
    CASE WHEN has_sql THEN f ELSE 0.0::DOUBLE END AS f
  FROM made
)
SELECT doc_id, exec_status, form AS sql_fence, form AS format, exec, {_round4("f")} AS schema_fidelity,
  {_round4(f"{w['format']} * form + {w['exec']} * exec + {w['schema_fidelity']} * f + {w['sql_fence']} * form")} AS combined
FROM parts"""


def _stated_references(rounded: bool = True) -> str:
    """The names that each generated statement was written with; no statement is read."""
    finish = _round4 if rounded else str
    listed = lambda names: "[" + words(names) + "]"
    shapes = ", ".join(
        f"({k}, {listed(t.split())}, {listed(c.split())}, {listed([n for n in t.split() if n in KNOWN_TABLES] + [n for n in c.split() if n in KNOWN_COLUMNS])})"
        for k, (_, t, c) in enumerate(STATEMENTS)
    )
    named = "array_to_string(list_sort(list_transform({0}, lambda n: n || '_' || stem)), ',')"
    share = "CAST(len(known) AS DOUBLE) / len(list_concat(t, c))"
    penalty = f"CAST({DEFAULT_WEIGHTS['unknown_schema_item_penalty']!r} AS DOUBLE)"
    return with_(
        f"shapes(k, t, c, known) AS (VALUES {shapes})",
        "stems AS (SELECT doc_id, lower(coalesce(regexp_extract(text, '[A-Za-z]+', 0), '')) AS stem FROM documents)",
        select=f"""SELECT doc_id, {named.format('t')} AS ref_tables, {named.format('c')} AS ref_columns,
  {finish(f"{share} + {penalty} * (1.0::DOUBLE - {share})")} AS schema_fidelity
FROM stems JOIN shapes ON k = doc_id % {len(STATEMENTS)}""",
    )


def _quoted_extracts() -> str:
    """Both repairing extractions; a quote before a keyword is set aside while spaced ones are doubled."""
    texts = "[" + ", ".join(lit(a) for a in QUOTED_ANSWERS) + "]"
    inner = lambda x: f"regexp_replace({x}, {lit("([A-Za-z])'([A-Za-z])")}, {lit(r"\1''\2")}, 'g')"
    spaced = lambda x: f"regexp_replace({x}, {lit(rf"([A-Za-z])'{_S}+([A-Za-z])")}, {lit(r"\1'' \2")}, 'g')"
    unescaped = f"replace(sql, {lit(chr(92) + chr(39))}, {lit(chr(39) * 2)})"
    before_keyword = lit(rf"(?i)([A-Za-z])'({_S}+(?:{_REPAIR})\b)")
    closing = lit(rf"(?i)'([^'\n\r]*)''({_S}*(?:{_REPAIR}|\z|;|,|\)))")
    return with_(
        f"""quoted AS (
  SELECT doc_id, replace(({texts})[CAST(doc_id % {len(QUOTED_ANSWERS)} AS INTEGER) + 1], '{{w}}',
    lower(coalesce(regexp_extract(text, '[A-Za-z]+', 0), ''))) AS answer
  FROM documents
)""",
        _extracted("quoted"),
        f"""simple AS (
  SELECT doc_id, CASE WHEN regexp_matches(answer, {lit(_FENCE)}) THEN trim(regexp_extract(answer, {lit(_FENCE)}, 1), {WS})
    WHEN regexp_matches(answer, {lit(_CLOSED)}) THEN trim(regexp_extract(answer, {lit(_CLOSED)}, 1), {WS}) END AS sql
  FROM quoted
)""",
        f"""aside AS (
  SELECT doc_id, regexp_replace({inner(inner(unescaped))}, {before_keyword}, '\\1' || chr(1) || '\\2', 'g') AS sql FROM simple
)""",
        f"doubled AS (SELECT doc_id, replace({spaced(spaced('sql'))}, chr(1), '''') AS sql FROM aside)",
        f"closed AS (SELECT doc_id, regexp_replace(sql, {closing}, {lit(chr(39) + chr(92) + '1' + chr(39) + chr(92) + '2')}, 'g') AS spaced FROM doubled)",
        select="SELECT doc_id, p.sql, spaced FROM parsed_quoted p JOIN closed USING (doc_id)",
    )


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["catalog_from_tables_json"] = _CATALOG_LOWER
    sql["catalog_from_sqlite"] = _CATALOG_LOWER + f" WHERE {_NUMBER} % 10 NOT IN (3, 7)"
    sql["catalog_scan_errors"] = with_(
        DATABASE_COLUMNS, select=f"SELECT DISTINCT db_id FROM database_columns WHERE {_NUMBER} % 10 = 7"
    )
    sql["load_catalog"] = sql["parse_schema"] = with_(
        DATABASE_COLUMNS, PLACED_COLUMNS,
        select="SELECT db_id, table_pos, table_name, col_pos, column_name FROM placed_columns",
    )
    sql["write_catalog"] = with_(
        DATABASE_COLUMNS,
        select="SELECT db_id, count(DISTINCT table_pos) AS tables, count(*) AS columns "
        "FROM database_columns GROUP BY db_id",
    )
    sql["load_examples_a"] = with_(RAW_EXAMPLES, select=_EXAMPLES.format(source="source") + " WHERE source = 'a'")
    sql["load_examples_b"] = with_(RAW_EXAMPLES, select=_EXAMPLES.format(source="'b'"))
    sql["read_splits"] = sql["prompt_records"] = with_(*_RECORDS, select=_RECORD_DIGEST)
    sql["prompt_datasets"] = with_(*_SAMPLED_RECORDS, select=_RECORD_DIGEST)
    sql["write_splits"] = with_(
        *_RECORDS, select="SELECT split, source, count(*) AS rows FROM records GROUP BY split, source"
    )
    sql["write_results"] = with_(*_RUN_SCORES, select="SELECT run, row_id, source, reward FROM run_scores")
    metrics = with_(
        *_REPORT,
        select="SELECT run, level, source, run || '_reward_' || source AS metric, mean_reward AS value FROM report",
    )
    sql["write_metrics"] = sql["metric_rows"] = sql["write_metrics_merged"] = metrics

    sql["exclude_groups"] = with_(
        RAW_EXAMPLES, select="SELECT o_orderkey, db_id FROM raw_examples WHERE db_id NOT IN ('web')"
    )
    counts = "SELECT count(*) AS rows, count(*) FILTER (WHERE {0}) AS dropped, count(*) FILTER (WHERE NOT {0}) AS kept FROM {1}"
    sql["exclude_report"] = with_(RAW_EXAMPLES, select=counts.format("db_id = 'web'", "raw_examples"))
    sql["exclude_listed_report"] = with_(SEGMENTED, GROUPS, select=counts.format("source = 'BUILDING'", "groups"))
    sql["exclude_listed_groups"] = with_(
        SEGMENTED, GROUPS,
        select="""SELECT db_id, source, o_orderkey FROM groups g WHERE NOT EXISTS
  (SELECT 1 FROM groups u WHERE u.source = 'BUILDING' AND u.db_id = g.db_id)""",
    )
    counts = " UNION ALL ".join(f"SELECT {lit(d)} AS db_id, {len(t)}::BIGINT AS tables" for d, t in DATABASES.items())
    sql["merge_examples_with_schemas"] = with_(
        RAW_EXAMPLES, f"found AS ({_EXAMPLES.format(source='source')})", f"catalog AS ({counts})",
        select='SELECT found.db_id, question, "SQL", source, tables FROM found JOIN catalog USING (db_id)',
    )
    sql["dedupe_examples"] = "SELECT DISTINCT text, lang, source FROM documents"
    sql["duplicate_count"] = (
        "SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source "
        "FROM documents)) AS duplicates"
    )
    sql["column_counts"] = (
        "SELECT count(doc_id) AS doc_id, count(text) AS text, count(CASE WHEN lang <> 'en' THEN lang END) AS lang, "
        "count(source) AS source FROM documents"
    )
    sql["union_examples"] = with_(
        RAW_EXAMPLES,
        select="""SELECT db_id, question, source, o_orderkey, NULL AS "SQL" FROM raw_examples WHERE source = 'a'
UNION ALL SELECT db_id, question, source, o_orderkey, "SQL" FROM raw_examples WHERE source = 'b'""",
    )
    sql["merge_catalogs"] = with_(
        DATABASE_COLUMNS,
        "named AS (SELECT DISTINCT db_id, table_pos, table_name FROM database_columns)",
        select=f"""SELECT db_id, CASE
    WHEN {_NUMBER} % 4 = 0 THEN min(table_name)
    WHEN {_NUMBER} % 2 = 0 THEN string_agg(table_name, ',' ORDER BY table_pos)
    WHEN {_NUMBER} % 3 = 0 THEN min(table_name)
    ELSE string_agg(table_name, ',' ORDER BY table_pos DESC) END AS tables
FROM named GROUP BY db_id""",
    )

    sql["first_source_per_group"] = (
        "SELECT 'db_' || CAST(o_custkey AS VARCHAR) AS db_id, count(*) AS rows, "
        "arg_min(o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS source "
        "FROM orders GROUP BY o_custkey"
    )
    sql["stratified_split"] = with_(*_split(-1), select=_LABELLED)
    sql["stratified_split_sampled"] = with_(*_split(43, 0.6, 0.2, 7), select=_LABELLED)
    sql["stratified_split_capped"] = with_(*_split(6, 0.6, 0.4, cap=True), select=_LABELLED)
    sql["stratified_split_all"] = with_(*_split(-1, everything=True), select=_LABELLED)
    sql["split_profile"] = with_(
        *_split(-1),
        select="SELECT split, source, count(DISTINCT db_id) AS groups, count(*) AS rows FROM labelled "
        "GROUP BY split, source",
    )
    sql["split_overlap"] = with_(
        *_split(-1),
        select="SELECT db_id, count(DISTINCT split) AS splits FROM labelled GROUP BY db_id "
        "HAVING count(DISTINCT split) > 1",
    )
    sql["missing_from_train"] = with_(
        *_split(3),
        select="""SELECT source, 0::BIGINT AS train_rows FROM groups GROUP BY source
HAVING source NOT IN (SELECT source FROM labelled WHERE split = 'train')""",
    )
    first = "(SELECT o_orderkey, db_id, source, split FROM labelled WHERE split = '{0}' ORDER BY o_orderkey LIMIT {1})"
    sql["quick_sample"] = with_(
        *_split(-1), select=f"{first.format('train', 10)} UNION ALL {first.format('val', 5)}"
    )
    sql["validate_split"] = with_(
        *_RECORDS,
        select="""SELECT 'all' AS label, count(*) AS rows, count(*) FILTER (WHERE user_text IS NULL) AS prompt_nulls,
  count(*) FILTER (WHERE solution IS NULL) AS solution_nulls, count(*) FILTER (WHERE tables IS NULL) AS schema_nulls,
  count(*) FILTER (WHERE source IS NULL) AS source_nulls, count(*) FILTER (WHERE db_id IS NULL) AS db_id_nulls,
  count(*) FILTER (WHERE source NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')) AS unknown_source_rows,
  count(*) FILTER (WHERE source NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')) = 0 AS valid
FROM records""",
    )

    sql["extract_sql"] = with_(*_PARSED, select="SELECT row_id, sql FROM parsed_completions")
    sql["extract_sql_quotes"] = _quoted_extracts()
    sql["extract_sql_simple"] = with_(*_BASE, _SPACED, select="SELECT row_id, sql FROM spaced")
    spaced = (
        *_BASE, _SPACED,
        f"""doubled AS (
  SELECT row_id, regexp_replace(regexp_replace(replace(sql, '\\''', ''''''),
    '([A-Za-z])''([A-Za-z])', '\\1''''\\2', 'g'), '([A-Za-z])''([A-Za-z])', '\\1''''\\2', 'g') AS sql
  FROM spaced
)""",
        f"""closed AS (
  SELECT row_id, regexp_replace(sql,
    {lit(rf"(?i)'([^'\n\r]*)''({_S}*(?:{_REPAIR}|\z|;|,|\)))")}, '''\\1''\\2', 'g') AS sql FROM doubled
)""",
    )
    sql["extract_sql_spaced"] = with_(*spaced, select="SELECT row_id, sql FROM closed")
    sql["score_spaced_extract"] = with_(
        *spaced,
        select=f"""SELECT row_id, sql, CASE WHEN sql IS NULL OR regexp_matches(
  regexp_replace(sql, {lit(_LITERALS)}, '', 'g'), '[''"]') THEN 0.0::DOUBLE ELSE 1.0 END AS format FROM closed""",
    )
    question = f"trim(text, {WS})"
    sql["ensure_question"] = (
        f"SELECT doc_id, CASE WHEN {question} LIKE '%?' THEN {question} ELSE {question} || '?' END AS question "
        "FROM documents"
    )
    sql["preview_text"] = with_(
        f"lines AS (SELECT doc_id, regexp_replace({question}, {lit(_S + '+')}, ' ', 'g') AS line FROM documents)",
        select="SELECT doc_id, CASE WHEN length(line) <= 240 THEN line ELSE substring(line, 1, 240) || '...' END "
        "AS preview FROM lines",
    )
    sql["build_prompts"] = with_(
        RAW_EXAMPLES,
        select=f"""SELECT o_orderkey, 'system' AS first_role, {lit(SYSTEM_PROMPT)} AS system_text, 'user' AS second_role,
  '### Question' || chr(10) || question || CASE WHEN o_orderkey % 5 <> 0
    THEN chr(10) || '### Schema' || chr(10) || 'orders(o_orderkey)' ELSE '' END AS user_text
FROM raw_examples""",
    )
    sql["schema_literal"] = with_(
        DATABASE_COLUMNS, SCHEMA_TABLES, LITERALS, select="SELECT db_id, literal FROM literals"
    )
    sql["serialize_schema"] = with_(
        DATABASE_COLUMNS, SCHEMA_TABLES,
        select="""SELECT db_id, string_agg(table_name || '(' || array_to_string(cols, ', ') || ')', ' | '
  ORDER BY table_pos) AS text FROM schema_tables GROUP BY db_id""",
    )
    sql["last_message"] = "SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id"
    sql["chat_messages"] = (
        "SELECT conv_id, turn, 1::BIGINT AS n, role, text AS content FROM conversations"
    )
    sql["chat_conversations"] = f"""WITH turns AS (
  SELECT *, CAST(coalesce(sum(strlen(coalesce(text, '')) + {TURN_BYTES}) OVER (
      PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM conversations)
SELECT conv_id, ahead // {CONVERSATION_BYTES} AS chunk, count(*) AS n, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
  md5(string_agg(text, chr(31) ORDER BY turn, role, text)) AS content_md5
FROM turns GROUP BY conv_id, ahead // {CONVERSATION_BYTES}"""
    sql["canonical_sql"] = with_(*_PARSED, _CANONICAL, select="SELECT row_id, canonical FROM canonical")
    sql["distinct_completions"] = with_(
        *_PARSED, _CANONICAL,
        select="SELECT source, canonical, count(*) AS rows FROM canonical GROUP BY source, canonical",
    )

    sql["score_fence"] = with_(*_SCORED, select="SELECT row_id, sql_fence FROM scored")
    sql["score_fence_strict"] = with_(
        *_BASE,
        select=f"""SELECT row_id, CASE WHEN regexp_matches(answer, '(?is)```sql\\b.*?```') THEN 1.0::DOUBLE
  ELSE 0.0 END AS sql_fence FROM completions""",
    )
    sql["score_format"] = with_(*_SCORED, select="SELECT row_id, format FROM scored")
    sql["score_exec"] = sql["score_exec_once"] = with_(
        *_SCORED,
        select="""SELECT row_id, exec, CASE WHEN sql IS NULL THEN 'no_sql' WHEN exec = 1 THEN 'ok' ELSE 'error' END
  AS exec_status FROM scored""",
    )
    sql["score_exec_varied"] = with_(
        SEGMENTED,
        select="""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'ok' END AS exec_status,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS exec FROM segmented""",
    )
    sql["schema_refs"] = with_(
        *_SCORED,
        select="SELECT row_id, array_to_string(list_sort(rt), ',') AS ref_tables, "
        "array_to_string(list_sort(rc), ',') AS ref_columns FROM scored",
    )
    sql["schema_refs_by_scope"] = _stated_references()
    sql["score_statements"] = _stated_scores()
    sql["score_fidelity"] = with_(*_SCORED, select="SELECT row_id, schema_fidelity FROM scored")
    sql["score_combined"] = with_(*_SCORED, select="SELECT row_id, combined FROM scored")
    sql["score_combined_built_in_weights"] = with_(
        *_PARSED, _references("completions"), _scored("completions", BUILT_IN_WEIGHTS),
        select="SELECT row_id, combined FROM scored",
    )
    sql["score_completions"] = sql["score_stream"] = with_(
        *_SCORED,
        select="SELECT row_id, source, db_id, sql_fence, format, exec, schema_fidelity, combined FROM scored",
    )
    sql["score_completions_static"] = with_(
        *_PARSED, _references("completions"), _scored("completions", DEFAULT_WEIGHTS, run_sql=False),
        select="SELECT row_id, sql_fence, format, schema_fidelity, combined FROM scored",
    )
    sql["custom_scorer"] = with_(
        *_PARSED,
        """named AS (
  SELECT row_id, CASE WHEN coalesce(tokenizes, false) THEN 1.0::DOUBLE ELSE 0.0 END AS format,
         CASE WHEN length(answer) <= 60 THEN 1.0::DOUBLE ELSE 0.25 END AS brevity,
         CASE WHEN contains(answer, ';') THEN 0.0::DOUBLE ELSE 1.0 END AS no_semicolon
  FROM parsed_completions
)""",
        select="SELECT *, "
        + _round4("0.5::DOUBLE * format + 0.3::DOUBLE * brevity + 0.2::DOUBLE * no_semicolon")
        + " AS combined FROM named",
    )

    sql["reward_report"] = with_(*_REPORT, select="SELECT run, level, source, rows, mean_reward FROM report")
    sql["reward_summary"] = with_(
        *_SCORED, select=_summary("scored", _units("combined"))
    )
    sql["rollout_summary"] = with_(ROLLOUTS, select=_summary("rollouts", "reward_units"))
    means = {
        run: _mean(
            f"sum({_units('reward')}) FILTER (WHERE run = '{run}')", f"count(reward) FILTER (WHERE run = '{run}')"
        )
        for run in ("baseline", "tuned")
    }
    sql["compare_runs"] = with_(
        *_RUN_SCORES,
        f"""means AS (
  SELECT CASE WHEN grouping(source) = 1 THEN 'avg' ELSE source END AS source, {means["baseline"]} AS b, {means["tuned"]} AS t
  FROM run_scores GROUP BY GROUPING SETS ((source), ())
)""",
        select=f"""SELECT source, {_round4("b")} AS baseline_mean, {_round4("t")} AS tuned_mean,
  {_round4("t - b")} AS change, {_round4("(t - b) * 100.0::DOUBLE / b")} AS change_pct,
  {_round4("t * 100.0::DOUBLE / b")} AS reference_pct FROM means""",
    )
    sql["token_usage"] = with_(
        TOKENS, _USAGE,
        select="SELECT source, rows, answered, prompt_tokens, completion_tokens, total_tokens FROM usage",
    )
    sql["token_cost"] = with_(
        TOKENS, _USAGE,
        "prices AS (SELECT * FROM (VALUES ('hosted', 1.25::DOUBLE, 10.0::DOUBLE), "
        "('small', 0.15::DOUBLE, 0.6::DOUBLE)) v(deployment, p, c))",
        "priced AS (SELECT *, prompt_tokens * p + completion_tokens * c AS micro FROM usage, prices)",
        select="""SELECT source, deployment, floor(micro / 1e6::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS cost,
  floor(micro / 1e6::DOUBLE / rows * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS cost_per_call,
  floor(micro / 1e6::DOUBLE / rows * 1e4::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS cost_per_day,
  floor(micro / 1e6::DOUBLE / rows * 3e5::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS cost_per_month
FROM priced""",
    )
    scale = "CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1e6::DOUBLE WHEN 2 THEN -1e3::DOUBLE ELSE 1e-3::DOUBLE END"
    sql["metric_summary"] = with_(
        FLAT_METRICS,
        f"every AS (SELECT metric, value FROM flat_metrics UNION ALL SELECT 'raw_' || event_type, value * {scale} FROM events)",
        select=f"""SELECT metric, count(*) AS count, {_round4("avg(value)")} AS mean, {_round4("stddev_samp(value)")} AS std,
  {_round4("min(value)")} AS min, {_round4("quantile_cont(value, 0.25)")} AS p25, {_round4("quantile_cont(value, 0.5)")} AS p50,
  {_round4("quantile_cont(value, 0.75)")} AS p75, {_round4("max(value)")} AS max
FROM every GROUP BY metric""",
    )
    sql["flatten_metrics"] = sql["flatten_metrics_stream"] = sql["flatten_metrics_merged_stream"] = with_(
        FLAT_METRICS, select="SELECT step, metric, value FROM flat_metrics"
    )
    sql["reward_crossings"] = with_(
        FLAT_METRICS,
        select="""SELECT level, min(step) FILTER (WHERE metric = 'k' AND value >= level) AS first_step
FROM flat_metrics, (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (98.0::DOUBLE), (1000.0::DOUBLE)) v(level) GROUP BY level""",
    )
    sql["group_advantage"] = with_(
        ROLLOUTS,
        f"""stats AS (
  SELECT prompt_id, CAST(s AS DOUBLE) / n AS mean, {_DEVIATION.format(n="n", s="s", sq="sq")} AS std
  FROM (SELECT prompt_id, count(*) AS n, sum(reward_units) AS s, sum(CAST(reward_units AS HUGEINT) * reward_units) AS sq
        FROM rollouts GROUP BY prompt_id)
)""",
        select="""SELECT r.prompt_id, db_id, reward_units,
  CASE WHEN coalesce(std, 0) > 0 THEN (CAST(reward_units AS DOUBLE) - mean) / std ELSE 0.0::DOUBLE END AS advantage
FROM rollouts r JOIN stats ON r.prompt_id = stats.prompt_id""",
    )
    sql["zero_variance_groups"] = with_(
        ROLLOUTS,
        "ranges AS (SELECT db_id, prompt_id, min(reward_units) AS a, max(reward_units) AS b FROM rollouts "
        "GROUP BY db_id, prompt_id)",
        select="""SELECT db_id, count(*) AS groups, count(*) FILTER (WHERE a = b) AS flat_groups,
  CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS flat_share
FROM ranges GROUP BY db_id""",
    )
    return sql
