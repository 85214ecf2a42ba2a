"""Sixteen answer texts with their expected scores, under the default weights."""

from __future__ import annotations

# --- fixed values: answer texts, and what each must score ----------------------------


def _fenced(sql: str, tag: str = "sql") -> str:
    return f"```{tag}\n{sql}\n```"


ANSWERS = (
    _fenced("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT';"),
    _fenced("SELECT COUNT(*) FROM customer", tag=""),
    "The answer is SELECT c_name FROM customer;",
    "I cannot answer that.",
    "```sql\n```",
    "```sql\n" + _fenced("SELECT 1") + "\n```",
    _fenced("print(1)", tag="python"),
    _fenced("SELECT o_ghost FROM orders"),
    _fenced("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F"),
    _fenced("SELECT 1"),
    _fenced(
        "SELECT c.c_mktsegment, SUM(o.o_totalprice) AS total FROM customer c JOIN orders o "
        "ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment ORDER BY total DESC"
    ),
    _fenced("DELETE FROM orders"),
    _fenced("SELECT c_custkey FROM customer WHERE c_name = 'O\\'Gallagher'"),
    _fenced("SELECT c_custkey FROM customer WHERE c_name = 'x' OR c_mktsegment = '' AND c_nationkey = 1"),
    _fenced("SELECT 1; SELECT 2"),
    None,  # no message at all
)

# fence, format, exec, fidelity, combined
EXPECTED = (
    (1.0, 1.0, 1.0, 1.0, 1.0),
    (1.0, 1.0, 1.0, 1.0, 1.0),
    (0.0, 1.0, 1.0, 1.0, 0.9),
    (0.0, 0.0, -1.0, 0.0, -0.4),
    (1.0, 0.0, -1.0, 0.0, -0.3),
    (1.0, 0.0, -1.0, 0.0, -0.3),
    (1.0, 1.0, 0.0, -0.3, 0.21),
    (1.0, 1.0, 0.0, 0.35, 0.405),
    (1.0, 0.0, 0.0, 0.5, 0.25),
    (1.0, 1.0, 1.0, 0.5, 0.85),
    (1.0, 1.0, 1.0, 0.8143, 0.9443),
    (1.0, 1.0, 0.0, 1.0, 0.6),
    (1.0, 1.0, 1.0, 1.0, 1.0),
    (1.0, 0.0, 0.0, 0.5, 0.25),
    (1.0, 1.0, 0.0, 0.5, 0.45),
    (0.0, 0.0, -1.0, 0.0, -0.4),
)

# The test tables, by the database an answer may be about.
DATABASES = {
    "tpch": ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"),
    "web": ("events", "documents", "pages", "conversations", "benchmark", "labels"),
}

# Columns of the test tables, as stated for them.
TABLE_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "conversations": "conv_id turn role text",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
}

# --- fixed values: answers whose quotes need repair, with a place for a word ------------

QUOTED_ANSWERS = (
    _fenced("SELECT name FROM {w} WHERE owner = 'the boys' {w} house' AND x = 'abc';"),
    _fenced("SELECT * FROM {w} WHERE a = 'x' AND b = 'y'  or c = 'z'"),
    "SELECT {w} FROM t WHERE note = 'it\\'s {w}' and done = 'no'; and more",
    "I think: SELECT a FROM {w} WHERE b = 'don't' LIMIT 5; done",
    _fenced("SELECT 'p' {w}, 'q' r FROM t WHERE k = 'm''", tag=""),
    "No query, but {w}' {w} and ``` {w}",
    _fenced("SELECT a FROM {w} WHERE b = 'girls' toys' {w}' ORDER BY 'c'' ;") + " ; SELECT 1;",
)

# --- fixed values: statement shapes, and the names each holds --------------------------

# SQL with placeholders for names, then the placeholders that stand for tables and for columns.
STATEMENTS = (
    ("SELECT {c1}, {c2} FROM {t1} WHERE {c3} > 1", "t1", "c1 c2 c3"),
    ("SELECT {c1} FROM ({t1} JOIN {t2} ON {t1}.{c2} = {t2}.{c3})", "t1 t2", "c1 c2 c3"),
    ("SELECT x.{c1} FROM (({t1} a JOIN {t2} b ON a.{c2} = b.{c2}), {t3}) x, {t4}", "t1 t2 t3 t4", "c1 c2"),
    ("SELECT {c1} FROM {t1} ORDER BY {c2} COLLATE NOCASE, {c3} DESC", "t1", "c1 c2 c3"),
    ("SELECT {c1} FROM {t1} WHERE {c2} IS DISTINCT FROM {c3} AND {c4} IS NOT DISTINCT FROM 2", "t1", "c1 c2 c3 c4"),
    ("SELECT sum({c1}) OVER {b1} FROM {t1} WINDOW {b1} AS (PARTITION BY {c2} ORDER BY {c3})", "t1", "c1 c2 c3"),
    ("SELECT rank() OVER ({b1} ORDER BY {c1}) FROM {t1}, {t2} WINDOW {b1} AS (PARTITION BY {c2}), {b2} AS ({b1})", "t1 t2", "c1 c2"),
    ("SELECT avg({c1}) OVER (ORDER BY {c2} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) FROM {t1}", "t1", "c1 c2"),
    ("SELECT EXTRACT(year FROM {c1}), EXTRACT(month FROM {t1}.{c2}) FROM {t1} JOIN {t2} USING ({c3})", "t1 t2", "c1 c2 c3"),
    ("SELECT substring({c1} FROM 2 FOR 3), trim(BOTH 'x' FROM {c2}) FROM {t1}", "t1", "c1 c2"),
    ("WITH {b1}({b2}, {b3}) AS (SELECT {c1}, {c2} FROM {t1}) SELECT {c3} FROM {b1}", "t1 b1", "c1 c2 c3"),
    ("WITH {b1} AS (SELECT {c1} FROM {t1}, {t2}), {b2} AS MATERIALIZED (SELECT {c2} FROM {b1}) SELECT * FROM {b1}, {b2}", "t1 t2 b1 b2", "c1 c2"),
    ("INSERT INTO {t1} ({b1}, {b2}) SELECT {c1}, {c2} FROM {t2}", "t1 t2", "c1 c2"),
    ("SELECT {b1}.{c1} FROM (VALUES (1, 2)) AS {b1}({b2}, {b3}) JOIN main.{t1} ON {b1}.{c1} = {c2}", "t1", "c1 c2"),
    ("SELECT {c1} FROM {b1}({c2}, 'FROM {b2}') z, {t1} /* , {b3} */", "t1", "c1 c2"),
    ("SELECT count(*) FILTER (WHERE {c1} > 1), date '2020-01-01', {c2} FROM {t1} -- , {b1}", "t1", "c1 c2"),
    ("SELECT {c1}, (SELECT max({c2}) FROM {t2} WHERE {t2}.{c3} = {t1}.{c3}) {b1} FROM {t1} WHERE EXISTS (SELECT 1 FROM {t3})", "t1 t2 t3", "c1 c2 c3"),
    ("SELECT {c1} FROM {t1} WHERE ({c2}, {c3}) IN (SELECT {c4}, lower({c5}) FROM ({t2})) AND {c6} = 1", "t1 t2", "c1 c2 c3 c4 c5 c6"),
    ("UPDATE {t1} SET {c1} = {c2} + (SELECT min({c3}) FROM {t2}, {t3})", "t1 t2 t3", "c1 c2 c3"),
    ("SELECT CAST({c1} AS DECIMAL(10, 2)) {b1}, CASE WHEN {c2} = 1 THEN 2 END {b2} FROM {t1} {b3}", "t1", "c1 c2"),
    ('SELECT "{c1}", `{c2}` AS {b1} FROM "{t1}" AS {b2} LEFT JOIN {t2} ON {b2}.{c3} = 1, {t3} GROUP BY {c4}', "t1 t2 t3", "c1 c2 c3 c4"),
    ("SELECT DISTINCT {c1} FROM {t1}; SELECT {c2} FROM {t2}", "t1 t2", "c1 c2"),
    ("SELECT {c1} FROM a.b.{t1} UNION SELECT {c2} FROM b.{t2} {b1}, c.{t3}", "t1 t2 t3", "c1 c2"),
)

# A third of the names of a statement are unknown to the schema it is judged by.
KNOWN_TABLES = ("t1", "t2")
KNOWN_COLUMNS = ("c1", "c2", "c3")
