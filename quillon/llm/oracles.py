"""The operators' answers in DuckDB SQL, written from the definitions and not from the methods."""

from __future__ import annotations

_COMPONENTS = """
reach(id, other, depth) AS (
    SELECT id, id, 0 FROM nodes
    UNION
    SELECT r.id, e.b, 0 FROM reach r JOIN edges e ON r.other = e.a
),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

_OP1 = rf"""
WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN w IS NULL OR len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
    FROM words),
nodes AS (SELECT doc_id AS id FROM sets),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS o
    FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * o >= 75 * (na + nb - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS}
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN comp ON doc_id = id
"""

_OP2 = f"""
WITH RECURSIVE
good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
      AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
edges AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
links AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
{_COMPONENTS}
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept
FROM comp LEFT JOIN links ON id = a
"""

_OP4 = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
flat AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS r FROM raw),
nb AS (
    SELECT doc_id, r, line, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS i,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
    FROM flat WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (
    SELECT y.doc_id AS d, y.i AS i, y.w AS w, x.doc_id AS e, y.i - x.i AS off FROM nb x JOIN nb y
    ON x.line = y.line AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.i < y.i)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY d, e, off ORDER BY i) AS g FROM pairs),
runs AS (SELECT d, e, off, g, min(i) AS a, max(i) AS b FROM islands GROUP BY ALL HAVING sum(w) >= 50),
gone AS (SELECT DISTINCT nb.doc_id, nb.r FROM runs JOIN nb ON nb.doc_id = d AND i BETWEEN a AND b),
marked AS (
    SELECT f.doc_id, f.r, f.line, nb.r IS NOT NULL AS has_words, g.r IS NOT NULL AS goes,
        CASE WHEN nb.r IS NOT NULL THEN g.r IS NOT NULL END AS state
    FROM flat f LEFT JOIN nb USING (doc_id, r) LEFT JOIN gone g USING (doc_id, r)),
around AS (
    SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        first_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
        lag(state) OVER (PARTITION BY doc_id ORDER BY r) AS just_before
    FROM marked),
kept AS (
    SELECT doc_id, count(*) FILTER (has_words) AS n_lines, count(*) FILTER (goes) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY r) FILTER (
            NOT (goes OR (NOT has_words AND coalesce(before, false) AND (coalesce(after, false) OR coalesce(just_before, false))))), '') AS text
    FROM around GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(k.text, d.text)) AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_OP10 = r"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS row
    FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][row % 3 + 1] AS weight, 3 * source_size AS most FROM sources),
filled AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (
            ORDER BY most / weight, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        / CAST(sum(weight) OVER (ORDER BY most / weight, row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS unit
    FROM weighed),
level AS (SELECT coalesce(min_by(unit, most / weight), 1e300) AS unit FROM filled WHERE unit * weight <= most),
targets AS (
    SELECT source, source_size, least(CAST(most AS DOUBLE), level.unit * weight) AS target,
        CAST('0x' || substr(md5('20240229|' || coalesce('s' || source, 'n')), 1, 5) AS BIGINT) / 1048576.0 AS u
    FROM weighed, level),
placed AS (
    SELECT d.doc_id, d.size, t.*, coalesce(target / nullif(source_size, 0), 0) AS p,
        row_number() OVER (PARTITION BY d.source ORDER BY size, h, d.doc_id) - 1 AS n
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(size * least(3, floor(u + p * (n + 1)) - floor(u + p * n)) AS BIGINT) AS taken
FROM placed
"""

_HEX = "CAST('0x' || substr({text}, {at}, {n}) AS BIGINT)"
_BITS = " + ".join(
    f"CASE WHEN {_HEX.format(text=f'd{k}', at=1 + 3 * i, n=3)} < {4096 // share} THEN {1 << (1 + 8 * k + i)} ELSE 0 END"
    for k, share in enumerate((4, 16, 64, 256)) for i in range(8)
)

_OP9 = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
following AS (
    SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
    FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
edited AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS changed FROM following),
texts AS (SELECT doc_id, 'own' AS kind, text FROM edited UNION ALL SELECT doc_id, 'edited', changed FROM edited),
found AS (SELECT doc_id, kind, text, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS l FROM texts),
plain AS (
    SELECT doc_id, kind, substr(md5(CASE WHEN len(l) > 0 THEN array_to_string(list_sort(l), ' ') ELSE text END), 1, 8) AS whole FROM found),
terms AS (SELECT doc_id, kind, unnest(l) AS term FROM found),
total AS (SELECT count(*) AS t FROM docs),
band AS (
    SELECT term FROM terms, total WHERE kind = 'own' GROUP BY term, t
    HAVING count(*) BETWEEN greatest(2, 0.001 * t) AND greatest(2, 0.1 * t)),
digested AS (
    SELECT term, md5(term) AS d, md5(term || '|0') AS d0, md5(term || '|1') AS d1, md5(term || '|2') AS d2, md5(term || '|3') AS d3
    FROM band),
lexicon AS (SELECT term, {_HEX.format(text='d', at=1, n=8)} % {1 << 29} * {1 << 33} + 1 + {_BITS} AS key FROM digested),
keyed AS (SELECT doc_id, kind, key FROM terms JOIN lexicon USING (term)),
parts AS (SELECT CAST(unnest(range(33)) AS INTEGER) AS part),
digests AS (
    SELECT doc_id, kind, part, substr(md5(CAST(list_sort(list(key)) AS VARCHAR)), 1, 8) AS digest
    FROM keyed, parts WHERE key & (CAST(1 AS BIGINT) << part) <> 0 GROUP BY ALL),
every AS (
    SELECT t.doc_id, t.kind, part, coalesce(digest, CASE WHEN k.doc_id IS NULL THEN whole ELSE '00000000' END) AS digest
    FROM plain t CROSS JOIN parts p LEFT JOIN digests d USING (doc_id, kind, part)
    LEFT JOIN (SELECT DISTINCT doc_id, kind FROM keyed) k USING (doc_id, kind)),
prints AS (SELECT doc_id, kind, string_agg(digest, '' ORDER BY part) AS print, list(digest ORDER BY part) AS l FROM every GROUP BY ALL),
three AS (
    SELECT e.doc_id, e.n, e.changed, o.print AS own, c.print AS edited, o.l AS a, c.l AS b, x.l AS c
    FROM edited e JOIN prints o ON o.doc_id = e.doc_id AND o.kind = 'own'
    JOIN prints c ON c.doc_id = e.doc_id AND c.kind = 'edited' JOIN prints x ON x.doc_id = e.next_id AND x.kind = 'own'),
counted AS (
    SELECT *, len(list_filter(range(1, 34), lambda i: a[i] <> '00000000' OR b[i] <> '00000000')) AS used_b,
        len(list_filter(range(1, 34), lambda i: a[i] <> '00000000' OR c[i] <> '00000000')) AS used_c,
        len(list_filter(range(1, 34), lambda i: a[i] <> '00000000' AND a[i] = b[i])) AS same_b,
        len(list_filter(range(1, 34), lambda i: a[i] <> '00000000' AND a[i] = c[i])) AS same_c
    FROM three)
SELECT doc_id, n AS n_chars, sha256(changed) AS edited_sha256, own AS fingerprint, edited AS edited_fingerprint,
    CASE WHEN used_b = 0 THEN 1.0 ELSE same_b / used_b END AS near_edited,
    CASE WHEN used_c = 0 THEN 1.0 ELSE same_c / used_c END AS near_next
FROM counted
"""

_OP11 = """
WITH RECURSIVE
docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS name
    FROM documents),
checked AS (
    SELECT rid, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ord(name[i]) AS BIGINT))),
        lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT) FOR k IN range(8)]),
            lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS c
    FROM docs WHERE name IS NOT NULL),
leaves AS (
    SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS h,
        CASE WHEN xor(c, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
            THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS changed
    FROM docs LEFT JOIN checked USING (rid)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS key
    FROM leaves),
nodes(tree, level, pos, h, before, after, n) AS (
    SELECT key, 0, pos, h, lag(h) OVER w, lead(h) OVER w, count(*) OVER (PARTITION BY key) FROM placed WINDOW w AS (PARTITION BY key ORDER BY pos)
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(h || CASE WHEN after IS NULL THEN '' ELSE after END),
        lag(sha256(h || coalesce(after, ''))) OVER w, lead(sha256(h || coalesce(after, ''))) OVER w, (n + 1) // 2
    FROM nodes WHERE n > 1 AND pos % 2 = 0 WINDOW w AS (PARTITION BY tree ORDER BY pos)),
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
tops(level, pos, h, before, after, n) AS (
    SELECT 0, tree, h, lag(h) OVER w, lead(h) OVER w, count(*) OVER () FROM subroots WINDOW w AS (ORDER BY tree)
    UNION ALL
    SELECT level + 1, pos // 2, sha256(h || coalesce(after, '')),
        lag(sha256(h || coalesce(after, ''))) OVER w, lead(sha256(h || coalesce(after, ''))) OVER w, (n + 1) // 2
    FROM tops WHERE n > 1 AND pos % 2 = 0 WINDOW w AS (ORDER BY pos)),
root AS (SELECT h AS root FROM tops WHERE n = 1),
steps AS (
    SELECT p.rid, level, CASE WHEN n.pos % 2 = 1 THEN before ELSE '' END AS before, CASE WHEN n.pos % 2 = 0 THEN coalesce(after, '') ELSE '' END AS after
    FROM placed p JOIN nodes n ON n.tree = p.key AND n.pos = p.pos >> level WHERE n > 1
    UNION ALL
    SELECT p.rid, 1000 + level, CASE WHEN t.pos % 2 = 1 THEN before ELSE '' END, CASE WHEN t.pos % 2 = 0 THEN coalesce(after, '') ELSE '' END
    FROM placed p JOIN tops t ON t.pos = p.key >> level WHERE t.n > 1),
paths AS (SELECT rid, list([before, after] ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY rid),
folded(rid, k, x) AS (
    SELECT rid, 1, coalesce(changed, h) FROM placed
    UNION ALL
    SELECT f.rid, k + 1, sha256(path[k][1] || x || path[k][2]) FROM folded f JOIN paths USING (rid) WHERE k <= len(path)),
ends AS (SELECT f.rid, arg_max(x, k) AS folded_root FROM folded f GROUP BY f.rid)
SELECT doc_id, p.h AS leaf, s.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON s.tree = key CROSS JOIN root JOIN ends USING (rid) LEFT JOIN paths USING (rid)
"""

_OP12 = r"""
WITH
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
    SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
flat AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (
    SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS v
    FROM flat WINDOW o AS (PARTITION BY rid ORDER BY i)),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM windows WHERE v IS NOT NULL),
covered AS (SELECT DISTINCT rid, i + k AS place FROM counted, (SELECT unnest(range(5)) AS k) WHERE c > 1),
repeats AS (SELECT rid, count(*) AS n_repeat_words FROM covered GROUP BY rid),
cut AS (SELECT rid, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+') AS t FROM docs),
tokens AS (SELECT rid, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM cut),
hashed AS (SELECT rid, i, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM tokens),
pairs AS (SELECT rid, h, 31 * h + lead(h) OVER (PARTITION BY rid ORDER BY i) AS p FROM hashed),
grams AS (SELECT rid, h & 262143 AS bin FROM pairs UNION ALL SELECT rid, p & 262143 FROM pairs WHERE p IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality > 0),
marked AS (SELECT rid, t.doc_id IS NOT NULL AS good FROM docs d LEFT JOIN trusted t USING (doc_id)),
bins AS (SELECT bin, CAST(count(*) FILTER (WHERE good) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS r FROM grams JOIN marked USING (rid) GROUP BY bin),
sums AS (SELECT sum(t) AS tt, sum(r) AS rr FROM bins),
weights AS (SELECT bin, CASE WHEN tt > 0 THEN CAST(floor(ln((t + 8.0) / (tt * r / rr + 8.0)) * 1048576 + 0.5) AS BIGINT) ELSE 0 END AS weight FROM bins, sums),
scores AS (SELECT rid, sum(weight) AS s, count(*) AS n FROM grams JOIN weights USING (bin) GROUP BY rid),
every AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(s, 0) AS s, coalesce(n, 0) AS n
    FROM docs JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN scores USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND s >= -125830 * n AS kept
FROM every
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1,
    "op2_embedding_near_dedup": _OP2,
    "op4_line_dedup": _OP4,
    "op9_fingerprints": _OP9,
    "op10_source_mixing": _OP10,
    "op11_merkle_manifest": _OP11,
    "op12_quality_rules": _OP12,
}
