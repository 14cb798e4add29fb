"""DuckDB SQL for the queries of this subpackage that SQL can express.

There is none for op3 (no CRC-32 in DuckDB, and whole texts are too long for the one that
op12's SQL makes), op5 and op9 (trained models), op11 (eigenvectors), op13 (a tokenizer) and
the pipeline; tests compare these with brute force.
"""

from __future__ import annotations

from trellium.llm import jaccard_join, mixing, url_filter

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _op1() -> str:
    listed = ", ".join(f"'{d}'" for d in url_filter.LISTED)
    tests = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {tests} END AS hit, len(list_filter([{listed}], lambda d: host = d OR ends_with(host, '.' || d))) > 0 AS listed FROM p)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r"""


def _invert(k: int) -> str:
    out = ""
    for time, factor, slope, before in reversed(mixing.integrate(mixing.SCHEDULES[k])):
        rest = f"(share - {before!r}::DOUBLE)"
        root = f"sqrt(greatest({factor * factor!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0::DOUBLE))"
        out += f" WHEN share >= {before!r}::DOUBLE THEN {time!r}::DOUBLE + 2::DOUBLE * {rest} / ({factor!r}::DOUBLE + {root})"
    return f"CASE{out} END"


def _op2() -> str:
    at = " ".join(f"WHEN rk % 3 = {k} THEN {_invert(k)}" for k in range(len(mixing.SCHEDULES)))
    return f"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, (rk % 3 + 1)::BIGINT AS w, source_size * {mixing.MAX_EPOCHS} AS cap, sum(source_size) OVER () AS total, sum(rk % 3 + 1) OVER () AS ws FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER b, 0) AS rest, ws - coalesce(sum(w) OVER b, 0) AS open
  FROM w WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, row_number() OVER (ORDER BY cap / w, rk) AS n FROM f),
c AS (SELECT n AS n0, rest::DOUBLE AS r0, open::DOUBLE AS o0 FROM g WHERE rest::DOUBLE * w / open::DOUBLE <= cap ORDER BY n LIMIT 1),
t AS (SELECT source, rk, source_size, CASE WHEN n < n0 THEN cap::DOUBLE ELSE r0 * w / o0 END AS target FROM g, c),
o AS (SELECT doc_id, size, rk, source_size, target, sum(size) OVER (PARTITION BY rk ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM o),
q AS (SELECT *, (passes * size + greatest(0, least(size, floor(target - (passes * source_size)::DOUBLE + 0.5::DOUBLE)::BIGINT - before)))::BIGINT AS taken, before::DOUBLE / target AS share FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE {at} END, 9) END AS position FROM q"""


def _op4() -> str:
    assign = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}"), ("owned", "[A-Za-z0-9+/_=-]{24,}"))
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, '{k}' AS kind, {i} AS ord, regexp_extract_all(t, '{p}') AS f, regexp_split_to_array(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"
        for i, (k, p) in enumerate(kinds)
    )
    return rf"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({found}),
u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, source, lang, kind, ord, f[i] AS v, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
  + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM u),
e AS (SELECT *, a + length(v) AS z, CASE WHEN kind = 'assign' THEN regexp_extract(v, '{assign}', 2) ELSE v END AS secret FROM s),
b AS (SELECT *, len(list_distinct(regexp_split_to_array(secret, ''))) >= 10 AND NOT regexp_matches(secret, '(?i)example|sample|dummy|change.?me|your|placeholder|xxxx|0000000|1234567|abcdefg') AS random
  FROM e WHERE kind <> 'assign' OR length(secret) >= 6),
c AS (SELECT * FROM b WHERE kind <> 'owned' OR (random AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM b x WHERE x.doc_id = b.doc_id AND x.kind <> 'owned' AND x.a < b.z AND b.a < x.z))),
n AS (SELECT secret, count(DISTINCT coalesce(source, '~')) AS owners FROM c GROUP BY secret),
l AS (SELECT c.*, CASE WHEN owners >= 3 OR NOT random THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS label FROM c JOIN n USING (secret)),
k AS (SELECT * FROM l WHERE kind <> 'owned' OR label = 'live'),
r AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord, z) FILTER (ord < 3), '') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord, z) AS spans,
  count(*) FILTER (label = 'live') AS n_live, count(*) FILTER (label = 'shared') AS n_shared, count(*) FILTER (label = 'example') AS n_example FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN r USING (doc_id)"""


_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
w AS (SELECT vec_id, label, list_transform(x, lambda c: c / pow(2::DOUBLE, floor(log2(list_max(list_transform(x, lambda y: abs(y))))))) AS x FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c <> 0)) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
ok AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM w),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id"""

_OP7 = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(x) - 1)) AS i, x FROM l WHERE len(x) >= 3),
k AS (SELECT doc_id, i, x[i:i + 2] AS g FROM w WHERE regexp_matches(x[i] || x[i + 1] || x[i + 2], '\S')),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, i + j AS line FROM o, range(3) t(j) WHERE n > 1),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(x), 0)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: NOT list_contains(gone, i)), lambda i: x[i]), chr(10)), '') END) AS clean_sha256
FROM l LEFT JOIN g USING (doc_id)"""

_CUT = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP8 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_CUT.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
d AS (SELECT doc_id, {_CUT.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM n))),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN g ON p.n = g.n AND p.g = g.g),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _op10(rule: jaccard_join.Rule, links: bool = False) -> str:
    counted = ", (SELECT count(*) FROM u WHERE u.a = d.doc_id) AS n_links" if links else ""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {rule.n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {rule.n - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {rule.den} * k >= {rule.num} * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id{counted} FROM d LEFT JOIN n USING (doc_id)"""


# the checksum of a word is the xor of a table entry for each byte and its distance from the end; the first four bytes are inverted, and so is the result
_OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
u AS (SELECT run, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS h, count(*) AS c FROM d WHERE length(run) >= 6 GROUP BY ALL),
z AS (SELECT b, b AS v, 0 AS i FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM z WHERE i < 8),
t AS (SELECT b, v FROM z WHERE i = 8),
p AS (SELECT 0 AS k, b, v FROM t UNION ALL SELECT k + 1, p.b, xor(p.v >> 8, t.v) FROM p JOIN t ON t.b = p.v & 255 WHERE k < (SELECT max(length(h)) // 2 FROM u)),
y AS (SELECT run, h, c, length(h) // 2 AS m, unnest(range(length(h) // 2)) AS j FROM u),
x AS (SELECT run, h, c, m - 1 - j AS k, xor((instr('0123456789ABCDEF', substr(h, 2 * j + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * j + 2, 1)) - 1, CASE WHEN j < 4 THEN 255 ELSE 0 END) AS b FROM y),
s AS (SELECT run, h, any_value(c) AS c, xor(bit_xor(v), 4294967295) AS crc FROM x JOIN p USING (k, b) GROUP BY run, h),
w AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, c FROM s),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT DISTINCT l.word AS long, v.word AS short FROM l JOIN v ON l.rest = v.word),
o AS (SELECT a.word, b.word AS other FROM l a JOIN l b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION ALL SELECT long, short FROM e UNION ALL SELECT short, long FROM e),
f AS (SELECT o.word, count(*) OVER (PARTITION BY o.word) AS n_near, other, n AS m, row_number() OVER (PARTITION BY o.word ORDER BY n DESC, other) AS rk FROM o JOIN v ON v.word = other),
g AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN f ON f.word = v.word AND rk = 1),
r AS (SELECT word, form, word AS root, form AS up FROM g UNION ALL SELECT r.word, r.form, g.word, g.form FROM r JOIN g ON r.up = g.word)
SELECT g.word, g.form, r.root, g.n, g.n_near, g.form_n FROM g JOIN r ON r.word = g.word AND r.up IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _op1(),
        "op2_mixing": _op2(),
        "op4_secret_scan": _op4(),
        "op6_embedding_dedup": _OP6,
        "op7_line_dedup": _OP7,
        "op8_decontamination": _OP8,
        "op10_jaccard_join": _op10(jaccard_join.Rule(4, 85, 100)),
        "op10_jaccard_links": _op10(jaccard_join.Rule(4, 85, 100), links=True),
        "op12_spelling": _OP12,
    }
