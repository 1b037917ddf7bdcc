"""DuckDB SQL for those queries that SQL can express, by plain joins."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 5"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON b.g = a.g AND b.doc_id > a.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, s.b FROM reach r JOIN both_ways s ON s.a = r.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""

_WORDS = f"regexp_extract_all({_ASCII_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM b, unnest(range(1, greatest(2, len(w) - 8))) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.g = dw.g),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, n)) t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

_AUDIT_FLAGS = """d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
w AS (SELECT d.*, regexp_extract_all(d.t, '[^\\x20\\x09-\\x0D]+') AS w, coalesce(d.doc_id > first.m, FALSE) AS E FROM d JOIN first ON first.t = d.t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS C,
    regexp_matches(t, '[#$%&*|]') AS D, E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id)"""
#: Every order is run over the counts of equal flags, step by step.
INTERACTION = f"""WITH {_AUDIT_FLAGS}, c AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS x, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))), 0)::INT AS before, 1 << (ascii(o[step]) - 65) AS bit FROM o, unnest(range(1, 6)) t(step)),
r AS (SELECT part, o, step, x, sum(n) FILTER (m & (before | bit) = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & bit <> 0) AS removed, sum(n) FILTER (m & before <> 0 AND m & bit <> 0) AS redundant,
    sum(n) FILTER (m = bit) AS unique_fails, sum(good) FILTER (m & before = 0 AND m & bit <> 0) AS good_lost, sum(toxic) FILTER (m & before = 0 AND m & bit <> 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, x AS filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM r"""

_TERMS = f"regexp_extract_all({_ASCII_LOW}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: Every group with every kept term of its language, and every pair of these.
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(n.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN n ON n.lang = d.lang AND n.source = d.source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.total + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 1)::HUGEINT) // (v.total + v.v)::HUGEINT AS q
    FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM x a JOIN x b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM x WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o) WHERE part = 'pair' OR rank <= 200"""


def _secrets() -> str:
    """Base spans and runs by lengths of pieces, both models as counts of pairs of characters, and each run's sum."""
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(letters, ("password", "passwd", "secret", "token", "api_?key")))
    alphabet = f"{_UPPER}{_LOWER}0123456789+/_=-"
    patterns = (("assign", rf"""(?:{names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]{24,})", 24), ("random", "([A-Za-z0-9+/_=-]{16,})", 16))
    parts, rest = [], "d"
    lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    for k, (kind, pattern, least) in enumerate(patterns):
        cut = "SELECT r, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', 1) AS v FROM {s} WHERE regexp_matches(t, '{p}')"
        whole = "d" if kind != "random" else rest
        parts.append(f"c{k} AS ({cut.format(p=pattern, s=whole)})")
        parts.append(f"s{k} AS (SELECT r, {k} AS k, '{kind}' AS kind, ({lengths('g[1:i]')} + {lengths('m[1:i-1]')})::BIGINT AS a, length(m[i]) AS n, v[i] AS value FROM c{k}, unnest(range(1, len(m) + 1)) t(i) WHERE length(v[i]) >= {least})")
        if kind != "random":
            left = f"array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN length(v[i]) >= {least} THEN repeat(' ', length(m[i])) ELSE m[i] END), '')"
            parts.append(f"x{k} AS ({cut.format(p=pattern, s=rest)})")
            parts.append(f"r{k} AS (SELECT o.r, o.h, coalesce(x.t, o.t) AS t FROM {rest} o LEFT JOIN (SELECT r, {left} AS t FROM x{k}) x ON x.r = o.r)")
            rest = f"r{k}"
    sample = "(SELECT count(*) FROM d) <= 20000 OR ('0x' || h[1:8])::BIGINT < floor(20000 / (SELECT count(*) FROM d) * 4294967296)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents), {", ".join(parts)},
runs AS (SELECT *, row_number() OVER () AS id FROM s3 WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
picked AS (SELECT * FROM {rest} WHERE {sample}),
strings AS (SELECT FALSE AS random, value FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{6,}}')) AS value FROM picked) x WHERE length(value) < 16 OR NOT regexp_matches(value, '[0-9]') OR NOT regexp_matches(value, '[A-Za-z]')
    UNION SELECT TRUE, value FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) s WHERE r IN (SELECT r FROM picked) AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    UNION SELECT TRUE, unnest([h, upper(h), replace(base64(unhex(h)), '=', '')]) FROM picked),
pairs AS (SELECT random, CASE WHEN i = 1 THEN 0 ELSE strpos('{alphabet}', value[i - 1]) END AS a, strpos('{alphabet}', value[i]) AS b FROM strings, unnest(range(1, length(value) + 1)) t(i)),
seen AS (SELECT a, b, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM pairs WHERE b > 0 GROUP BY ALL),
grid AS (SELECT a, b, coalesce(r, 0) + 0.5::DOUBLE AS r, coalesce(o, 0) + 0.5::DOUBLE AS o FROM (SELECT a, b FROM range(0, 68) x(a), range(1, 68) y(b)) g LEFT JOIN seen USING (a, b)),
w AS (SELECT a, b, round(1000 * (log2(r / sum(r) OVER (PARTITION BY a)) - log2(o / sum(o) OVER (PARTITION BY a))))::INT AS w FROM grid),
score AS (SELECT id, sum(w) AS score FROM (SELECT id, CASE WHEN i = 1 THEN 0 ELSE strpos('{alphabet}', value[i - 1]) END AS a, strpos('{alphabet}', value[i]) AS b FROM runs, unnest(range(1, length(value) + 1)) t(i)) x JOIN w USING (a, b) GROUP BY id),
found AS (SELECT r, k, kind, a, n FROM s0 UNION ALL SELECT r, k, kind, a, n FROM s1 UNION ALL SELECT r, k, kind, a, n FROM s2
    UNION ALL SELECT r, k, kind, a, n FROM runs JOIN score USING (id) WHERE score >= ceil(1000 * log2(greatest(1, (SELECT count(*) FROM runs)) / 0.01))),
each AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_random,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN each ON each.r = d.r"""


SECRETS = _secrets()
