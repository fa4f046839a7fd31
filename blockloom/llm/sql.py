"""DuckDB SQL of the queries that SQL can express."""

from .secret_scan import ACCESS, ALPHABET, ASSIGN, HEX, RUN, SIZE
from .url_filter import rounds_for

# Words of each text with their places, and the break between words.
WORDS = """
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)
"""

SUBSTRINGS = f"""
WITH {WORDS},
n AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS x FROM w, LATERAL (SELECT unnest(range(0, len(w) - 19)) AS i)),
f AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM n),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM f, (SELECT unnest(range(0, 20)) AS k) WHERE r > 1),
g AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w) w
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.p = w.p) GROUP BY w.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

JACCARD = """
WITH RECURSIVE l AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM l, LATERAL (SELECT unnest(range(0, greatest(len(w) - 3, 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * o >= 85 * (nu.n + nv.n - o)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS doc_id, u AS c FROM b UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.c)
SELECT l.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.c), l.doc_id) AS component_id
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY l.doc_id
"""

RULES = f"""
WITH {WORDS},
t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 3], ' ') AS x FROM w, LATERAL (SELECT unnest(range(0, len(w) - 2)) AS i)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM c, (SELECT unnest(range(0, 3)) AS j) WHERE k > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS raw FROM t),
solid AS (SELECT *, trim(regexp_replace(translate(lower(raw), '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM lines WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM solid GROUP BY doc_id),
often AS (SELECT host, norm, count(DISTINCT t) AS k FROM solid GROUP BY ALL),
total AS (SELECT host, count(DISTINCT t) AS k FROM solid GROUP BY host),
common AS (SELECT host, norm FROM often JOIN total USING (host) WHERE often.k >= 20 AND often.k > 0.1 * total.k),
size AS (SELECT doc_id, host, norm, length(norm) - length(replace(norm, ' ', '')) + 1 AS n FROM solid),
lost AS (SELECT doc_id, sum(size.n) AS n, sum(CASE WHEN common.norm IS NOT NULL THEN size.n END) AS gone FROM size LEFT JOIN common USING (host, norm) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lost.gone > 0.5 * lost.n, false) AS depleted
  FROM w JOIN t USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept FROM j
"""

LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, line, array_to_string(w, ' ') AS x, w FROM w WHERE len(w) > 0),
d AS (SELECT x, any_value(w) AS w, min((doc_id, line)) AS place FROM k GROUP BY x),
v AS (SELECT x, place, len(w) AS n, i, array_to_string(list_concat(w[:i], w[i + 2:]), ' ') AS v FROM d, LATERAL (SELECT unnest(range(0, len(w))) AS i) WHERE len(w) >= 8),
near AS (
  SELECT DISTINCT b.x FROM v a JOIN v b ON a.v = b.v AND a.n = b.n AND a.i = b.i AND a.x <> b.x AND a.place < b.place
  UNION SELECT v.x FROM v JOIN d ON d.x = v.v AND len(d.w) >= 8 AND d.place < v.place
  UNION SELECT d.x FROM v JOIN d ON d.x = v.v AND len(d.w) >= 8 AND v.place < d.place),
j AS (SELECT k.doc_id, k.line, (k.doc_id, k.line) > d.place OR near.x IS NOT NULL AS gone FROM k JOIN d USING (x) LEFT JOIN near USING (x))
SELECT doc_id, count(j.line) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(j.line::VARCHAR, ',' ORDER BY j.line) FILTER (gone), '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN j USING (doc_id) GROUP BY doc_id
"""

_LINK = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']?\\s*((?:https?:)?//[^\"'\\s>]+)"


ROUNDS = rounds_for(0.85, 1e-3)


def _ranks(name: str, seed: str, source: str, target: str, rounds: int = ROUNDS) -> str:
    """Rounds of personalised PageRank over ``edges``, one common table after another."""
    out = f"{name}_w AS (SELECT {source} AS a, {target} AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edges),\n"
    out += f"{name}_s AS (SELECT host, {seed} AS seed FROM hosts WHERE {seed} > 0),\n{name}_0 AS (SELECT host, seed AS score FROM {name}_s),\n"
    for k in range(rounds):
        out += (
            f"{name}_{k + 1} AS (SELECT host, sum(score) AS score FROM (SELECT b AS host, {name}_{k}.score * w * 0.85 AS score FROM {name}_{k} JOIN {name}_w ON a = host "
            f"UNION ALL SELECT host, seed FROM {name}_s) GROUP BY host),\n"
        )
    return out


URLS = (
    f"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, regexp_matches(coalesce(url, ''), '://') AS has, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
p AS (SELECT page_id, html, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM u),
rules(verdict, name, prefix) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, name || prefix AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(name || prefix) DESC) AS r
  FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)),
j AS (SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN fits ON fits.page_id = p.page_id AND r = 1),
hosts AS (SELECT host, count(*) FILTER (verdict = 'allow') / (count(*) + 1) AS good, count(*) FILTER (verdict = 'block') / (count(*) + 1) AS bad FROM j WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{_LINK.replace("'", "''")}', 1))) AS url FROM p),
ends AS (SELECT src, translate(regexp_extract(url, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM links),
edges AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
"""
    + _ranks("trust", "good", "src", "dst")
    + _ranks("distrust", "bad", "dst", "src")
    + """bad AS (SELECT host FROM distrust_@ LEFT JOIN (SELECT host, score AS trust FROM trust_@) USING (host) WHERE score > 0.5 AND score > coalesce(trust, 0))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
""".replace("@", str(ROUNDS))
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(name: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """Table ``name`` of ``(doc_id, kind, start, stop, token)``: matches in code points, placed by the pieces between them."""
    p = _quoted(pattern)
    return f"""
{name}_m AS (SELECT doc_id, regexp_split_to_array(t, {p}) AS p, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS h FROM t WHERE regexp_matches(t, {p})),
{name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name} AS (SELECT doc_id, {kind} AS kind, (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
  m[i] AS token, start + length(m[i]) AS stop FROM {name}_i WHERE length(h[i]) >= {least}),"""


_PLAIN = "t"
for _p in (ASSIGN, HEX, ACCESS):
    _PLAIN = f"regexp_replace({_PLAIN}, {_quoted(_p)}, ' ', 'g')"
_PLACE = f"instr('{ALPHABET}', substr(token, i, 1))"

SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", ASSIGN, 0, 2, 6)}{_spans("access", ACCESS, 1)}{_spans("hexes", HEX, 2)}{_spans("runs", RUN, 3)}
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexes),
picked AS (SELECT * FROM t WHERE doc_id IN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY md5(doc_id::VARCHAR) LIMIT 2000)),
found AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(t, {_quoted(HEX)}), regexp_extract_all(t, {_quoted(ACCESS)}))) AS token FROM picked),
digests AS (SELECT sha256(doc_id::VARCHAR) AS d FROM picked),
made AS (SELECT unnest([to_base64(unhex(d)), to_base64(unhex(sha256(d))), d, translate(upper(to_base64(unhex(d))), '+/=', '234')]) AS token FROM digests),
samples AS (SELECT unnest(list_distinct(regexp_extract_all({_PLAIN}, '[A-Za-z0-9+/_-]{{6,}}'))) AS token, 0 AS random FROM picked UNION ALL SELECT token, 1 FROM found UNION ALL SELECT token, 1 FROM made),
places AS (SELECT token, random, unnest(range(1, length(token))) AS i FROM samples),
pairs AS (SELECT random, {_PLACE} AS a, {_PLACE.replace("i, 1", "i + 1, 1")} AS b, count(*) AS n FROM places GROUP BY ALL),
grid AS (SELECT a, b FROM (SELECT unnest(range({SIZE})) AS a), (SELECT unnest(range({SIZE})) AS b)),
single AS (SELECT random, b, sum(n) AS n FROM pairs GROUP BY ALL), total AS (SELECT random, sum(n) + 0.5 * {SIZE} AS n FROM pairs GROUP BY random),
row_sum AS (SELECT random, a, sum(n) AS n FROM pairs GROUP BY ALL),
chance AS (SELECT k.random, a, b, (coalesce(pairs.n, 0) + 0.5 * {SIZE} * (coalesce(single.n, 0) + 0.5) / k.n) / (coalesce(row_sum.n, 0) + 0.5 * {SIZE}) AS p
  FROM grid CROSS JOIN total AS k LEFT JOIN pairs USING (random, a, b) LEFT JOIN single USING (random, b) LEFT JOIN row_sum USING (random, a)),
ratio AS (SELECT a, b, round(ln(max(p) FILTER (random = 1) / max(p) FILTER (random = 0)), 5) AS r FROM chance GROUP BY a, b),
free AS (SELECT * FROM runs WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = runs.doc_id AND base.start < runs.stop AND base.stop > runs.start)),
steps AS (SELECT doc_id, start, stop, token, unnest(range(1, length(token))) AS i FROM free),
scored AS (SELECT doc_id, start, stop, sum(r) AS score FROM (SELECT doc_id, start, stop, {_PLACE} AS a, {_PLACE.replace("i, 1", "i + 1, 1")} AS b FROM steps) JOIN ratio USING (a, b) GROUP BY ALL),
every AS (SELECT doc_id, start, kind, stop FROM base UNION ALL SELECT doc_id, start, 3, stop FROM scored WHERE score >= 15 AND score >= 2 * (stop - start)),
written AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
  string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN written USING (doc_id)
"""
