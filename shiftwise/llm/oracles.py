"""The queries' results in plain SQL (DuckDB dialect), where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CLASS_OTHERS = (r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^\x20\x09-\x0D]", r"[^.,;:!?''\"()\-]", r"[\x00-\x7f]")
_LENGTHS = [f"length(regexp_replace(t, '{p}', '', 'g'))" for p in _CLASS_OTHERS]

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, {WORDS} AS w FROM documents),
e AS (SELECT rid, doc_id, t, w, len(w) AS n, coalesce(lang, chr(1)) AS key FROM d),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n
        FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, n - 1)) AS i FROM e WHERE n >= 3) a) b),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM tri, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM e) a
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT rid, key, n, length(t) AS chars, [{_LENGTHS[0]}, {_LENGTHS[1]}, {_LENGTHS[2]}, {_LENGTHS[3]}, {_LENGTHS[4]}, {_LENGTHS[5]}] AS six FROM e),
cl AS (SELECT rid, key, n, chars, unnest([six[1], six[2], six[3], six[4], six[5], chars - list_sum(six), six[6]]) AS held, unnest(range(7)) AS class FROM c),
med AS (SELECT key, class, quantile_disc(1000 * held // chars, 0.5) AS step FROM cl WHERE n > 0 GROUP BY key, class),
cref AS (SELECT key, class, step / greatest(sum(step) OVER (PARTITION BY key), 1) AS q FROM med),
cp AS (SELECT cl.rid, held / chars AS p, q, (held / chars + q) / 2 AS m FROM cl JOIN cref ON cl.key = cref.key AND cl.class = cref.class WHERE chars > 0),
cd AS (SELECT rid, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2)) AS dist FROM cp GROUP BY rid),
words AS (SELECT rid, key, unnest(w) AS x FROM e),
total AS (SELECT key, count(*) AS n FROM words GROUP BY key),
common AS (SELECT words.key, x, count(*) AS n FROM words JOIN total ON words.key = total.key GROUP BY words.key, x, total.n HAVING count(*) >= CAST(0.001 AS DOUBLE) * total.n),
wref AS (SELECT common.key, x, common.n / total.n AS q FROM common JOIN total ON common.key = total.key
         UNION ALL SELECT total.key, NULL, (total.n - coalesce((SELECT sum(n) FROM common WHERE common.key = total.key), 0)) / total.n FROM total),
held AS (SELECT rid, words.key, common.x, count(*) AS n FROM words LEFT JOIN common ON words.key = common.key AND words.x = common.x GROUP BY rid, words.key, common.x),
wp AS (SELECT held.rid, held.n / e.n AS p, coalesce(wref.q, 0) AS q, (held.n / e.n + coalesce(wref.q, 0)) / 2 AS m
       FROM held JOIN e ON held.rid = e.rid LEFT JOIN wref ON held.key = wref.key AND held.x IS NOT DISTINCT FROM wref.x),
wd AS (SELECT rid, sqrt(greatest(0, (sum(p * log2(p / m) + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) + 1 - sum(q)) / 2)) AS dist FROM wp GROUP BY rid),
r AS (SELECT e.rid, e.doc_id, e.n AS n_words, length(e.t) - length(regexp_replace(e.t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(regexp_extract_all(e.t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             CASE WHEN total.n > 0 THEN coalesce(cd.dist, 0) ELSE 0 END AS class_distance, coalesce(wd.dist, 0) AS word_distance
      FROM e LEFT JOIN dup ON e.rid = dup.rid LEFT JOIN rep ON e.rid = rep.rid LEFT JOIN cd ON e.rid = cd.rid LEFT JOIN wd ON e.rid = wd.rid LEFT JOIN total ON e.key = total.key),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR (class_distance > CAST(0.19 AS DOUBLE) AND word_chars >= 200)
            OR (word_distance > CAST(0.2 AS DOUBLE) + CAST(2.6 AS DOUBLE) / sqrt(greatest(n_words, 1)) AND n_words >= 50)) AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM f
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
x AS (SELECT rid, len(sh) AS n, unnest(sh) AS t FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.rid AS u, b.rid AS v FROM x a JOIN x b ON a.t = b.t AND a.rid < b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
least AS (SELECT reach.u AS rid, min(s.doc_id) AS doc_id FROM reach JOIN s ON reach.v = s.rid GROUP BY reach.u),
deg AS (SELECT u AS rid, count(*) AS n FROM l GROUP BY u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least.doc_id, s.doc_id)) AS component_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN least ON s.rid = least.rid LEFT JOIN deg ON s.rid = deg.rid
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 50) a),
starts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN starts ON win.k = starts.k WHERE f < doc_id),
words AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.rid, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN gone ON words.rid = gone.rid AND words.p = gone.p
         WHERE gone.p IS NULL GROUP BY words.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\|[a-z]+(?::[0-9]+)?\|>|/?s>|/?INST\])')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_HOST, _PATH = r"^(?s:.*?)://([^/?#]*)", r"^(?s:.*?)://[^/?#]*([^?#]*)"


def _rules(what: str) -> str:
    """The longest rule that fits, in the order of their lengths."""
    rows = (("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/"))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in rows)
    return f"CASE {cases} END"


URLS = rf"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS rid, page_id, html, translate(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '{_PATH}', 1) AS path FROM pages),
r AS (SELECT *, {_rules("rule")} AS rule, {_rules("verdict")} AS ruled FROM u),
h AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0 END) AS b FROM r WHERE host <> '' GROUP BY host),
links AS (SELECT host AS f, translate(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS t FROM r WHERE host <> ''),
e AS (SELECT f, t, count(*) AS n FROM links WHERE f <> t GROUP BY f, t),
ed AS MATERIALIZED (SELECT f, t, n / sum(n) OVER (PARTITION BY f) AS share FROM e),
known AS MATERIALIZED (SELECT host, CAST(max(tr) AS DOUBLE) AS tr, CAST(max(bl) AS DOUBLE) AS bl, host IN (SELECT f FROM ed) AS linked
  FROM (SELECT host, CAST(a >= 0.5 AS INTEGER) AS tr, CAST(a < 0.5 AND b >= 0.5 AS INTEGER) AS bl FROM h UNION ALL SELECT f, 0, 0 FROM ed UNION ALL SELECT t, 0, 0 FROM ed) k GROUP BY host),
pairs AS MATERIALIZED (SELECT k.host, k.tr, k.bl, k.linked, coalesce(i.ins, []) AS ins, coalesce(o.outs, []) AS outs
  FROM known k LEFT JOIN (SELECT t, list({{'h': f, 's': share}}) AS ins FROM ed GROUP BY t) i ON i.t = k.host
               LEFT JOIN (SELECT f, list({{'h': t, 's': share}}) AS outs FROM ed GROUP BY f) o ON o.f = k.host),
sc AS (SELECT 0 AS round, map_from_entries(list((host, tr))) AS trust, map_from_entries(list((host, bl))) AS distrust FROM known
  UNION ALL
  SELECT x.round, map_from_entries(list((x.host, x.trust))), map_from_entries(list((x.host, x.distrust)))
  FROM (SELECT sc.round + 1 AS round, p.host,
          CAST(0.15 AS DOUBLE) * p.tr + CAST(0.85 AS DOUBLE) * (coalesce(list_sum(list_transform(p.ins, lambda i: i.s * sc.trust[i.h])), 0)
            + p.tr * coalesce(sum(CASE WHEN p.linked THEN 0 ELSE sc.trust[p.host] END) OVER () / nullif(sum(p.tr) OVER (), 0), 0)) AS trust,
          CASE WHEN p.bl > 0 THEN p.bl ELSE CAST(0.85 AS DOUBLE) * coalesce(list_sum(list_transform(p.outs, lambda i: i.s * sc.distrust[i.h])), 0) END AS distrust
        FROM sc, pairs p WHERE sc.round < 120) x GROUP BY x.round),
last AS (SELECT trust, distrust FROM sc WHERE round = 120),
bad AS (SELECT host FROM known, last WHERE distrust[host] >= 0.4 AND distrust[host] > trust[host])
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN r.host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM r
"""

NEGATIVES = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
