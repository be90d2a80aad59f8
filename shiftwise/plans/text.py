"""Driver queries for rule-based text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.functions import text as tx
from shiftwise.operators.matching import match_title, mention_join
from shiftwise.operators.windows import global_rank
from shiftwise.plans.common import c
from shiftwise.plans.registry import query
from shiftwise.sources.tables import Tables


def _sql_has(alternatives) -> str:
    return f"regexp_matches(COALESCE(text, ''), '{tx.sql_pattern(alternatives)}')"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_norm_title(x: str) -> str:
    """DuckDB spelling of ``normalize_title`` (same regexes, same order)."""
    quotes = tx.TITLE_QUOTES.replace("'", "''")
    s = _STRIP.format(x=x)
    s = f"regexp_replace({s}, '^[{quotes}]+|[{quotes}]+$', '', 'g')"
    for tail in tx.TITLE_TAILS:
        s = f"regexp_replace({s}, '{tail}', '')"
    return f"regexp_replace(lower({_STRIP.format(x=s)}), '\\s+', ' ', 'g')"


def _title_keys(t: Tables):
    """Distinct part names in case-insensitive order (the allowed-title order)."""
    names = t.part.where(c("p_name").isNotNull()).select("p_name").distinct().withColumn("_lk", F.lower("p_name"))
    return global_rank(names, ["_lk", "p_name"], "row_number", "pos").drop("_lk")


_KEYS_SQL = """k AS (SELECT p_name AS key, ROW_NUMBER() OVER (ORDER BY lower(p_name), p_name) AS pos
       FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL) d)"""


@query("match_title", f"""
WITH {_KEYS_SQL},
q AS (SELECT p_partkey * 2 AS query_id, '"' || upper(p_name) || '" (' || p_brand || ')' AS title FROM part
      UNION ALL
      SELECT p_partkey * 2 + 1, lower(p_type) || ' - edition ' || CAST(p_size AS VARCHAR) FROM part),
qn AS (SELECT query_id, title, CASE WHEN title IS NOT NULL AND title <> '' THEN {_sql_norm_title('title')} END AS n FROM q),
kn AS (SELECT key, pos, {_sql_norm_title('key')} AS n FROM k),
ex AS (SELECT qn.query_id, arg_min(kn.key, kn.pos) AS key FROM qn JOIN kn ON qn.n = kn.n GROUP BY qn.query_id),
ct AS (SELECT qn.query_id, arg_min(kn.key, kn.pos) AS key FROM qn JOIN kn ON strpos(kn.n, qn.n) > 0
       WHERE qn.n <> '' AND qn.query_id NOT IN (SELECT query_id FROM ex) GROUP BY qn.query_id)
SELECT q.query_id, q.title, COALESCE(ex.key, ct.key) AS matched_title
FROM q LEFT JOIN ex ON q.query_id = ex.query_id LEFT JOIN ct ON q.query_id = ct.query_id
""")
def match_title_q(spark, sf):
    t = Tables(spark, sf)
    qa = t.part.select((c("p_partkey") * 2).alias("query_id"),
                       F.concat(F.lit('"'), F.upper("p_name"), F.lit('" ('), c("p_brand"), F.lit(")")).alias("title"))
    qb = t.part.select((c("p_partkey") * 2 + 1).alias("query_id"),
                       F.concat(F.lower("p_type"), F.lit(" - edition "), c("p_size").cast("string")).alias("title"))
    return match_title(qa.unionByName(qb), "query_id", "title", _title_keys(t), "p_name", "pos")


@query("mention_join", f"""
WITH {_KEYS_SQL},
t AS (SELECT p_partkey, 'Do you have ' || upper(p_name) || ' by ' || p_brand || '?' AS txt FROM part)
SELECT t.p_partkey, arg_min(k.key, k.pos) AS mentioned_title
FROM t LEFT JOIN k ON strpos(lower(t.txt), lower(k.key)) > 0
GROUP BY t.p_partkey
""")
def mention_join_q(spark, sf):
    t = Tables(spark, sf)
    texts = t.part.select("p_partkey", F.concat(F.lit("Do you have "), F.upper("p_name"), F.lit(" by "),
                                                c("p_brand"), F.lit("?")).alias("txt"))
    return mention_join(texts, "p_partkey", "txt", _title_keys(t), "p_name", "pos").select(
        "p_partkey", "mentioned_title")


@query("classify_intent", f"""
SELECT conv_id, turn,
       CASE WHEN {_sql_has(tx.INTENT_CODE)} THEN 'out_of_scope'
            WHEN {_sql_has(tx.INTENT_ORDINAL)} THEN 'ordinal'
            WHEN {_sql_has(tx.INTENT_PAGES)} OR {_sql_has(tx.INTENT_AUTHOR)} OR {_sql_has(tx.INTENT_YEAR)}
                 OR {_sql_has(tx.INTENT_THIS_BOOK)} THEN 'book_followup'
            ELSE 'recommendation' END AS intent
FROM conversations
""")
def classify_intent_q(spark, sf):
    conv = Tables(spark, sf).conversations
    return conv.select("conv_id", "turn", tx.classify_intent("text").alias("intent"))


_WORDS_SQL = "[" + ", ".join("'" + w + "'" for w in tx.OFFENSIVE_WORDS) + "]"


@query("offensive_flags", f"""
SELECT conv_id, turn,
       CAST(CASE WHEN {_sql_has(tx.OFFENSIVE_PATTERNS)} THEN 1 ELSE 0 END AS BIGINT) AS offensive_regex,
       CAST(CASE WHEN list_has_any(regexp_extract_all(lower(COALESCE(text, '')), '{tx.TOKEN_PATTERN}'),
                                   {_WORDS_SQL}) THEN 1 ELSE 0 END AS BIGINT) AS offensive_tokens
FROM conversations
""")
def offensive_flags_q(spark, sf):
    conv = Tables(spark, sf).conversations
    return conv.select("conv_id", "turn",
                       tx.is_offensive_regex("text").cast("long").alias("offensive_regex"),
                       tx.is_offensive_tokens("text").cast("long").alias("offensive_tokens"))


def _ordinal_sql() -> str:
    parts = []
    for words, n in tx.ORDINALS:
        cond = " OR ".join(f"strpos(lower(COALESCE(text, '')), '{w}') > 0" for w in words)
        parts.append(f"WHEN {cond} THEN {n}")
    return "CASE " + " ".join(parts) + " END"


@query("ordinal_ref", f"""
SELECT conv_id, turn, CAST({_ordinal_sql()} AS BIGINT) AS ordinal
FROM conversations
""")
def ordinal_ref_q(spark, sf):
    conv = Tables(spark, sf).conversations
    return conv.select("conv_id", "turn", tx.ordinal_ref("text").cast("long").alias("ordinal"))


# --- M13-M16: routing and follow-up answers ------------------------------------
def _book_meta(t: Tables):
    """Catalogue derived from part: one book per part name (its first part)."""
    first = t.part.groupBy("p_name").agg(F.min_by(F.struct("p_brand", "p_size", "p_type"), "p_partkey").alias("f"))
    return first.select(c("p_name").alias("title"), c("f.p_brand").alias("author"),
                        (F.lit(1990) + c("f.p_size")).cast("long").alias("year"),
                        F.when(c("f.p_type") != "PROMO", F.lit(100) + F.lit(10) * c("f.p_size")).cast("long")
                        .alias("pages"), c("f.p_type").alias("p_type"), c("f.p_size").alias("p_size"))


def _book_summaries(t: Tables):
    from shiftwise.operators.sets import priority_union
    meta = _book_meta(t)
    js = meta.where(c("p_size") > 10).select("title", F.concat(F.lit("Summary: "), F.lower("p_type"), F.lit(" "),
                                                                 c("title")).alias("summary"))
    md = meta.select("title", F.concat(F.lit("Catalogue entry for "), c("title")).alias("summary"))
    return priority_union([js, md], ["title"])


_META_SQL = """
first AS (SELECT p_name AS title, arg_min(p_brand, p_partkey) AS author, arg_min(p_size, p_partkey) AS p_size,
                 arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_name),
meta AS (SELECT title, author, CAST(1990 + p_size AS BIGINT) AS year,
                CAST(CASE WHEN p_type <> 'PROMO' THEN 100 + 10 * p_size END AS BIGINT) AS pages, p_type, p_size FROM first),
summ AS (SELECT title, 'Summary: ' || lower(p_type) || ' ' || title AS summary FROM meta WHERE p_size > 10
         UNION ALL
         SELECT title, 'Catalogue entry for ' || title FROM meta WHERE NOT (p_size > 10))
"""


@query("metadata_answer", f"""
WITH {_META_SQL},
q AS (SELECT v.conv_id, v.turn, v.text, p.p_name AS title, lower(COALESCE(v.text, '')) AS ql
      FROM conversations v LEFT JOIN part p ON p.p_partkey = v.conv_id WHERE v.role = 'user')
SELECT q.conv_id, q.turn, q.title,
  CASE WHEN q.title IS NULL THEN NULL
       WHEN strpos(ql, 'pagin') > 0 THEN CASE WHEN COALESCE(m.pages, 0) <> 0 THEN '„' || q.title || '” are ' || CAST(m.pages AS VARCHAR) || ' pagini.'
            ELSE 'Nu am local numărul de pagini pentru „' || q.title || '”. Pot însă să-ți ofer rezumatul sau alte recomandări.' END
       WHEN strpos(ql, 'autor') > 0 OR strpos(ql, 'scris') > 0 THEN CASE WHEN COALESCE(m.author, '') <> '' THEN '„' || q.title || '” este scrisă de ' || m.author || '.'
            ELSE 'Nu am local autorul pentru „' || q.title || '”. Pot să-ți ofer rezumatul sau alte recomandări.' END
       WHEN strpos(ql, 'anul') > 0 OR strpos(ql, 'publicat') > 0 OR strpos(ql, 'aparit') > 0 THEN CASE WHEN COALESCE(m.year, 0) <> 0 THEN '„' || q.title || '” a fost publicată în ' || CAST(m.year AS VARCHAR) || '.'
            ELSE 'Nu am local anul apariției pentru „' || q.title || '”. Pot să-ți ofer rezumatul sau alte recomandări.' END
       ELSE 'Despre „' || q.title || '”: iată rezumatul pe scurt.' END AS answer,
  CASE WHEN strpos(ql, 'pagin') > 0 OR strpos(ql, 'autor') > 0 OR strpos(ql, 'scris') > 0 OR strpos(ql, 'anul') > 0
            OR strpos(ql, 'publicat') > 0 OR strpos(ql, 'aparit') > 0 THEN NULL
       WHEN q.title IS NULL THEN NULL
       WHEN s.summary IS NOT NULL AND trim(s.summary) <> '' THEN s.summary
       ELSE 'Rezumat indisponibil pentru acest titlu.' END AS answer_summary
FROM q LEFT JOIN meta m ON m.title = q.title LEFT JOIN summ s ON s.title = q.title
""")
def metadata_answer_q(spark, sf):
    from shiftwise.operators.routing import metadata_answer
    t = Tables(spark, sf)
    qs = (t.conversations.where(c("role") == "user").select("conv_id", "turn", "text")
          .join(t.part.select(c("p_partkey").alias("conv_id"), c("p_name").alias("title")), "conv_id", "left"))
    res = metadata_answer(qs, "text", "title", _book_meta(t).select("title", "author", "year", "pages"),
                          _book_summaries(t))
    return res.select("conv_id", "turn", "title", "answer", "answer_summary")


def _route_sql() -> str:
    intent = (f"CASE WHEN {_sql_has(tx.INTENT_CODE)} THEN 'out_of_scope' "
              f"WHEN {_sql_has(tx.INTENT_ORDINAL)} THEN 'ordinal' "
              f"WHEN {_sql_has(tx.INTENT_PAGES)} OR {_sql_has(tx.INTENT_AUTHOR)} OR {_sql_has(tx.INTENT_YEAR)} "
              f"OR {_sql_has(tx.INTENT_THIS_BOOK)} THEN 'book_followup' ELSE 'recommendation' END")
    offensive = (f"list_has_any(regexp_extract_all(lower(COALESCE(text, '')), '{tx.TOKEN_PATTERN}'), {_WORDS_SQL})")
    return f"""
WITH RECURSIVE {_KEYS_SQL},
tw AS (SELECT DISTINCT key AS title, pos, unnest(list_distinct(regexp_extract_all(lower(key), '[\\pL\\pN]+'))) AS w FROM k),
u AS (SELECT conv_id, turn, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations WHERE role = 'user'),
qw AS (SELECT DISTINCT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(COALESCE(text, '')), '[\\pL\\pN]+'))) AS w FROM u),
sc AS (SELECT qw.conv_id, qw.turn, tw.title, tw.pos, COUNT(*) AS score FROM qw JOIN tw ON qw.w = tw.w
       GROUP BY qw.conv_id, qw.turn, tw.title, tw.pos),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pos) AS r FROM sc),
sl AS (SELECT conv_id, turn, list(title ORDER BY r) AS shortlist FROM top WHERE r <= 5 GROUP BY conv_id, turn),
p AS (SELECT u.conv_id, u.turn, u.rn,
             {_STRIP.format(x="COALESCE(u.text, '')")} = '' AS is_empty,
             {offensive.replace("text", "u.text")} AS offensive,
             {intent.replace("COALESCE(text", "COALESCE(u.text")} AS intent,
             {_ordinal_sql().replace("COALESCE(text", "COALESCE(u.text")} AS ord,
             COALESCE(sl.shortlist, CAST([] AS VARCHAR[])) AS shortlist
      FROM u LEFT JOIN sl ON u.conv_id = sl.conv_id AND u.turn = sl.turn),
s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS status,
         CAST(NULL AS VARCHAR) AS selected_title, CAST(NULL AS VARCHAR) AS context_title,
         CAST(NULL AS VARCHAR[]) AS shortlist, 0 AS used, CAST([] AS VARCHAR[]) AS last_list,
         CAST(NULL AS VARCHAR) AS last_title
  FROM p
  UNION ALL
  SELECT p.conv_id, p.rn, p.turn, x.status,
         CASE x.status WHEN 'followup' THEN s.last_title WHEN 'ordinal_pick' THEN s.last_list[p.ord]
                       WHEN 'candidates' THEN p.shortlist[1] END,
         s.last_title, p.shortlist,
         s.used + CASE WHEN x.status IN ('ordinal_pick', 'candidates') THEN 1 ELSE 0 END,
         CASE WHEN x.status = 'candidates' THEN p.shortlist ELSE s.last_list END,
         CASE WHEN x.status = 'candidates' THEN p.shortlist[1] ELSE s.last_title END
  FROM s JOIN p ON p.conv_id = s.conv_id AND p.rn = s.rn + 1,
       LATERAL (SELECT CASE WHEN p.is_empty THEN 'empty'
                            WHEN s.used >= 3 THEN 'blocked'
                            WHEN p.offensive THEN 'offensive'
                            WHEN p.intent = 'out_of_scope' THEN 'out_of_scope'
                            WHEN p.intent = 'book_followup' THEN CASE WHEN s.last_title IS NULL THEN 'need_title' ELSE 'followup' END
                            WHEN p.ord IS NOT NULL AND p.ord >= 1 AND p.ord <= len(s.last_list) THEN 'ordinal_pick'
                            WHEN len(p.shortlist) = 0 THEN 'no_results'
                            ELSE 'candidates' END AS status) x)
SELECT conv_id, turn, status, selected_title, context_title,
       CASE WHEN status = 'candidates' THEN 'Candidați disponibili: ' || array_to_string(shortlist, ', ') END AS prompt
FROM s WHERE rn > 0
"""


@query("route_queries", _route_sql())
def route_queries_q(spark, sf):
    """M14 status chain per user turn of each conversation (sequential context); recursive-CTE oracle."""
    from shiftwise.operators.routing import candidate_prompt, keyword_shortlist, route_queries
    t = Tables(spark, sf)
    qs = t.conversations.where(c("role") == "user").select(
        "conv_id", "turn", "text", F.concat_ws(":", c("conv_id").cast("string"), c("turn").cast("string")).alias("qid"))
    hits = keyword_shortlist(qs, "qid", "text", _title_keys(t), "p_name", "pos", k=5)
    routed = route_queries(qs, "conv_id", "turn", "text", hits, "qid")
    return routed.select("conv_id", "turn", "status", "selected_title", "context_title",
                         F.when(c("status") == "candidates", candidate_prompt(c("shortlist"))).alias("prompt"))
