"""Query routing for the book assistant.

Per query, in order: empty -> blocked (anonymous quota) -> offensive ->
out_of_scope -> book follow-up (need_title when no title is in context) ->
ordinal pick from the last shortlist -> no_results -> candidates.

Everything that depends only on the query text (guards, intent, ordinal,
retrieved shortlist) is computed set-based first.  The context (last
shortlist, last recommended title) and the quota counter depend on earlier
routing decisions of the same session, so one ordered pass per session
(``mapInPandas`` over rows partitioned by session and sorted by turn) applies
them - the same transition the source applied request by request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.functions.scalars import strip
from shiftwise.functions.text import classify_intent, is_offensive_tokens, ordinal_ref
from shiftwise.operators.matching import match_title
from shiftwise.streaming.chains import micros
from shiftwise.streaming.ordered import in_order
from shiftwise.streaming.quotas import ANON_LIMIT, ANON_TTL_S, _walk, segmented

_US = 1_000_000
# Fixed value: lifetime of a context.
CONTEXT_TTL_S = 3600

# Answer templates of the follow-up branch (title in quotes).
PAGES_OK = "„{t}” are {v} pagini."
PAGES_NA = "Nu am local numărul de pagini pentru „{t}”. Pot însă să-ți ofer rezumatul sau alte recomandări."
AUTHOR_OK = "„{t}” este scrisă de {v}."
AUTHOR_NA = "Nu am local autorul pentru „{t}”. Pot să-ți ofer rezumatul sau alte recomandări."
YEAR_OK = "„{t}” a fost publicată în {v}."
YEAR_NA = "Nu am local anul apariției pentru „{t}”. Pot să-ți ofer rezumatul sau alte recomandări."
ABOUT = "Despre „{t}”: iată rezumatul pe scurt."
SUMMARY_NA = "Rezumat indisponibil pentru acest titlu."
CANDIDATES_PREFIX = "Candidați disponibili: "

SUCCESS = ("ordinal_pick", "candidates")


def keyword_shortlist(queries: DataFrame, qid: str, text: str, titles: DataFrame, title_col: str,
                      pos_col: str, k: int = 5) -> DataFrame:
    """Retrieval stand-in when no query embeddings exist: titles ranked by the
    number of distinct words shared with the query (ties by title order), top k.

    Words of any length count; query words are exploded from the whole text.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))),
                                                           F.lit(r"([\pL\pN]+)"), 1))
    tw = titles.select(F.col(title_col).alias("_title"), F.col(pos_col).alias("_pos"),
                       F.explode(words(F.col(title_col))).alias("_w"))
    qw = queries.select(qid, F.explode(words(F.col(text))).alias("_w"))
    score = qw.join(tw, "_w").groupBy(qid, "_title", "_pos").agg(F.count(F.lit(1)).alias("_score"))
    w = Window.partitionBy(qid).orderBy(F.desc("_score"), "_pos")
    top = score.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    lists = top.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("_r", "_title"))).alias("_s"))
    return lists.select(qid, F.transform("_s", lambda s: s["_title"]).alias("shortlist"))


#: What a routing decision depends on, beside the state.
FEATURES = ("is_empty", "is_anonymous", "is_offensive", "intent", "ordinal", "shortlist")
#: The state of a session, and what a decision adds to a query.
ROUTE_STATE = "used bigint, quota_until bigint, last_list array<string>, last_title string, context_at bigint"
ROUTE_ADDS = "status string, selected_title string, context_title string"


def route_step(limit: int = ANON_LIMIT, quota_ttl_s: int | None = None, context_ttl_s: int | None = None):
    """State transition of a session: ``ROUTE_STATE`` x query (``FEATURES``, ``_us``) -> decision.

    The quota ends ``quota_ttl_s`` after its last counted use; the context once
    nothing has read or written it for more than ``context_ttl_s``.  Without a TTL
    neither ends.  Empty, blocked, offensive and out-of-scope queries don't touch the context.
    """
    def step(state, r):
        used, until, last_list, last_title, touched = state or (0, None, [], None, None)
        last_list, now = list(last_list or []), r.get("_us")
        if quota_ttl_s is not None and until is not None and now >= until:
            used, until = 0, None
        over = context_ttl_s is not None and touched is not None and now > touched + context_ttl_s * _US
        if r["is_empty"]:
            status = "empty"
        elif r["is_anonymous"] and used >= limit:
            status = "blocked"
        elif r["is_offensive"]:
            status = "offensive"
        elif r["intent"] == "out_of_scope":
            status = "out_of_scope"
        else:
            status = None
        title, chosen = None if over else last_title, None
        if status is None:
            if over:
                last_list, last_title = [], None
            touched = now
            found, n = list(r["shortlist"] if r["shortlist"] is not None else []), r["ordinal"]
            if r["intent"] == "book_followup":
                status, chosen = "need_title" if last_title is None else "followup", last_title
            elif n is not None and n == n and 1 <= int(n) <= len(last_list):
                status, chosen = "ordinal_pick", last_list[int(n) - 1]
            elif not found:
                status = "no_results"
            else:
                status, last_list, last_title, chosen = "candidates", found, found[0], found[0]
        if status in SUCCESS and r["is_anonymous"]:
            used, until = used + 1, None if quota_ttl_s is None else now + quota_ttl_s * _US
        return (used, until, last_list, last_title, touched), {"status": status, "selected_title": chosen, "context_title": title}
    return step


def query_features(queries: DataFrame, text: str, shortlists: DataFrame, qid: str, anonymous: Column | None = None) -> DataFrame:
    """``queries`` with ``FEATURES``: what can be told from a query alone, set-based."""
    q = strip(F.col(text))
    return queries.join(shortlists, qid, "left").withColumns({
        "is_empty": (F.coalesce(q, F.lit("")) == "").cast("boolean"), "is_anonymous": (anonymous if anonymous is not None else F.lit(True)).cast("boolean"),
        "is_offensive": is_offensive_tokens(text), "intent": classify_intent(text), "ordinal": ordinal_ref(text).cast("long"),
        "shortlist": F.coalesce(F.col("shortlist"), F.array().cast("array<string>"))})


def route_features(rows: DataFrame, session: str, order: Sequence[str], qid: str, ts: str | None = None, limit: int = ANON_LIMIT,
                   quota_ttl_s: int = ANON_TTL_S, context_ttl_s: int = CONTEXT_TTL_S) -> DataFrame:
    """M14 for rows with ``FEATURES``: adds status, selected title and context title.

    Sessions are walked in order, with key, order and features alone; the other
    columns are joined to the decisions by ``qid`` (unique).  With ``ts`` quota
    and context expire, so a silence of both TTLs ends a session's state and the
    walk of a busy session is split there; without it nothing expires.
    """
    times = [] if ts is None else [ts]
    thin = rows.select(*dict.fromkeys([session, *order, qid, *times, *FEATURES]))
    key, step = session, route_step(limit, *((quota_ttl_s, context_ttl_s) if ts else (None, None)))
    if ts is not None:
        thin = segmented(thin.withColumn("_us", micros(F.col(ts))), session, ts, max(quota_ttl_s, context_ttl_s) + 1)
        key = "_seg"
    adds = T.StructType.fromDDL(ROUTE_ADDS)
    out = T.StructType([*thin.schema.fields, *adds.fields])
    routed = _walk(thin, key, list(order), out, step).select(F.col(qid).alias("_qid"), *(f.name for f in adds.fields))
    return rows.join(routed, rows[qid].eqNullSafe(F.col("_qid"))).drop("_qid")


def route_queries(queries: DataFrame, session: str, order: str, text: str, shortlists: DataFrame, qid: str,
                  limit: int = ANON_LIMIT, anonymous: Column | None = None, ts: str | None = None) -> DataFrame:
    """Status, selected title and shortlist per query (see module doc); ``ts``: see ``route_features``."""
    rows = query_features(queries, text, shortlists, qid, anonymous)
    return route_features(rows, session, [order], qid, ts, limit).drop("is_empty", "is_offensive", "is_anonymous").withColumnsRenamed({"intent": "_intent", "ordinal": "_ordinal"})


def route_stream(rows: DataFrame, session: str, ts: str, tiebreak: str, limit: int = ANON_LIMIT, quota_ttl_s: int = ANON_TTL_S,
                 context_ttl_s: int = CONTEXT_TTL_S, watermark: str = "1 hour") -> DataFrame:
    """M14 on a stream of rows with ``FEATURES``; quota and context expire by event time."""
    def lives(state) -> int | None:
        _, until, _, _, touched = state
        ends = [x for x in (until, None if touched is None else touched + context_ttl_s * _US) if x is not None]
        return max(ends, default=0)

    return in_order(rows, session, ts, tiebreak, route_step(limit, quota_ttl_s, context_ttl_s), ROUTE_STATE, ROUTE_ADDS, watermark, lives)


def candidate_prompt(shortlist: Column) -> Column:
    """The candidate text shown to the model."""
    return F.concat(F.lit(CANDIDATES_PREFIX), F.array_join(shortlist, ", "))


def _known_as(df: DataFrame, title_col: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``_known``: the key of ``keys`` (title; ``pos`` or else the title tells their order) that its title matches."""
    k = keys.select(F.col("title").alias("_key"), F.col("pos" if "pos" in keys.columns else "title").alias("_place")).distinct()
    found = match_title(df.select(F.col(title_col).alias("_asked")).distinct(), "_asked", "_asked", k, "_key", "_place", out="_known")
    return df.join(found, F.col(title_col) == F.col("_asked"), "left").drop("_asked")


def summary_lookup(df: DataFrame, title_col: str, summaries: DataFrame, out: str = "summary") -> DataFrame:
    """Summary of the known title that a title matches (J10); blank or missing -> the fixed text.

    ``summaries`` holds ``title, summary`` already merged by source priority
    (``sets.priority_union``), and may have the order of its titles as ``pos``.
    """
    s = summaries.select(F.col("title").alias("_t"), F.col("summary").alias("_s"))
    j = _known_as(df, title_col, summaries).join(s, F.col("_known") == F.col("_t"), "left")
    val = F.when(F.col("_s").isNotNull() & (strip(F.col("_s")) != ""), F.col("_s")).otherwise(F.lit(SUMMARY_NA))
    return j.withColumn(out, F.when(F.col(title_col).isNotNull(), val)).drop("_t", "_s", "_known")


def metadata_answer(df: DataFrame, text: str, title_col: str, meta: DataFrame, summaries: DataFrame) -> DataFrame:
    """Follow-up answer about the title in context, looked up by J10.

    Keywords of the lower-cased question pick the field: ``pagin`` -> pages,
    ``autor``/``scris`` -> author, ``anul``/``publicat``/``aparit`` -> year,
    otherwise the summary.  Missing, zero or empty metadata gives the "not
    available" text.
    """
    m = meta.select(F.col("title").alias("_mt"), F.col("author").alias("_author"),
                    F.col("year").alias("_year"), F.col("pages").alias("_pages"))
    j = _known_as(df, title_col, meta).join(m, F.col("_known") == F.col("_mt"), "left").drop("_known")
    j = summary_lookup(j, title_col, summaries, "_summary")
    ql = F.lower(F.coalesce(F.col(text), F.lit("")))
    t = F.col(title_col)

    def fill(tpl: str, v: Column | None = None) -> Column:
        parts = tpl.split("{t}")
        out = [F.lit(parts[0]), t]
        rest = parts[1]
        if v is not None and "{v}" in rest:
            a, b = rest.split("{v}")
            out += [F.lit(a), v.cast("string"), F.lit(b)]
        else:
            out.append(F.lit(rest))
        return F.concat(*out)

    ans = (F.when(ql.contains("pagin"), F.when(F.coalesce(F.col("_pages"), F.lit(0)) != 0, fill(PAGES_OK, F.col("_pages")))
                  .otherwise(fill(PAGES_NA)))
            .when(ql.contains("autor") | ql.contains("scris"),
                  F.when(F.coalesce(F.col("_author"), F.lit("")) != "", fill(AUTHOR_OK, F.col("_author"))).otherwise(fill(AUTHOR_NA)))
            .when(ql.contains("anul") | ql.contains("publicat") | ql.contains("aparit"),
                  F.when(F.coalesce(F.col("_year"), F.lit(0)) != 0, fill(YEAR_OK, F.col("_year"))).otherwise(fill(YEAR_NA)))
            .otherwise(fill(ABOUT)))
    summary = F.when(~(ql.contains("pagin") | ql.contains("autor") | ql.contains("scris") | ql.contains("anul")
                       | ql.contains("publicat") | ql.contains("aparit")), F.col("_summary"))
    return (j.withColumn("answer", F.when(t.isNotNull(), ans)).withColumn("answer_summary", summary)
            .drop("_mt", "_author", "_year", "_pages", "_summary"))
