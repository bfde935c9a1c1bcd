"""The engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import events as E
from .operators import constraints, models, retrieval, signals, store, tables, validation
from .operators.cells import CellIndex
from .plans import ingest as flows
from .plans import recommend, reports
from .schema import STRUCTURED_EVENTS
from .sources import collect, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TARGETS = ["MSFT", "msft ", "BRK.B", "general market", "Market", "apple inc", "ZZZZ", ""]
S = "'" + X.SPACE + "'"
AT = "2026-05-10 20:30:15"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_views(sql: str) -> str:
    return views.WITH + sql


def q_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {S}, ' ', 'g'))"


def q_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{X.SPACE}', ''), '{X.SPACE}$', '')"


def q_truncate(x: str, n: int) -> str:
    return f"case when length({x}) <= {n} then {x} else regexp_replace(substring({x}, 1, {n}), '{X.SPACE}$', '') || '...' end"


def q_target(x: str) -> str:
    return f"case when lower({q_clean(x)}) in ('general market', 'market', 'broad market') then 'general-market' else lower({q_clean(x)}) end"


def q_display(x: str) -> str:
    return f"case when {q_target(x)} = 'general-market' then 'General Market' when {q_strip(x)} = '' then 'UNKNOWN' else upper({q_strip(x)}) end"


TARGETS_SQL = "(values " + ", ".join(f"('{t}')" for t in TARGETS) + ") t(target)"
SCORE_SQL = "case direction when 'Positive' then 1 when 'Negative' then -1 else 0 end * case importance when 'High' then 3 when 'Medium' then 2 else 1 end"


def match_sql(rows: str, columns: str = "target, s.*") -> str:
    """``own``: the rows of target and events that match."""
    return f"""
, raw_match as (
    select {columns}, ({SCORE_SQL})::bigint as score, {q_target('target')} as nt, {q_target('affected_asset')} as na from {rows}),
matched as (
    select * exclude (nt, na), case
        when na = 'general-market' then case when nt = 'general-market' then 'target' else 'market' end
        when na = nt then 'target'
        when case when nt = 'general-market' then nt else regexp_replace(nt, '[^a-z0-9]+', '', 'g') end <> ''
            and list_contains(regexp_extract_all(na, '[a-z0-9]+'), case when nt = 'general-market' then nt else regexp_replace(nt, '[^a-z0-9]+', '', 'g') end) then 'target' end as match
    from raw_match),
own as (select * from matched where match is not null)"""


def agg_sql(match: str, keys: str = "target") -> str:
    """``summed``: scores, conflicts, driver and summary by ``keys``."""
    return (
        match
        + f""",
sums as (
    select {keys}, count(*)::bigint as event_count, count(*) filter (match = 'target')::bigint as target_specific_event_count,
        coalesce(sum(score) filter (event_type = 'Macro'), 0)::bigint as macro_score, coalesce(sum(score) filter (event_type = 'Company'), 0)::bigint as company_score,
        coalesce(sum(score) filter (event_type = 'Sector'), 0)::bigint as sector_score, coalesce(sum(score) filter (event_type = 'Market'), 0)::bigint as market_score, sum(score)::bigint as net_score,
        case when bool_or(score > 0) and bool_or(score < 0) then '{signals.CONFLICT_BOTH}' end as c1,
        case when bool_or(score < 0 and time_horizon in ('Short-term', 'Both')) and bool_or(score > 0 and time_horizon in ('Long-term', 'Both')) then '{signals.CONFLICT_HORIZON}' end as c2
    from own group by {keys}),
tops as (
    select *, greatest(abs(macro_score), abs(company_score), abs(sector_score), abs(market_score)) as most,
        list_sort([x for x in [case when abs(macro_score) = greatest(abs(macro_score), abs(company_score), abs(sector_score), abs(market_score)) then 'Macro' end, case when abs(company_score) = greatest(abs(macro_score), abs(company_score), abs(sector_score), abs(market_score)) then 'Company' end,
            case when abs(sector_score) = greatest(abs(macro_score), abs(company_score), abs(sector_score), abs(market_score)) then 'Sector' end, case when abs(market_score) = greatest(abs(macro_score), abs(company_score), abs(sector_score), abs(market_score)) then 'Market' end] if x is not null]) as names
    from sums),
agg as (
    select *, case when most = 0 then 'No dominant driver' when len(names) > 1 then 'Mixed drivers across ' || array_to_string(names, ', ')
        else names[1] || ' signals are the dominant ' || case when case names[1] when 'Macro' then macro_score when 'Company' then company_score when 'Sector' then sector_score else market_score end > 0 then 'positive' else 'negative' end || ' driver' end as dominant_driver,
        concat_ws(' ', c1, c2) as conflicts
    from tops),
summed as (
    select *, 'Retrieved signals for ' || {q_display('target')} || ' are ' || case when net_score > 0 then 'overall positive' when net_score < 0 then 'overall negative' else 'balanced or mixed' end || '. ' || dominant_driver || '.' ||
        case when coalesce(c1, c2) is not null then ' Key conflict: ' || coalesce(c1, c2) else ' The aggregation is based on ' || event_count || ' structured event(s).' end as summary
    from agg)"""
    )


MATCH_SQL = match_sql(f"signals_v s, {TARGETS_SQL}")
AGG_SQL = agg_sql(MATCH_SQL)
KNN_SQL = """
, v as (select vec_id + 1 as article_id, embedding::double[] as e from embeddings),
far as (select q.article_id as question_id, c.article_id, greatest(0, 1 - list_cosine_similarity(q.e, c.e)) as d from v q join v c on true where (q.article_id - 1) % 20 = 0),
hits as (select question_id, article_id, round(d, 6) as distance, row_number() over (partition by question_id order by round(d, 12), article_id) as rank from far qualify rank <= 5)"""
HYDRATED_SQL = KNN_SQL + ", hydrated as (select h.*, source, title, url, published_at, content, summary from hits h left join articles_v using (article_id))"
SNIPPET = "coalesce(nullif({c_summary}, ''), nullif({body}, ''), {c_title})"
QUESTIONS_SQL = "select v.article_id as question_id, b.text as question from v join benchmark b on b.item_id = (v.article_id - 1) // 20 % 40"


def candidates_sql(questions: str) -> str:
    """``placed`` (candidates in their new order) and ``evidence`` of ``questions`` (question_id, question)."""
    return (
        HYDRATED_SQL
        + f""",
cand as (select question_id, article_id, rank as original_rank, rank::varchar as candidate_id, {q_clean("coalesce(title, 'Untitled')")} as title, coalesce(nullif({q_clean('summary')}, ''), nullif({q_clean('content')}, ''), {q_clean("coalesce(title, 'Untitled')")}) as body from hydrated),
candidates as (select * exclude (body), {q_truncate('body', 220)} as snippet from cand),
questions as ({questions}),
reranked as (
    select *, len(list_distinct(list_intersect(regexp_extract_all(lower(question), '[a-z0-9]+'), regexp_extract_all(lower(title || ' ' || snippet), '[a-z0-9]+'))))::bigint as overlap from candidates join questions using (question_id)),
placed as (select *, row_number() over (partition by question_id order by overlap desc, original_rank) as new_rank from reranked),
ex as (select p.question_id, p.article_id, new_rank as id, title, coalesce(url, 'N/A') as url, {q_clean('h.summary')} as s, {q_clean('h.content')} as c from placed p join (select question_id, article_id, url, summary, content from hydrated) h using (question_id, article_id) where new_rank <= 3),
excerpts as (select *, {q_truncate('c', 700)} as excerpt from ex),
bodies as (select *, coalesce(nullif(s, ''), nullif(excerpt, ''), title) as b2 from excerpts),
evidence as (select question_id, article_id, id, title, url, excerpt, {q_truncate('b2', 220)} as snippet from bodies)"""
    )


CANDIDATES_SQL = candidates_sql(QUESTIONS_SQL)
RANKING_SQL = "string_agg(new_rank || '. Candidate ' || candidate_id || ': ' || overlap || ' word(s) in common', chr(10) order by new_rank)"
RISKS_SQL = " || chr(10) || ".join(f"'- {r}'" for r in recommend.RISKS)
RECOMMENDED_SQL = (
    candidates_sql("select question_id, target as question from asked").replace(KNN_SQL, KNN_SQL + f""",
asked as (
    select article_id as question_id, ([{", ".join(f"'{t}'" for t in TARGETS)}])[(article_id - 1) // 20 % {len(TARGETS)} + 1] as target from v where (article_id - 1) % 20 = 0 union all values (-1, 'MSFT'), (-2, 'market'))""")
    + agg_sql(match_sql("evidence e join asked using (question_id) join signals_v s using (article_id)", "question_id, target, e.id as source_id, e.title as article_title, s.*"), "question_id, target")
    + f""",
cited as (select question_id, count(*)::bigint as n, string_agg('- [' || id || '] ' || title || ' (' || url || ')' || chr(10) || '  - Snippet: ' || snippet, chr(10) order by id) as listed from evidence group by question_id),
shown as (
    select question_id, target, string_agg('- [' || source_id || '] ' || article_title || ': ' || concat_ws(' / ', event_type, direction, importance, time_horizon) || ' (score ' || score || ')' || chr(10) || '  - Asset: ' || affected_asset || chr(10) || '  - Evidence: event ' || event_id, chr(10) order by source_id, structured_at, event_id) as events
    from own group by question_id, target),
ranking as (select question_id, {RANKING_SQL} as ranked from placed group by question_id),
routed as (
    select *, case when n is null then 'no_evidence' when net_score is null then 'no_signals' when target_specific_event_count = 0 and {q_target('target')} <> 'general-market' then 'market_only' else 'decide' end as route
    from asked left join cited using (question_id) left join summed using (question_id, target) left join shown using (question_id, target) left join ranking using (question_id)),
recommended as (
    select *, case when route = 'decide' and net_score > 2 then 'BUY' when route = 'decide' and net_score < -2 then 'SELL' else 'HOLD' end as decision, case when route = 'decide' and conflicts = '' then 'medium' else 'low' end as confidence, route <> 'decide' as insufficient_evidence,
        case route when 'no_evidence' then '{recommend.NO_EVIDENCE}' when 'no_signals' then '{recommend.NO_SIGNALS}' when 'market_only' then '{recommend.MARKET_ONLY}' else summary end as reasoning,
        case when route in ('market_only', 'decide') then n else 0 end as n_sources
    from routed)"""
)


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return views.articles(spark, sf).select("source", F.col("content").alias("raw_text"), "article_id", "published_at")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target string")


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return signals.match_events(targets(spark), views.signals(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return signals.aggregate_targets(targets(spark), views.signals(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("article_id"), "embedding")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20 searches all."""
    corpus = vectors(spark, sf)
    return retrieval.nearest(corpus, corpus.filter((F.col("article_id") - 1) % 20 == 0).withColumnRenamed("article_id", "question_id"), 5)


def hydrated(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hydrate(hits(spark, sf), views.articles(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf).join(views.table(spark, sf, "benchmark"), F.expr("item_id = (article_id - 1) div 20 % 40"))
    return own.select(F.col("article_id").alias("question_id"), F.col("text").alias("question"))


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lexical_rerank(retrieval.rerank_candidates(hydrated(spark, sf)), questions(spark, sf))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.reranked_evidence(hydrated(spark, sf), questions(spark, sf))


@query(with_views("select sha256(concat_ws('|', source, content, article_id::varchar)) as event_id, source, content as raw_text from articles_v where source in ('manual', 'news', 'api') and length(content) >= 50"))
def q01_valid_events(spark, sf):
    return E.validate(raw_events(spark, sf))[0].select(F.sha2(F.concat_ws("|", "source", "raw_text", F.col("article_id").cast("string")), 256).alias("event_id"), "source", "raw_text")


@query(with_views("select case when source not in ('manual', 'news', 'api') then 'invalid_source' else 'invalid_text' end as reason, count(*)::bigint as n from articles_v where source not in ('manual', 'news', 'api') or length(content) < 50 group by 1"))
def q02_rejected_events_by_reason(spark, sf):
    return E.validate(raw_events(spark, sf))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("select article_id, substring(content, 1, 100) as title, substring(content, 1, 200) as description, content, 'internal://' || source || '/' || article_id as url, string_split(content, chr(10))[1] as first_line from articles_v where source in ('manual', 'news', 'api') and length(content) >= 50"))
def q03_event_to_article_projection(spark, sf):
    return E.to_articles(E.validate(raw_events(spark, sf))[0], F.col("article_id").cast("string"), F.col("published_at")).select("article_id", "title", "description", "content", "url", "first_line")


@query(with_views("select case source when 'manual' then 0 when 'news' then 1 else 2 end as source_ord, article_id as row_ord, source, md5(content) as digest from articles_v where source <> 'rss'"))
def q04_union_sources_ordered(spark, sf):
    raw = raw_events(spark, sf)
    return collect.union_in_order([raw.filter(F.col("source") == s) for s in ("manual", "news", "api")], "article_id").select("source_ord", "row_ord", "source", F.md5("raw_text").alias("digest"))


@query(
    with_views("""
, tagged as (select article_id as ord, source, content, 'internal://' || source || '/' || md5(content) as url from articles_v),
old as (select ord as article_id, url from (select *, row_number() over (partition by url order by ord) as n from tagged where ord % 10 = 0) where n = 1),
fresh as (select * from (select *, row_number() over (partition by url order by ord) as n from tagged where ord % 10 <> 0) where n = 1 and url not in (select url from old))
select (select coalesce(max(article_id), 0) from old) + row_number() over (order by ord) as article_id, ord, url from fresh""")
)
def q05_dedup_insert_ids(spark, sf):
    url = F.concat(F.lit("internal://"), "source", F.lit("/"), F.md5("content"))
    rows = views.articles(spark, sf).withColumn("url", url).withColumnRenamed("article_id", "ord")
    old = E.insert_or_skip(spark.createDataFrame([], "article_id long, url string"), rows.filter("ord % 10 = 0"), "ord").select(F.col("ord").alias("article_id"), "url")
    return E.insert_or_skip(old, rows.filter("ord % 10 <> 0"), "ord").select("article_id", "ord", "url")


@query(with_views("select article_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published from articles_v where source = 'news'"))
def q06_articles_by_source_desc(spark, sf):
    return store.newest_first(views.articles(spark, sf), source="news").select("article_id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(with_views("select article_id, title from articles_v order by published_at desc, article_id limit 10"))
def q07_articles_limit(spark, sf):
    return store.newest_first(views.articles(spark, sf), 10).select("article_id", "title")


@query(with_views("select article_id, summary from articles_v where summary is null or trim(summary) = '' order by published_at desc, article_id limit 25"))
def q08_missing_summary_limit(spark, sf):
    return store.newest_first(store.missing_summary(views.articles(spark, sf)), 25).select("article_id", "summary")


@query(with_views("select article_id from articles_v where article_id not in (select article_id from signals_v) order by published_at desc, article_id limit 50"))
def q09_unstructured_antijoin_limit(spark, sf):
    return store.newest_first(store.unstructured(views.articles(spark, sf), views.signals(spark, sf)), 50).select("article_id")


@query(with_views("select article_id from (select * from articles_v order by published_at desc, article_id limit 50) where article_id not in (select article_id from signals_v)"))
def q10_structuring_backlog_limit_first(spark, sf):
    return store.structuring_backlog(views.articles(spark, sf), views.signals(spark, sf), 50).select("article_id")


@query(with_views("select count(*)::bigint as n from articles_v"))
def q11_count_articles(spark, sf):
    return views.articles(spark, sf).agg(F.count(F.lit(1)).alias("n"))


class Excerpts(models.OfflineProvider):
    """Summaries that never fail."""

    def summarise(self, title: str, description: str, content: str) -> list[str]:
        return [f"Title of {len(title)} characters", f"Description of {len(description)} characters", f"Text of {len(content)} characters"]


def figures(spark: SparkSession, found: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


def opened(spark: SparkSession) -> flows.Store:
    """An empty store in the shared folder."""
    return flows.Store.open(spark, tables.work_dir(spark))


def stored_articles(spark: SparkSession, sf: str) -> flows.Store:
    db = opened(spark)
    db.articles.append(views.articles(spark, sf).withColumn("fetched_at", F.col("published_at")))
    return db


def full_events(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with all columns of stored events."""
    return views.signals(spark, sf).select("*", F.lit("why").alias("reasoning"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("evidence_excerpt")).withColumn("event_id", F.col("event_id").cast("string"))


@query(with_views("select count(*)::bigint as total, count(distinct source || content)::bigint as saved, count(distinct source || content)::bigint as summarized, count(distinct source || content)::bigint as indexed, (count(*) - count(distinct source || content))::bigint as skipped from articles_v where source <> 'rss' and length(content) >= 50"))
def q12_ingest_stats(spark, sf):
    """The flow itself: everything is validated, inserted, summarised and indexed, and the figures are observed on the writes."""
    raw = raw_events(spark, sf).withColumnsRenamed({"article_id": "row_ord", "published_at": "seen_at"})
    return figures(spark, flows.ingest(opened(spark), raw, F.col("seen_at"), event_id=F.md5("raw_text"), make=Excerpts))


@query(with_views("select count(*)::bigint as total_candidates, count(*) filter (summary is null or trim(summary) = '')::bigint as processed, count(*) filter (summary is null or trim(summary) = '')::bigint as indexed, count(*) filter (trim(summary) <> '')::bigint as skipped from articles_v"))
def q13_summarize_stats(spark, sf):
    return figures(spark, flows.summarise_stored(stored_articles(spark, sf), make=Excerpts))


LEXICON = {"the": "Positive", "und": "Negative", "que": "Neutral", "les": "Positive"}


@query(
    with_views("""
, newest as (select * from articles_v order by published_at desc, article_id limit 500),
backlog as (select * from newest where article_id not in (select article_id from signals_v)),
words as (select article_id, regexp_extract_all(lower(content), '[a-z]+') as w from backlog)
select (select count(*) from backlog)::bigint as processed, (select coalesce(sum(len([x for x in ['the', 'und', 'que', 'les'] if list_contains(w, x)])), 0) from words)::bigint as created, ((select count(*) from newest) - (select count(*) from backlog))::bigint as skipped, 0::bigint as failures""")
)
def q14_structuring_stats(spark, sf):
    db = stored_articles(spark, sf)
    db.events.append(full_events(spark, sf))
    return figures(spark, flows.structure_stored(db, F.lit(AT).cast("timestamp"), limit=500, make=lambda: models.OfflineProvider(LEXICON)))


@query(with_views("select article_id, case when article_id % 3 = 0 then 'updated ' || article_id else summary end as summary, article_id % 3 = 0 as updated from articles_v"))
def q15_update_summary(spark, sf):
    own = views.articles(spark, sf)
    new = own.filter("article_id % 3 = 0").select("article_id", F.concat(F.lit("updated "), F.col("article_id").cast("string")).alias("summary"))
    return store.update_summaries(own, new).select("article_id", "summary", "updated")


@query(with_views("select 'articles' as name, count(*)::bigint as n from articles_v where article_id % 7 <> 0 union all select 'events', count(*)::bigint from signals_v where article_id % 7 <> 0"))
def q16_delete_cascade(spark, sf):
    a = views.articles(spark, sf)
    left, events = store.delete_articles(a, views.signals(spark, sf), a.select("article_id").filter("article_id % 7 = 0").unionByName(spark.range(0, 1000, 7).select(F.col("id").alias("article_id"))))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count(left, "articles").unionByName(count(events, "events"))


@query(with_views(", new as (select * from signals_v where event_id % 4 = 0) select article_id, event_id from signals_v where article_id not in (select article_id from new) union all select article_id, event_id from new"))
def q17_replace_events(spark, sf):
    own = views.signals(spark, sf)
    return store.replace_events(own, own.filter("event_id % 4 = 0")).select("article_id", "event_id")


@query(with_views(f"select article_id, {q_clean('content')} as cleaned, {q_clean('summary')} as cleaned_summary from articles_v"))
def q18_clean_text(spark, sf):
    return views.articles(spark, sf).select("article_id", X.clean(F.col("content")).alias("cleaned"), X.clean(F.col("summary")).alias("cleaned_summary"))


@query(with_views(f"select article_id, {q_truncate('content', 220)} as short, {q_truncate('content', 700)} as excerpt from articles_v"))
def q19_truncate(spark, sf):
    return views.articles(spark, sf).select("article_id", X.truncate(F.col("content"), 220).alias("short"), X.truncate(F.col("content"), 700).alias("excerpt"))


@query(with_views(f", b as (select article_id, coalesce(nullif({q_clean('summary')}, ''), nullif({q_clean('content')}, ''), {q_clean('title')}) as b from articles_v) select article_id, {q_truncate('b', 220)} as snippet from b"))
def q20_snippet_fallback(spark, sf):
    return views.articles(spark, sf).select("article_id", retrieval.snippet(X.clean(F.col("content"))).alias("snippet"))


@query(with_views("select article_id, case when summary <> '' then summary || chr(10) || title || chr(10) || coalesce(description, 'None') else title || '. ' || coalesce(description, 'None') || '. ' || content end as embedding_text from articles_v"))
def q21_embedding_text(spark, sf):
    return views.articles(spark, sf).select("article_id", retrieval.embedding_text().alias("embedding_text"))


@query(with_views(KNN_SQL + " select article_id, distance, rank from hits where question_id = 1"))
def q22_knn_single(spark, sf):
    corpus = vectors(spark, sf)
    return retrieval.nearest(corpus, corpus.filter("article_id = 1").withColumnRenamed("article_id", "question_id"), 5).select("article_id", F.round("distance", 6).alias("distance"), "rank")


@query(with_views(KNN_SQL + " select * from hits"))
def q23_knn_batch_topk(spark, sf):
    return hits(spark, sf).withColumn("distance", F.round("distance", 6))


@query(with_views(HYDRATED_SQL + " select question_id, article_id, rank, title, url, summary, content is not null as has_content from hydrated"))
def q24_hit_hydration(spark, sf):
    return hydrated(spark, sf).select("question_id", "article_id", "rank", "title", "url", "summary", F.col("content").isNotNull().alias("has_content"))


@query(with_views(CANDIDATES_SQL + " select question_id, candidate_id, original_rank, title, snippet, overlap, new_rank from placed"))
def q25_rerank_reorder(spark, sf):
    return reranked(spark, sf).select("question_id", "candidate_id", "original_rank", "title", "snippet", "overlap", "new_rank")


@query(
    with_views(
        KNN_SQL
        + """
, e as (select question_id, list(rank::varchar order by rank) as expected from hits group by 1),
a as (select question_id, expected, case question_id // 20 % 5 when 0 then list_reverse(expected) when 1 then expected[1:len(expected) - 1] when 2 then list_concat(expected[1:len(expected) - 1], expected[1:1]) when 3 then list_concat(expected[1:len(expected) - 1], ['99']) else expected end as actual from e)
select question_id, case when len(actual) <> len(expected) then 'Reranker must return the same number of candidate IDs it received' when len(list_distinct(actual)) <> len(actual) then 'Reranker returned duplicate candidate IDs'
    when len([x for x in actual if not list_contains(expected, x)]) > 0 then 'Reranker returned invalid candidate IDs: invented IDs: [''' || array_to_string([x for x in actual if not list_contains(expected, x)], ''', ''') || '''], missing IDs: [''' || array_to_string([x for x in expected if not list_contains(actual, x)], ''', ''') || ''']' end as error from a"""
    )
)
def q26_rerank_validation(spark, sf):
    ids = hits(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_list(F.col("rank").cast("string"))).alias("expected"))
    short = F.slice("expected", F.lit(1), F.size("expected") - 1)
    kind = F.expr("question_id div 20 % 5")
    actual = F.when(kind == 0, F.reverse("expected")).when(kind == 1, short).when(kind == 2, F.concat(short, F.slice("expected", 1, 1))).when(kind == 3, F.concat(short, F.array(F.lit("99")))).otherwise(F.col("expected"))
    return ids.withColumn("actual", actual).select("question_id", retrieval.rerank_error(F.col("expected"), F.col("actual")).alias("error"))


@query(with_views(CANDIDATES_SQL + " select * from evidence"))
def q27_evidence_rows(spark, sf):
    return evidence(spark, sf).select("question_id", "article_id", "id", "title", "url", "excerpt", "snippet")


@query(with_views(f"select event_id, ({SCORE_SQL})::bigint as score from signals_v"))
def q28_event_score(spark, sf):
    return views.signals(spark, sf).select("event_id", signals.score().alias("score"))


@query(with_views(AGG_SQL + " select target, event_count, target_specific_event_count, macro_score, company_score, sector_score, market_score, net_score from sums"))
def q29_bucket_scores(spark, sf):
    return scores(spark, sf).select("target", "event_count", "target_specific_event_count", "macro_score", "company_score", "sector_score", "market_score", "net_score")


@query(with_views(MATCH_SQL + " select target, affected_asset, match, count(*)::bigint as n from own group by all"))
def q30_target_match(spark, sf):
    return matched(spark, sf).groupBy("target", "affected_asset", "match").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(AGG_SQL + " select target, conflicts from agg"))
def q31_conflicts(spark, sf):
    return scores(spark, sf).select("target", F.array_join("conflicts", " ").alias("conflicts"))


@query(with_views(AGG_SQL + " select target, dominant_driver from agg"))
def q32_dominant_driver(spark, sf):
    return scores(spark, sf).select("target", "dominant_driver")


@query(with_views(AGG_SQL + " select target, summary from summed"))
def q33_aggregation_summary(spark, sf):
    return scores(spark, sf).select("target", "summary")


@query(with_views(MATCH_SQL + " select target, row_number() over (partition by target order by structured_at, event_id) as place, event_id, structured_at, score, match from own"))
def q34_target_events_ordered(spark, sf):
    return signals.ordered_events(matched(spark, sf)).select("target", "place", "event_id", "structured_at", "score", "match")


@query(with_views(AGG_SQL + f" select target, case when target = '' then 'no_evidence' when net_score is null then 'no_signals' when target_specific_event_count = 0 and {q_target('target')} <> 'general-market' then 'market_only' else 'decide' end as route from {TARGETS_SQL} left join sums using (target)"))
def q35_recommendation_routing(spark, sf):
    own = targets(spark).join(scores(spark, sf), "target", "left")
    return own.select("target", recommend.route(F.col("target") != "", F.col("net_score").isNotNull(), F.col("target_specific_event_count"), F.col("target")).alias("route"))


@query(with_views("select event_id, array_to_string(list_sort(list_distinct([c for c in [event_id % 5 - 1, article_id % 3, event_id % 5 - 1, 2] if c >= 1])), ' ') as citations from signals_v"))
def q36_citation_normalize(spark, sf):
    given = F.array(F.col("event_id") % 5 - 1, F.col("article_id") % 3, F.col("event_id") % 5 - 1, F.lit(2).cast("long"))
    return views.signals(spark, sf).select("event_id", F.array_join(F.transform(X.citations(given), lambda c: c.cast("string")), " ").alias("citations"))


@query(with_views(", c as (select event_id, list_sort(list_distinct([x for x in [event_id % 5, article_id % 7] if x >= 1 and x > 3])) as missing from signals_v) select event_id, case when len(missing) > 0 then 'Point citations reference unknown source ids: [' || array_to_string(missing, ', ') || ']' end as error from c"))
def q37_citation_check(spark, sf):
    point = F.struct(F.lit("p").alias("text"), F.array(F.col("event_id") % 5, F.col("article_id") % 7).alias("citations"))
    sources = F.array(*[F.struct(F.lit(k).cast("long").alias("id")) for k in (1, 2, 3)])
    return views.signals(spark, sf).select("event_id", validation.citation_error(F.array(point), sources).alias("error"))


_B = q_strip(f"regexp_replace({q_strip('x')}, '^[-* ]+', '')")


@query(with_views(f"select article_id, array_to_string(['- ' || {_B} for x in [substring(content, 1, 40), ' * ' || substring(content, 41, 30) || chr(9), '--  - ' || source]], chr(10)) as bullets from articles_v"))
def q38_bullet_render(spark, sf):
    c = F.col("content")
    given = F.array(F.substring(c, 1, 40), F.concat(F.lit(" * "), F.substring(c, 41, 30), F.lit("\t")), F.concat(F.lit("--  - "), F.col("source")))
    return views.articles(spark, sf).select("article_id", X.render_bullets(given).alias("bullets"))


NAMED_SQL = ", named as (select distinct target from (select affected_asset as target from signals_v union all select '  ' || p_name || chr(9) from part union all select p_type from part union all select n_name from nation))"


@query(with_views(NAMED_SQL + f" select target, {q_display('target')} as shown, {q_target('target')} as slug, '2026-05-10_203015_' || case when {q_target('target')} = 'general-market' then 'general-market' else coalesce(nullif(upper(trim(regexp_replace({q_strip('target')}, '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'TARGET') end || '.md' as filename from named"))
def q39_filename_and_display(spark, sf):
    """Of all assets that events name, and of the names of parts and nations."""
    part, name = views.table(spark, sf, "part"), lambda c: F.col(c).alias("target")
    parts = [views.signals(spark, sf).select(name("affected_asset")), part.select(F.concat(F.lit("  "), "p_name", F.lit("\t")).alias("target")), part.select(name("p_type")), views.table(spark, sf, "nation").select(name("n_name"))]
    own = reduce(DataFrame.unionByName, parts).distinct()
    return own.select("target", X.display_target(F.col("target")).alias("shown"), X.normalize_target(F.col("target")).alias("slug"), X.report_filename(F.col("target"), F.lit(AT).cast("timestamp")).alias("filename"))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    own = scores(spark, sf).withColumn("route", F.lit("decide")).withColumn("sources", F.array(F.struct(F.lit(1).cast("long").alias("id"), F.lit("Title").alias("title"), F.lit("u").alias("url"), F.lit("Snip").alias("snippet"))))
    return recommend.rule_decision(own)


@query(
    with_views(
        AGG_SQL
        + f"""
select target, '# Recommendation Report: ' || {q_display('target')} || chr(10) || chr(10) || '- Generated at: 2026-05-10T20:30:15' || chr(10) || '- Target: ' || {q_display('target')} || chr(10) ||
    '- Decision: ' || case when net_score > 2 then 'BUY' when net_score < -2 then 'SELL' else 'HOLD' end || chr(10) || '- Confidence: ' || case when conflicts <> '' then 'low' else 'medium' end || chr(10) || '- Time horizon: Long-term' || chr(10) || '- Insufficient evidence: no' || chr(10) || chr(10) ||
    '## Reasoning' || chr(10) || summary || chr(10) || chr(10) || '## Aggregation Summary' || chr(10) || summary || chr(10) || chr(10) || '- Dominant driver: ' || dominant_driver || chr(10) || '- Net score: ' || net_score || chr(10) || '- Macro score: ' || macro_score || chr(10) ||
    '- Company score: ' || company_score || chr(10) || '- Sector score: ' || sector_score || chr(10) || '- Market score: ' || market_score || chr(10) ||
    case when conflicts <> '' then chr(10) || '## Conflicts' || chr(10) || concat_ws(chr(10), '- ' || c1, '- ' || c2) || chr(10) else '' end || chr(10) || '## Key Risks' || chr(10) ||
    case when conflicts <> '' then concat_ws(chr(10), '- ' || c1, '- ' || c2) else '{reports.NO_RISKS}' end || chr(10) || chr(10) || '## Sources' || chr(10) || '- [1] Title (u)' || chr(10) || '  - Snippet: Snip' || chr(10) as report from summed"""
    )
)
def q40_report_markdown(spark, sf):
    return decided(spark, sf).select("target", reports.report_markdown(F.lit(AT).cast("timestamp")).alias("report"))


@query(
    with_views(
        CANDIDATES_SQL
        + """
select question_id, 'Answer:' || chr(10) || first(snippet order by id) || chr(10) || chr(10) || 'Confidence: medium' || chr(10) || 'Insufficient evidence: no' || chr(10) || chr(10) || 'Supporting Points:' || chr(10) || string_agg('- ' || title || ' [' || id || ']', chr(10) order by id)
    || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || id || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Snippet: ' || snippet, chr(10) || chr(10) order by id) as answer from evidence group by question_id"""
    )
)
def q41_answer_text(spark, sf):
    own = evidence(spark, sf)
    return recommend.answer(own.select("question_id").distinct(), own).select("question_id", reports.answer_text().alias("answer"))


@query("select user_id, arg_max(k, struct_pack(ts, event_id)) as k from (select user_id, ts, event_id, (props->>'$.k')::bigint as k from events) group by user_id")
def q42_newest_series_point(spark, sf):
    own = views.table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return own.groupBy("user_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))


@query(
    with_views("""
, w as (select article_id, title, unnest([struct_pack(w := 'les', d := 'Positive'), struct_pack(w := 'que', d := 'Neutral'), struct_pack(w := 'the', d := 'Positive'), struct_pack(w := 'und', d := 'Negative')]) as e, regexp_extract_all(lower(content), '[a-z]+') as words from articles_v)
select article_id, 'Company' as event_type, e.d as direction, 'General Market' as affected_asset, 'mentions ' || e.w as reasoning from w where list_contains(words, e.w)""")
)
def q43_structure_udtf(spark, sf):
    return models.structured(views.articles(spark, sf), lambda: models.OfflineProvider(LEXICON)).select("article_id", "event_type", "direction", "affected_asset", "reasoning")


_SENTENCES = f"string_split(regexp_replace(coalesce(content, ''), '([.!?]){X.SPACE}', '\\1' || chr(57344), 'g'), chr(57344))"


@query(
    with_views(f"""
, s as (select article_id, [{q_strip('x')} for x in {_SENTENCES} if {q_strip('x')} <> ''][1:3] as b from articles_v),
r as (select article_id, len(b) < 3 as short, [{_B} for x in b] as b from s)
select article_id, case when not short then array_to_string(['- ' || x for x in b], chr(10)) end as summary, case when short then 'ValueError: Summary needs 3 to 5 bullets' when list_contains(b, '') then 'empty bullet' end as error from r""")
)
def q44_summarize_udf(spark, sf):
    out = models.summarise(views.articles(spark, sf))
    return out.select("article_id", F.when(F.col("error").isNull(), X.render_bullets(F.col("bullets"))).alias("summary"), F.coalesce("error", validation.summary_error(F.col("bullets"))).alias("error"))


@query()
def q45_embed_udf(spark, sf):
    return views.articles(spark, sf).select("article_id", models.embed(retrieval.embedding_text()).alias("embedding"))


@query(with_views("select to_json(struct_pack(batch_id := 'batch-1', created_at := '2026-05-10T20:30:15', id := article_id, source := source, raw_text := content, timestamp := strftime(published_at, '%Y-%m-%dT%H:%M:%S')))::varchar as value from articles_v where source in ('manual', 'news', 'api') and length(content) >= 50"))
def q46_batch_json(spark, sf):
    events = E.validate(raw_events(spark, sf))[0].select(F.col("article_id").alias("id"), "source", "raw_text", X.iso(F.col("published_at")).alias("timestamp"))
    return reports.batch_json(events, "batch-1", "2026-05-10T20:30:15")


@query(with_views(f"select article_id, {q_strip("title || '. ' || description")} as raw_text from articles_v where length({q_strip("title || '. ' || description")}) >= 50"))
def q47_news_payloads(spark, sf):
    own = views.articles(spark, sf)
    payloads = own.select("article_id", F.to_json(F.struct(F.lit("ok").alias("status"), F.array(F.struct("title", "description")).alias("articles"))).alias("value"))
    parsed = payloads.select("article_id", F.from_json("value", collect.NEWS_PAYLOAD).alias("p")).select("article_id", "p.articles")
    return collect.news_rows(parsed).select("article_id", "raw_text")


@query(with_views("select article_id, 'SPY daily close: $' || article_id || ', volume: N/A. Market data from Alpha Vantage API.' as raw_text from articles_v"))
def q48_market_payloads(spark, sf):
    day = F.concat(F.lit('{"Time Series (Daily)": {"2024-01-01": {"4. close": "0"}, "2024-01-02": {"4. close": "'), F.col("article_id").cast("string"), F.lit('"}}}'))
    return collect.market(views.articles(spark, sf).select("article_id", day.alias("value"))).select("article_id", "raw_text")


@query(with_views("select date_trunc('hour', structured_at) as start, event_type, count(*)::bigint as n from signals_v group by all"))
def q50_windowed_counts(spark, sf):
    """The batch form of the stream's windowed counts."""
    own = views.signals(spark, sf).withColumn("ts", F.col("structured_at").cast("timestamp"))
    return own.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def asked_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A target per searching vector, and two for which nothing was found."""
    nth = F.expr(f"(article_id - 1) div 20 % {len(TARGETS)} + 1").cast("int")
    own = vectors(spark, sf).filter((F.col("article_id") - 1) % 20 == 0).select(F.col("article_id").alias("question_id"), F.element_at(F.array(*map(F.lit, TARGETS)), nth).alias("target"))
    return own.unionByName(spark.createDataFrame([(-1, "MSFT"), (-2, "market")], own.schema))


def recommended(spark: SparkSession, sf: str) -> DataFrame:
    events = views.signals(spark, sf).withColumn("evidence_excerpt", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return recommend.recommend(asked_targets(spark, sf), hydrated(spark, sf), events)


@query(with_views(RECOMMENDED_SQL + " select question_id, target, route, decision, confidence, insufficient_evidence, reasoning, coalesce(event_count, 0) as event_count, coalesce(target_specific_event_count, 0) as target_specific_event_count, coalesce(net_score, 0) as net_score, n_sources from recommended"))
def q51_recommend_routes(spark, sf):
    """The whole flow from hits to decisions, with all four routes; sums are zero where nothing matches."""
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("event_count", "target_specific_event_count", "net_score")]
    return recommended(spark, sf).select("question_id", "target", "route", "decision", "confidence", "insufficient_evidence", "reasoning", *numbers, F.size("sources").cast("long").alias("n_sources"))


SHOWN_SQL = f"""
select question_id, 'Recommendation:' || chr(10) || 'Decision: ' || decision || chr(10) || 'Confidence: ' || confidence || chr(10) || 'Time horizon: Long-term' || chr(10) || 'Insufficient evidence: ' || case when insufficient_evidence then 'yes' else 'no' end || chr(10) || chr(10) ||
    'Reasoning:' || chr(10) || reasoning || coalesce(chr(10) || chr(10) || 'Key Risks:' || chr(10) || case when insufficient_evidence then {RISKS_SQL} when conflicts <> '' then concat_ws(chr(10), '- ' || c1, '- ' || c2) end, '') ||
    case when summary is not null then chr(10) || chr(10) || 'Aggregation:' || chr(10) || '- Summary: ' || summary || chr(10) || '- Dominant driver: ' || dominant_driver || chr(10) || '- Net score: ' || net_score || case when conflicts <> '' then chr(10) || '- Conflicts:' || chr(10) || concat_ws(chr(10), '  - ' || c1, '  - ' || c2) else '' end else '' end ||
    case when n_sources > 0 then chr(10) || chr(10) || 'Sources:' || chr(10) || blocks else '' end as shown from recommended join asked using (question_id) left join (
        select question_id, string_agg('[' || id || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Snippet: ' || snippet, chr(10) || chr(10) order by id) as blocks from evidence group by question_id) using (question_id)"""


@query(with_views(RECOMMENDED_SQL + SHOWN_SQL))
def q49_recommendation_text(spark, sf):
    """The console form of all routes."""
    return recommended(spark, sf).select("question_id", reports.recommendation_text().alias("shown"))


@query(
    with_views(
        CANDIDATES_SQL
        + f"""
, ranking as (select question_id, {RANKING_SQL} as ranked from placed group by question_id)
select question_id, 'Answer:' || chr(10) || first(snippet order by id) || chr(10) || chr(10) || 'Confidence: medium' || chr(10) || 'Insufficient evidence: no' || chr(10) || chr(10) || 'Supporting Points:' || chr(10) || string_agg('- ' || title || ' [' || id || ']', chr(10) order by id)
    || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || id || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Snippet: ' || snippet, chr(10) || chr(10) order by id) || chr(10) || chr(10) || 'Rerank Debug:' || chr(10) || first(ranked) as answer from evidence join ranking using (question_id) group by question_id
union all select -1, 'Answer:' || chr(10) || '{recommend.NO_ANSWER}' || chr(10) || chr(10) || 'Confidence: low' || chr(10) || 'Insufficient evidence: yes'"""
    )
)
def q52_ask_debug(spark, sf):
    """Answers with the reranked order, and one question for which nothing was found."""
    found, asked = hydrated(spark, sf), questions(spark, sf)
    order = recommend.new_order(found, asked)
    own = retrieval.evidence(retrieval.reorder(found, order))
    every = own.select("question_id").distinct().unionByName(spark.createDataFrame([(-1,)], "question_id long"))
    answers = recommend.answer(every, own).join(order.select("question_id", "ranked_candidates"), "question_id", "left")
    return answers.select("question_id", reports.answer_text("ranked_candidates").alias("answer"))


@query(
    with_views(
        RECOMMENDED_SQL
        + f"""
select question_id, '# Recommendation Report: ' || {q_display('target')} || chr(10) || chr(10) || '- Generated at: 2026-05-10T20:30:15' || chr(10) || '- Target: ' || {q_display('target')} || chr(10) || '- Decision: ' || decision || chr(10) || '- Confidence: ' || confidence || chr(10) ||
    '- Time horizon: Long-term' || chr(10) || '- Insufficient evidence: ' || case when insufficient_evidence then 'yes' else 'no' end || chr(10) || chr(10) || '## Reasoning' || chr(10) || reasoning ||
    case when summary is not null then chr(10) || chr(10) || '## Aggregation Summary' || chr(10) || summary || chr(10) || chr(10) || '- Dominant driver: ' || dominant_driver || chr(10) || '- Net score: ' || net_score || chr(10) || '- Macro score: ' || macro_score || chr(10) || '- Company score: ' || company_score || chr(10) ||
        '- Sector score: ' || sector_score || chr(10) || '- Market score: ' || market_score else '' end ||
    case when conflicts <> '' then chr(10) || chr(10) || '## Conflicts' || chr(10) || concat_ws(chr(10), '- ' || c1, '- ' || c2) else '' end || chr(10) || chr(10) || '## Key Risks' || chr(10) ||
    case when insufficient_evidence then {RISKS_SQL} when conflicts <> '' then concat_ws(chr(10), '- ' || c1, '- ' || c2) else '{reports.NO_RISKS}' end || chr(10) || chr(10) || '## Sources' || chr(10) || case when n_sources > 0 then listed else '{reports.NO_SOURCES}' end ||
    coalesce(chr(10) || chr(10) || '## Aggregated Events' || chr(10) || events, '') || coalesce(chr(10) || chr(10) || '## Rerank Debug' || chr(10) || ranked, '') || chr(10) as report from recommended"""
    )
)
def q53_report_debug(spark, sf):
    """Reports of all routes with the aggregated events and the reranked order."""
    return recommended(spark, sf).select("question_id", reports.report_markdown(F.lit(AT).cast("timestamp"), "target_events", "ranked_candidates").alias("report"))


def article_index(spark: SparkSession, sf: str) -> CellIndex:
    index = CellIndex(spark, tables.work_dir(spark))
    index.build(vectors(spark, sf), recall=0.97)
    return index


def asking(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).filter((F.col("article_id") - 1) % 20 == 0).withColumnRenamed("article_id", "question_id")


@query(with_views(KNN_SQL + " select count(distinct question_id)::bigint as questions, count(*)::bigint as hits, count(*) filter (rank = 1 and article_id = question_id)::bigint as found_themselves, true as recall_reached from hits"))
def q54_saved_index_recall(spark, sf):
    """Vectors whose id is divisible by 20 search the saved cells; recall_reached: at least 95 in 100 of the exact neighbours are found."""
    found, exact = article_index(spark, sf).search(asking(spark, sf), 5), hits(spark, sf)
    both = exact.select("question_id", "article_id").join(found.select("question_id", "article_id", F.lit(1).alias("_f"), "rank"), ["question_id", "article_id"], "left")
    counted = both.agg(F.countDistinct("question_id").alias("questions"), F.count(F.lit(1)).alias("hits"), F.count_if((F.col("rank") == 1) & (F.col("article_id") == F.col("question_id"))).alias("found_themselves"), (F.count("_f") >= 0.95 * F.count(F.lit(1))).alias("recall_reached"))
    return counted


@query(with_views(KNN_SQL + " select * from hits"))
def q55_saved_index_all_cells(spark, sf):
    """With all cells the saved index is exact; some vectors were replaced and put back before, and some were deleted and put back."""
    index, own = article_index(spark, sf), vectors(spark, sf)
    some = own.filter("article_id % 7 = 0")
    index.upsert(some.withColumn("embedding", F.transform("embedding", lambda v: -v)))
    index.upsert(some)
    index.delete(own.filter("article_id % 11 = 0").select("article_id"))
    index.upsert(own.filter("article_id % 11 = 0"))
    return index.search(asking(spark, sf), 5, probes=10**6).withColumn("distance", F.round("distance", 6))


@query(with_views("select article_id, 'id' as by, title from articles_v where article_id % 20 = 0 union all select article_id, 'url', title from articles_v where article_id % 20 = 7"))
def q56_lookup_keys(spark, sf):
    """A twentieth of all ids, and of all urls, in the stored table."""
    db, own = stored_articles(spark, sf), views.articles(spark, sf)
    by_id = db.articles.of_keys(own.select("article_id").filter("article_id % 20 = 0")).select("article_id", F.lit("id").alias("by"), "title")
    return by_id.unionByName(db.articles.of_values("url", own.filter("article_id % 20 = 7").select("url")).select("article_id", F.lit("url").alias("by"), "title"))


@query(with_views("""
, first as (select row_number() over (order by article_id) as id, content from articles_v where article_id % 2 = 0),
kept as (select id, content from first where id % 3 <> 0 and id <= (select max(id) from first) - 10),
later as (select (select max(id) from first) + row_number() over (order by article_id) as id, content from articles_v where article_id % 2 = 1)
select id as article_id, md5(content) as digest from kept union all select id, md5(content) from later"""))
def q57_ids_after_deletion(spark, sf):
    """Half of the articles are stored, a third of them and the last ten deleted, and the other half stored: no id comes back."""
    db, own = opened(spark), views.articles(spark, sf).withColumn("fetched_at", F.col("published_at")).withColumnRenamed("article_id", "ord")
    db.articles.insert(own.filter("ord % 2 = 0"), "ord")
    last = db.articles.greatest()
    db.articles.delete(db.articles.read().filter((F.col("article_id") % 3 == 0) | (F.col("article_id") > last - 10)).select("article_id"))
    db.articles.insert(own.filter("ord % 2 = 1"), "ord")
    return db.articles.read().select("article_id", F.md5("content").alias("digest"))


@query(with_views("select article_id, row_number() over (partition by article_id order by structured_at, event_id::varchar) as place, event_id::varchar as event_id from signals_v where article_id % 5 <> 0 and article_id % 20 between 1 and 7"))
def q58_events_of_articles(spark, sf):
    """Events of a fifth of all articles are deleted from the stored table; those of some articles are listed in their order."""
    db = opened(spark)
    db.events.append(full_events(spark, sf), checked=False)
    ids = views.articles(spark, sf).select("article_id")
    db.events.delete(ids.filter("article_id % 5 = 0"))
    place = Window.partitionBy("article_id").orderBy("structured_at", "event_id")
    return db.events.of_keys(ids.filter("article_id % 20 between 1 and 7")).select("article_id", F.row_number().over(place).cast("long").alias("place"), "event_id")


@query(with_views("""
, bad as (select case when event_id % 50 = 1 then event_id - 1 else event_id end as event_id, case when event_id % 70 = 3 then article_id + 1000000 else article_id end as article_id, case when event_id % 11 = 0 then 'Up' else direction end as direction, case when event_id % 13 = 0 then null else importance end as importance from signals_v)
select 'invalid direction' as reason, count(*)::bigint as n from bad where direction = 'Up' union all select 'no importance', count(*)::bigint from bad where importance is null
union all select 'repeated event_id', count(*)::bigint from (select event_id from bad group by event_id having count(*) > 1) union all select 'unknown article_id', count(*)::bigint from bad where article_id not in (select article_id from articles_v)"""))
def q59_constraint_report(spark, sf):
    """What a table of events would refuse."""
    n = F.col("event_id").cast("long")
    bad = full_events(spark, sf).withColumns({"direction": F.when(n % 11 == 0, "Up").otherwise(F.col("direction")), "importance": F.when(n % 13 != 0, F.col("importance")), "article_id": F.when(n % 70 == 3, F.col("article_id") + 1_000_000).otherwise(F.col("article_id"))})
    bad = bad.withColumn("event_id", F.when(n % 50 == 1, n - 1).otherwise(n).cast("string"))
    return constraints.violations(bad, STRUCTURED_EVENTS, parents={"articles": views.articles(spark, sf)})
