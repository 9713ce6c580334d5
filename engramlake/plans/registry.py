"""All queries of the library's own operators by name, and DuckDB SQL for those that SQL can express.

which no two are as alike as the operators' own defaults ask for; unit tests hold the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engramlake.functions import decay as D, text as T, vector as V
from engramlake.operators import graph, links, metrics, ranking
from engramlake.plans import jobs, oracles, upkeep, views
from engramlake.plans.views import CHUNK, ENTRIES, NOW, QUERY
from engramlake.session import new_folder, stage, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MID, HIGH = 0.35, 0.42


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- pieces of SQL -----------------------------------------------------------------------------------------------

_TERMS = QUERY.split()
_count = lambda t, c="lower(text)": f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}"
_KW = " + ".join(map(_count, _TERMS))
_PATH = f"case when {' or '.join(f'contains(lower(rel), {t!r})' for t in _TERMS)} then 3 else 0 end"
_SCORED = f"scored as (select *, round(list_cosine_similarity(vector, (select embedding::double[] from embeddings where vec_id = 0)), 6) as sem, ({_KW} + {_PATH})::bigint as kw from chunk)"
_RANKED = """ranked as (select *, case when sem is not null then row_number() over (order by sem desc nulls last, ord) - 1 end as sem_rank, case when kw > 0 then row_number() over (order by kw desc, ord) - 1 end as kw_rank from scored),
fused as (select *, coalesce(1.0::double / (60 + sem_rank), 0) + coalesce(1.0::double / (60 + kw_rank), 0) as rrf from ranked)"""
_FACTOR = f"""least(1.5, greatest(0.3, (1 + 0.5 * pow(2, -d / 30) - 0.7 * (1 - pow(2, -d / 180))) * least(1.5, 1 + 0.15 * log2(access + 1)) * importance / 0.5))"""
_AGED = f"aged as (select *, greatest(0, ({NOW} - last_ms) / 86400000.0::double) as d from entries)"
_SURFACE = "importance / 0.5 * (1 - pow(2, -d / 21)) / (1 + 0.5 * log2(access + 1))"
_PAIRS = "pairs as (select x.ord as a, y.ord as b, x.rel as ra, y.rel as rb, x.date as da, y.date as db, round(list_cosine_similarity(x.vector, y.vector), 6) as sim from chunk x join chunk y on x.ord < y.ord and x.vector is not null and y.vector is not null)"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# --- scoring -----------------------------------------------------------------------------------------------------


@query("x01_cosine", _with(CHUNK, _SCORED) + "select ord, sem from scored")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.array(*map(F.lit, views.vector_of(spark, sf)))
    return views.chunk(spark, sf).select("ord", F.round(V.cosine(F.col("vector"), vec), 6).alias("sem"))


@query("x02_terms", f"select item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({', '.join(map(repr, T.RECALL_STOP))})), ' ') as terms from benchmark")
def x02(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query("x03_keyword_score", _with(CHUNK, _SCORED) + f"select ord, kw, ({_KW})::bigint as kw_deep from scored")
def x03(spark, sf):
    words = T.terms(F.lit(QUERY))
    return views.chunk(spark, sf).select("ord", T.keyword_score(F.col("text"), words, F.col("rel")).cast("long").alias("kw"), T.keyword_score(F.col("text"), words).alias("kw_deep"))


@query("x05_decay_factor", _with(ENTRIES, _AGED) + f"select rel, access, round({_FACTOR}, 6) as factor from aged")
def x05(spark, sf):
    return views.entries(spark, sf).select("rel", "access", F.round(D.decay_factor(F.col("access"), F.col("last_access_ms"), F.col("importance"), NOW), 6).alias("factor"))


@query(
    "x10_reconcile",
    _with(
        CHUNK,
        "p as (select c.ord as id, x.ord, x.rel, round(list_cosine_similarity(c.vector, x.vector), 6) as s from chunk c join chunk x on c.ord % 100 = 0 and x.rel <> c.rel and c.vector is not null and x.vector is not null)",
        f"r as (select *, row_number() over (partition by id order by s desc, ord) as n from p where s >= {MID})",
        "t as (select id, max(s) as top_score from p group by id)",
    )
    + f"""select c.ord as id, case when top_score >= {HIGH} then 'skip' when top_score >= {MID} then 'review' else 'new' end as action, top_score,
  coalesce((select string_agg(rel, ',' order by n) from r where r.id = c.ord and n <= 5), '') as paths from chunk c left join t on t.id = c.ord where c.ord % 100 = 0""",
)
def x10(spark, sf):
    c = views.chunk(spark, sf)
    r = links.reconcile(c.where("ord % 100 = 0").select(F.col("ord").alias("id"), "rel", "vector"), c, HIGH, MID)
    return r.select("id", "action", "top_score", F.array_join(F.transform("matches", lambda m: m["path"]), ",").alias("paths"))


@query("x17_a03_document_frequency", f"with w as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4 and w not in ({', '.join(map(repr, T.TOPIC_STOP))}) and not regexp_full_match(w, '[0-9]+')))) as word from documents) select word, count(*) as n from w group by 1")
def x17(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.topics(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "x18_theme_labels",
    _with(
        CHUNK.replace("left join", "join"),
        f"w as (select label, unnest(list_distinct({oracles.WORDS.format('text')})) as word from chunk)",
        "n as (select label, word, count(*) as n from w group by 1, 2 having count(*) >= 2)",
        "r as (select *, row_number() over (partition by label order by n desc, word) as r from n)",
    )
    + "select label::varchar as cluster, string_agg(word, ' · ' order by r) as theme from r where r <= 3 group by 1",
)
def x18(spark, sf):
    c = views.chunk(spark, sf).where("label is not null")
    return graph.theme_labels(c.select(F.col("label").cast("string").alias("cluster"), F.col("ord").alias("id")), c.select(F.col("ord").alias("id"), "text"))


@query("x20_high_signal", oracles.SIGNALS)
def x20(spark, sf):
    m = views.messages(spark, sf)
    marked = F.concat(F.when(F.col("role") == "user", F.concat(F.lit("We decided to keep "), "file", F.lit(" for now. "))).otherwise(""), "text")
    s = jobs.high_signal(m.select(F.concat("file", F.lit(":"), F.lpad(F.col("line").cast("string"), 6, "0")).alias("ord"), "role", marked.alias("text")))
    return s.withColumn("tags", F.array_join("tags", ","))


@query("x25_jaccard", _with("w as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) as w from documents)") + "select x.doc_id, round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::double, 6) as jaccard from w x join w y on y.doc_id = x.doc_id + 1")
def x25(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    after = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(after, "doc_id").select("doc_id", F.round(graph.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("x26_duration", "with s as (select user_id, floor(date_diff('millisecond', min(ts), max(ts)) / 1000)::bigint as s from events group by 1) select user_id, case when s >= 86400 then (s // 86400) || 'd' when s >= 3600 then (s // 3600) || 'h' when s >= 60 then (s // 60) || 'm' else s || 's' end as span from s")
def x26(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.floor((F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))) / 1000).alias("s"))
    return e.select("user_id", D.duration(F.col("s")).alias("span"))


@query("x27_x28_relevance", _with(ENTRIES, _AGED, "r as (select rel, round(importance * exp(-0.03 * d) * log2(access + 1.0::double) * 10, 6) as s from aged)") + "select rel, s as relevance, case when s >= 0.5 then 'active' when s >= 0.2 then 'fading' when s >= 0.05 then 'dormant' else 'archived' end as band from r")
def x27(spark, sf):
    e = views.entries(spark, sf)
    s = F.round(D.relevance(F.col("importance"), F.col("last_access_ms"), F.col("access"), F.lit(10.0), F.lit(False), NOW), 6)
    return e.select("rel", s.alias("relevance"), D.status_band(s).alias("band"))


# --- ranking -----------------------------------------------------------------------------------------------------


@query("w01_w02_w03_rrf", _with(CHUNK, _SCORED, _RANKED) + "select ord, sem_rank, kw_rank, round(rrf, 9) as rrf from fused")
def w03(spark, sf):
    s = ranking.scored(views.chunk(spark, sf), QUERY, views.vector_of(spark, sf))
    return ranking.rrf(s).select("ord", "sem_rank", "kw_rank", F.round("rrf", 9).alias("rrf"))


@query("q01_hybrid_recall", _with(CHUNK, ENTRIES, _AGED, _SCORED, _RANKED, f"weighed as (select f.*, case when a.d is null then 1 else {_FACTOR} end as factor from fused f left join aged a using (rel))") + "select ord, rel, sem, kw, round(rrf, 9) as rrf, round(factor, 6) as factor, round(rrf * factor, 9) as score from weighed order by rrf * factor desc, rrf desc, ord limit 20")
def q01(spark, sf):
    r = ranking.recall(views.chunk(spark, sf), QUERY, views.vector_of(spark, sf), 20, views.entries(spark, sf), NOW)
    return r.select("ord", "rel", "sem", "kw", F.round("rrf", 9).alias("rrf"), F.round("factor", 6).alias("factor"), F.round("score", 9).alias("score"))


@query("f01_filtered_recall", _with(CHUNK.replace("on doc_id = vec_id)", "on doc_id = vec_id where lang = 'en' and source = 'src0')"), _SCORED, _RANKED) + "select ord, sem_rank, kw_rank, round(rrf, 9) as rrf from fused order by rrf desc, ord limit 8")
def f01(spark, sf):
    r = ranking.recall(views.chunk(spark, sf), QUERY, views.vector_of(spark, sf), 8, type="en", tag="src0")
    return r.select("ord", "sem_rank", "kw_rank", F.round("rrf", 9).alias("rrf"))


@query("w05_two_stage_rerank", _with(CHUNK, _SCORED, _RANKED, "h as (select ord, (length(text) % 97)::double as rerank, row_number() over (order by rrf desc, ord) - 1 as pos from fused order by rrf desc, ord limit 50)") + "select ord, rerank, row_number() over (order by rerank desc, pos) - 1 as final from h order by 3 limit 10")
def w05(spark, sf):
    r = ranking.recall(views.chunk(spark, sf), QUERY, views.vector_of(spark, sf), 10, scorer=lambda text: (F.length(text) % 97).cast("double"))
    return r.select("ord", "rerank", "final")


@query("j04_knn", _with(CHUNK, _SCORED) + "select ord, rel, sem from scored order by sem desc, ord limit 10")
def j04(spark, sf):
    return ranking.scored(views.chunk(spark, sf), None, views.vector_of(spark, sf)).select("ord", "rel", "sem").orderBy(F.desc("sem"), "ord").limit(10)


@query("w08_best_per_file", _with(CHUNK, _SCORED, "n as (select *, row_number() over (partition by tags[1] order by sem desc, ord) as n from scored)") + "select tags[1] as file, ord, sem from n where n = 1")
def w08(spark, sf):
    s = ranking.scored(views.chunk(spark, sf), None, views.vector_of(spark, sf)).withColumn("file", F.element_at("tags", 1))
    return s.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy(F.desc("sem"), "ord"))).where("n = 1").select("file", "ord", "sem")


@query(
    "q02_deep_recall",
    _with(
        """u as (select 'thread' as src, '/threads/' || conv_id || '.jsonl:' || (turn + 1) as ref, text, null::double[] as vector, 1 as o, 0 as ord from conversations
    where strftime(date '2024-01-01' + (conv_id % 90)::int, '%Y-%m-%d') between '2024-01-10' and '2024-02-20'
  union all select 'note', source || '/' || doc_id || ':1', text, embedding::double[], 0, doc_id from documents left join embeddings on doc_id = vec_id)""",
        f"k as (select *, ({_KW})::bigint as kw, round(list_cosine_similarity(vector, (select embedding::double[] from embeddings where vec_id = 0)), 6) as sem from u)",
        """r as (select *, case when kw > 0 then row_number() over (order by kw desc, o, ord, ref) - 1 end as kw_rank,
    case when sem is not null then row_number() over (order by sem desc nulls last, o, ord, ref) - 1 end as sem_rank from k)""",
    )
    + """select src, ref, kw, sem, round(coalesce(1.0::double / (60 + kw_rank), 0) + coalesce(1.0::double / (60 + sem_rank), 0), 9) as rrf from r
order by coalesce(1.0::double / (60 + kw_rank), 0) + coalesce(1.0::double / (60 + sem_rank), 0) desc, o, ord, ref limit 20""",
)
def q02(spark, sf):
    m = views.messages(spark, sf).withColumnRenamed("kind", "src").withColumn("ref", F.concat("file", F.lit(":"), F.col("line").cast("string"))).withColumn("vector", F.lit(None).cast("array<double>"))
    r = jobs.deep_recall(views.chunk(spark, sf), m, QUERY, views.vector_of(spark, sf), 20, src="threads", after="2024-01-10", before="2024-02-20")
    return r.select("src", "ref", "kw", "sem", F.round("rrf", 9).alias("rrf"))


def _label_ranking(spark, sf, decayed: bool = False):
    c = views.chunk(spark, sf).where("vector is not null")
    q = c.where("ord % 100 = 0")
    rows = c.select("ord", "rel", "vector")
    if decayed:
        e = views.entries(spark, sf)
        weight = D.decay_factor(F.col("access"), F.col("last_access_ms"), F.col("importance"), NOW)
        rows = rows.join(e, "rel", "left").select("ord", "rel", "vector", weight.alias("weight"))
    hits = links.search(q.select(F.col("ord").alias("id"), "rel", "vector"), rows, 20)
    rel = q.select(F.col("ord").alias("query"), "label").join(c.select(F.col("ord").alias("id"), "label"), "label").where("query <> id").select("query", "id")
    return hits.select("query", F.col("ord").alias("id"), F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "ord")).alias("rank")), rel


_METRIC = _with(CHUNK.replace("left join", "join"), ENTRIES, _AGED, f"""p as (select q.ord as query, c.ord as id, c.label = q.label as hit, row_number() over (partition by q.ord order by round(list_cosine_similarity(c.vector, q.vector), 6) desc, c.ord) as rank,
  row_number() over (partition by q.ord order by round(round(list_cosine_similarity(c.vector, q.vector), 6) * case when aged.d is null then 1 else {_FACTOR} end, 6) desc, c.ord) as drank from chunk q join chunk c on q.ord % 100 = 0 and c.ord <> q.ord left join aged on aged.rel = c.rel)""",
    "n as (select query, count(*) filter (hit) as n from p group by 1)", "ks as (select unnest([1, 5, 10]) as k)")


def _metric(rank: str) -> str:
    return f"""select query, k, case when n = 0 then 1 else count(*) filter (hit and {rank} <= k) / n::double end as recall, count(*) filter (hit and {rank} <= k) / k::double as precision,
  coalesce(1 / min({rank}) filter (hit and {rank} <= 20)::double, 0) as mrr,
  case when n = 0 then 1 else coalesce(sum(1 / log2({rank} + 1)) filter (hit and {rank} <= k), 0) / list_sum(list_transform(range(1, greatest(1, least(k, n)) + 1), lambda i: 1 / log2(i + 1))) end as ndcg from p join n using (query), ks group by query, k, n"""


@query("x12_x16_metrics", _METRIC + f"select query, k, round(recall, 6) as recall, round(precision, 6) as precision, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from ({_metric('rank')})")
def x12(spark, sf):
    m = metrics.ir_metrics(*_label_ranking(spark, sf), ks=(1, 5, 10))
    return m.select("query", "k", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


@query("q16_a06_evaluation", _METRIC + f"select config, k, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from (select 'plain' as config, * from ({_metric('rank')}) union all select 'decay', * from ({_metric('drank')})) group by 1, 2")
def q16(spark, sf):
    plain, rel = _label_ranking(spark, sf)
    e = jobs.evaluate(rel, {"plain": plain, "decay": _label_ranking(spark, sf, True)[0]}, (1, 5, 10))
    return e.select("config", "k", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


# --- usage -------------------------------------------------------------------------------------------------------


@query("a05_merge_access", _with(ENTRIES, "h as (select distinct source || '/' || doc_id as rel from documents join labels using (doc_id))") + f"select rel, (coalesce(access, 0) + (h.rel is not null)::int)::int as access, case when h.rel is not null then {NOW} else last_ms end as last_access_ms, coalesce(importance, 0.5) as importance from entries full join h using (rel)")
def a05(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    hits = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel"))
    return jobs.merge_access(views.entries(spark, sf), hits, NOW)


@query(
    "q06_x06_surface",
    _with(ENTRIES, _AGED)
    + f"""select rel, round({_SURFACE}, 9) as score, round(d, 6) as age_days, access, importance,
  (case when importance >= 0.75 then 'high-importance' when importance <= 0.35 then 'low-importance' else 'important' end)
  || ' · last seen ' || round(d)::bigint || 'd ago · ' || access || ' recall' || (case when access = 1 then '' else 's' end) as reason
from aged where d >= 3 order by 2 desc, rel limit 5""",
)
def q06(spark, sf):
    return jobs.surface(views.entries(spark, sf), NOW)


@query("q08_prune_candidates", _with(ENTRIES, _AGED) + f"select rel, access, last_ms as last_access_ms, importance, round({_FACTOR}, 9) as factor, round(d, 6) as age_days from aged where importance < 0.6 and d >= 90 and {_FACTOR} <= 0.5 order by 5, rel limit 50")
def q08(spark, sf):
    return jobs.prune_candidates(views.entries(spark, sf), NOW, factor=0.5)


@query("j11_anti_join_deleted", "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def j11(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("a10_monthly_digest", "select strftime(ts, '%Y-%m') as month, event_type as action, count(*) as n from events group by 1, 2")
def a10(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("q13_advisor", "with s as (select count(*) as chunks from documents) select '--with-cron' as flag, 'recommend' as severity, 'staleness' as reason, '2h' as measured union all select '--with-sqlite-vec', 'recommend', 'scale', chunks::varchar from s where chunks >= 800 union all select '--with-reranker', 'suggest', 'precision', chunks::varchar from s where chunks >= 200")
def q13(spark, sf):
    s = table(spark, sf, "documents").agg(F.count("*").alias("chunks")).select("chunks", F.lit(NOW).alias("content_ms"), F.lit(NOW - 7_500_000).alias("index_ms"), *(F.lit(v).alias(c) for c, v in (("has_cron", True), ("has_store", False), ("has_model", False))))
    return jobs.advise(s, 800, 200)


@query(
    "q07_q09_consolidate",
    _with(
        CHUNK, ENTRIES, _AGED, _PAIRS,
        f"dup as (select least(ra, rb) as a, greatest(ra, rb) as b, sim from pairs where sim >= {MID} order by sim desc, 1, 2 limit 40)",
        f"prune as (select rel, round({_FACTOR}, 9) as factor from aged where importance < 0.6 and d >= 90 and {_FACTOR} <= 0.35 order by 2, rel limit 50)",
        f"shown as (select rel, round({_SURFACE}, 9) as score from aged where d >= 3 and rel not in (select rel from prune) order by 2 desc, rel limit 5)",
        "flagged as (select distinct rel from chunk where contains(text, 'reconcile: review') order by rel limit 30)",
    )
    + f"""select case when sim >= {HIGH} then 'DUP' else 'SIM' end as section, a || ' ~ ' || b as item, sim as value from dup union all select 'PRUNE', rel, factor from prune
union all select 'SURFACE', rel, score from shown union all select 'REVIEW', rel, null from flagged""",
)
def q09(spark, sf):
    return jobs.consolidate(views.chunk(spark, sf), views.entries(spark, sf), NOW, mid=MID, high=HIGH)


# --- links and graph ---------------------------------------------------------------------------------------------


@query("j03_q07_near_duplicates", _with(CHUNK, _PAIRS) + f"select least(ra, rb) as a, greatest(ra, rb) as b, sim, case when sim >= {HIGH} then 'DUP' else 'SIM' end as label from pairs where sim >= {MID} order by sim desc, 1, 2 limit 40")
def j03(spark, sf):
    return links.near_duplicates(views.chunk(spark, sf), MID, HIGH)


def _notes(spark, sf):
    c = views.chunk(spark, sf)
    return c.select(F.col("ord").alias("id"), "vector", links.time_ms(F.lit(None).cast("long"), F.col("date")).alias("ms"), F.array(F.concat(F.lit("E"), (F.col("ord") % 97).cast("string"))).alias("entities"))


_LINKS = _with(
    CHUNK, _PAIRS,
    "l as (select a, b, sim, abs(date_diff('day', da::date, db::date))::double as days, (a % 97 = b % 97)::int as shared from pairs)",
    """w as (select *, case when sim >= 0.35 then 0.15 + 0.85 * least(1, greatest(0, (sim - 0.35) / (0.85::double - 0.35::double))) else 0 end as s,
  case when days <= 14 then 1 - days / 14 else 0 end as t, least(1, shared / 3.0::double) as e from l where sim < 0.85)""",
)


@query(
    "j02_x08_g01_links",
    _LINKS
    + """select a, b, sim, days, shared::bigint as shared, round(least(1, 0.60::double * s + 0.25::double * t + 0.15::double * e), 6) as weight,
  array_to_string(list_filter([case when s > 0 then 'semantic' end, case when t > 0 then 'temporal' end, case when e > 0 then 'entity' end], lambda x: x is not null), ' + ') as reason
from w where round(0.60 * s + 0.25 * t + 0.15 * e, 6) > 0""",
)
def g01(spark, sf):
    return links.build_links(_notes(spark, sf), per_node=None).drop("signals")


@query("w09_degree_cap", _LINKS + "," + oracles.CAPPED)
def w09(spark, sf):
    return links.build_links(_notes(spark, sf)).drop("signals")


@query("j15_traverse", _LINKS + ", e as (select a, b from w where s > 0), u as (select a, b from e union select b, a from e), h1 as (select distinct b as node from u where a = 0 and b <> 0) select 0 as node, 0 as hop union all select node, 1 from h1 union all select distinct b, 2 from u join h1 on u.a = h1.node where b <> 0 and b not in (select node from h1)")
def j15(spark, sf):
    e = links.all_pairs(_notes(spark, sf), 0.35).where("sim < 0.85")
    return jobs.traverse(e, spark.range(1).select(F.col("id").alias("node")))


@query("g11_q04_connect", _with(CHUNK.replace("left join", "join")) .rstrip() + "," + oracles.CONNECTED)
def g11(spark, sf):
    c = views.chunk(spark, sf).where("vector is not null")
    seeds = c.where("ord % 100 = 0").select(F.col("ord").alias("seed"), F.col("rel").alias("seed_rel"), F.col("vector").alias("seed_vector"))
    return links.connect(c, seeds, floor=0.2).select("seed", "id", "rel", F.round("redundancy", 6).alias("redundancy"), F.round("mmr", 6).alias("mmr"), "pos")


@query("a01_pool_notes", _with(CHUNK, "v as (select tags[1] as rel, generate_subscripts(vector, 1) as i, unnest(vector) as x from chunk)", "m as (select rel, i, avg(x) as x, count(*) as n from v group by 1, 2)", "f as (select rel, i, case when n > 1 then x / sqrt(sum(x * x) over (partition by rel)) else x end as x, n from m)") + "select rel, n as n_chunks, round(x, 6) as first from f where i = 1")
def a01(spark, sf):
    c = views.chunk(spark, sf).withColumn("rel", F.element_at("tags", 1))
    return graph.pool_notes(c).select("rel", "n_chunks", F.round(F.element_at("vector", 1), 6).alias("first"))


def _rounds(spark, sf):
    p = stage(links.all_pairs(_notes(spark, sf), MID).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("sim").alias("weight")), "pairs")
    g = spark.createDataFrame([], graph.EDGE)
    for n, floor in enumerate((MID, 0.38, MID), 1):
        g = graph.reinforce(g, p.where(F.col("weight") >= floor), n)
    return g


_EDGES = _with(
    CHUNK, _PAIRS,
    f"e as (select least(a::varchar, b::varchar) as a, greatest(a::varchar, b::varchar) as b, sim from pairs where sim >= {MID})",
    "r as (select *, case when sim >= 0.38 then 3 else 2 end as rec from e)",
)


@query(
    "g02_g04_reinforce",
    _EDGES
    + """select a, b, rec::bigint as recurrence, 1::bigint as first_round, 3::bigint as last_round, round(sim, 6) as ema,
  round(least(1.5, sim * (1 + 0.5 * least(1, rec / 5.0::double))), 8) as neural_score from r""",
)
def g02(spark, sf):
    return _rounds(spark, sf).withColumn("ema", F.round("ema", 6)).withColumn("neural_score", F.round("neural_score", 8))


@query(
    "g03_g04_forgetting",
    _EDGES
    + """, s as (select a, b, sim, case when sim >= 0.40 then 14 when sim >= 0.38 then 2 else 1 end as last, case when sim >= 0.40 then 3 when sim >= 0.38 then 2 else 1 end as rec from e)
select a, b, rec::bigint as recurrence, 1::bigint as first_round, last::bigint as last_round, round(sim, 6) as ema,
  round(least(1.5, sim * (1 + 0.5 * least(1, rec / 5.0::double)) * pow(0.5, (14 - last) / 6.0::double)), 8) as neural_score from s where 14 - last <= 12""",
)
def g03(spark, sf):
    """Edges last seen 13 rounds ago are forgotten, those of 12 rounds ago have faded."""
    p = stage(links.all_pairs(_notes(spark, sf), MID).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("sim").alias("weight")), "pairs")
    g = spark.createDataFrame([], graph.EDGE)
    for n, floor in ((1, MID), (2, 0.38), (14, 0.40)):
        g = graph.reinforce(g, p.where(F.col("weight") >= floor), n)
    return g.withColumn("ema", F.round("ema", 6)).withColumn("neural_score", F.round("neural_score", 8))


@query(
    "g05_dense_clusters",
    _EDGES.rstrip() + "," + oracles.CLUSTERS
    + "\nselect cluster, array_to_string(members, ',') as members, n_edges, round(density, 6) as density, round(strength, 8) as strength, min_recurrence from clusters",
)
def g05(spark, sf):
    return graph.dense_clusters(_rounds(spark, sf)).select("cluster", F.array_join("members", ",").alias("members"), "n_edges", F.round("density", 6).alias("density"), F.round("strength", 8).alias("strength"), "min_recurrence")


@query(
    "g06_g07_q05_insights",
    _EDGES.rstrip() + "," + oracles.CLUSTERS + "," + oracles.INSIGHTS
    + "\nselect id, array_to_string(members, ',') as members, strength, size, runs, first_ms, last_ms, status from insights",
)
def g07(spark, sf):
    clusters = graph.promotable(graph.dense_clusters(_rounds(spark, sf)), recurrence=2)
    first = graph.merge_insights(spark.createDataFrame([], graph.INSIGHT), clusters, NOW)
    return graph.merge_insights(first, clusters, NOW + 1).withColumn("members", F.array_join("members", ","))


@query("g08_j08_contradictions", _with(CHUNK).rstrip() + "," + oracles.CONTRADICTIONS)
def g08(spark, sf):
    c = views.chunk(spark, sf)
    stance = F.when(F.col("ord") % 2 == 0, "We prefer ").otherwise("Never use ")
    m = c.select(F.floor(F.col("ord") / 12).cast("string").alias("cluster"), F.col("ord").alias("id"), F.col("ord").alias("pos"))  # of a cluster's greatest size
    return graph.contradictions(m, c.select(F.col("ord").alias("id"), F.concat(stance, "text").alias("text"))).withColumn("shared", F.array_join(F.array_sort("shared"), ","))


# --- ingest ------------------------------------------------------------------------------------------------------


@query("p01_chunk_text", oracles.CHUNKS)
def p01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("n", "c"))
    return d.select("doc_id", "n", "c.start_line", F.md5("c.text").alias("text_md5"))


@query(
    "p03_p04_p20_p21_paths",
    """with p as (select doc_id, ['memory/05-connections/a.md', 'memory/02-semantic/patterns/b.md', 'memory/01-episodic/2024-03-05.md', 'memory/02-semantic/c.md',
    'notes/2024-03-05.md', 'SOUL.md', 'x/templates/t.md'][(doc_id % 7 + 1)::int] as rel, left(split_part(text, chr(10), 1), 80) as title from documents)
select doc_id, ['connection', 'pattern', 'episodic', 'semantic', 'episodic', 'core', 'template'][(doc_id % 7 + 1)::int] as kind,
  regexp_extract(rel, '[0-9]{4}-[0-9]{2}-[0-9]{2}') as date,
  left(coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'note'), 50) as slug from p""",
)
def p03(spark, sf):
    paths = ["memory/05-connections/a.md", "memory/02-semantic/patterns/b.md", "memory/01-episodic/2024-03-05.md", "memory/02-semantic/c.md", "notes/2024-03-05.md", "SOUL.md", "x/templates/t.md"]
    rel = F.element_at(F.array(*map(F.lit, paths)), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", T.infer_type(rel).alias("kind"), T.path_date(rel).alias("date"), T.slug(T.title(F.col("text"))).alias("slug"))


@query("p11_strip_wrappers", "select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations")
def p11(spark, sf):
    noisy = F.concat(F.lit("<system-reminder>a\nb</system-reminder>"), "text", F.lit("</command-name> "))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_wrappers(noisy).alias("text"))


@query("p14_p15_split_long", "with" + oracles.UNITS + "\nselect file, line, sub, id, length(text)::int as n_chars from units")
def p14(spark, sf):
    from engramlake.sources import transcripts

    return transcripts.units(views.messages(spark, sf)).select("file", "line", "sub", "id", F.length("text").alias("n_chars"))


@query("p16_unit_id", "select conv_id, turn, left(sha1('/threads/' || conv_id || '.jsonl:' || (turn + 1) || ':0:' || left(text, 80)), 16) as id from conversations")
def p16(spark, sf):
    m = table(spark, sf, "conversations")
    return m.select("conv_id", "turn", T.unit_id(F.concat(F.lit("/threads/"), F.col("conv_id").cast("string"), F.lit(".jsonl")), F.col("turn") + 1, F.lit(0), F.col("text")).alias("id"))


@query("p17_redact", oracles.REDACTED)
def p17(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", T.redact(F.col("text")).alias("r")).where("r.redacted > 0")
    return r.select("doc_id", F.md5("r.text").alias("text_md5"), F.col("r.redacted").cast("int").alias("redacted"))


@query("x21_x22_hashes", "select doc_id, left(sha256('note' || chr(10) || text || chr(10)), 8) as hash from documents")
def x22(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.lit("note"), F.col("text")).alias("hash"))


@query("f10_snippet", "select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 140) as snippet from documents")
def f10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("p02_p22_front_matter", "select doc_id, lang as type, 'active' as status, '2024-03-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as date, source || ',kept' as tags, md5(coalesce(text, '')) as body_md5 from documents")
def p02(spark, sf):
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    head = F.concat(F.lit("---\ntype: "), "lang", F.lit("\ndate: "), day, F.lit("\ntags: ["), "source", F.lit(", kept]\n---\n"))
    d = table(spark, sf, "documents").withColumn("note", F.concat(head, F.coalesce("text", F.lit("")))).withColumn("m", T.front_matter(F.lit("notes/a.md"), F.col("note")))
    return d.select("doc_id", "m.type", "m.status", "m.date", F.array_join("m.tags", ",").alias("tags"), F.md5(T.without_front_matter(F.col("note"))).alias("body_md5"))


@query(
    "p05_p07_transcript_lines",
    """select case role when 'user' then '/w/memory/threads/' when 'assistant' then '/h/.claude/projects/p/' else '/w/session-archive-' end || conv_id || '.jsonl' as file, turn + 1 as line,
  case role when 'user' then 'thread' when 'assistant' then 'engineer' else 'archive' end as kind, case role when 'assistant' then 'assistant' else 'user' end as role,
  md5(case role when 'assistant' then text || chr(10) || 'second block' when 'user' then text else trim(text) end) as text_md5 from conversations where trim(text) <> ''""",
)
def p05(spark, sf):
    from engramlake.sources import transcripts

    thread = F.to_json(F.struct(F.lit("user_message").alias("type"), F.lit("2024-01-01").alias("timestamp"), F.struct(F.col("text").alias("content")).alias("data")))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", F.col("text")), block("thinking", F.lit("hidden")), block("text", F.lit('{"type":"tool"}')), block("text", F.lit("second block")))
    session = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(blocks.alias("content")).alias("message")))
    labelled = F.concat(F.lit('Conversation info (untrusted metadata):\n```json\n{"a": 1}\n```\n'), "text")
    archived = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("user").alias("role"), labelled.alias("content")).alias("message")))
    by = lambda user, assistant, other: F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(other)
    file = F.concat(by(F.lit("/w/memory/threads/"), F.lit("/h/.claude/projects/p/"), F.lit("/w/session-archive-")), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    lines = table(spark, sf, "conversations").select(file.alias("file"), (F.col("turn") + 1).alias("line"), by(thread, session, archived).alias("value"))
    return transcripts.parse_lines(transcripts.classify(lines)).select("file", "line", "kind", "role", F.md5("text").alias("text_md5"))


@query("s09_evaluation_set", "select item_id as line, md5(text) as query_md5, 'b' || item_id as relevant from benchmark where trim(text) <> ''")
def s09(spark, sf):
    from engramlake.sources import notes

    value = F.to_json(F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("b"), F.col("item_id").cast("string"))).alias("relevant")))
    e = notes.read_eval(table(spark, sf, "benchmark").select(F.col("item_id").alias("line"), value.alias("value")))
    return e.where("skip_reason is null").select("line", F.md5("query").alias("query_md5"), F.array_join("relevant", ",").alias("relevant"))


@query(
    "j12_t03_u03_new_units",
    "with" + oracles.UNITS
    + """, first as (select *, row_number() over (partition by id order by file, line, sub) as r from units)
select id, file, line, sub from first where r = 1 and id not in (select id from units where role = 'user')""",
)
def j12(spark, sf):
    from engramlake.sources import transcripts

    u = transcripts.units(views.messages(spark, sf))
    return transcripts.new_units(u, u.where("role = 'user'")).select("id", "file", "line", "sub")


@query("x23_x24_keys_and_times", f"select doc_id, coalesce(lang, source, doc_id::varchar) as key, case when doc_id % 2 = 0 then doc_id::bigint else epoch_ms(date '2020-01-01' + (doc_id % 1500)::int) end as ms from documents")
def x23(spark, sf):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")), "yyyy-MM-dd")
    ms = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("long"))
    return table(spark, sf, "documents").select("doc_id", links.stable_id("lang", "source", "doc_id").alias("key"), links.time_ms(ms, day).alias("ms"))


@query("x19_polarity", oracles.POLARITY)
def x19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.denies(F.col("text")).alias("denies"), T.favours(F.col("text")).alias("favours"))


# --- sweeps ------------------------------------------------------------------------------------------------------


@query("q10_heartbeat", _with(ENTRIES, f"notes as (select source || '/' || doc_id as rel, lang, {NOW} - doc_id * 60000 as mtime_ms from documents where lang <> 'de')")
       + f"select 'ORPHAN' as section, rel from entries where rel not in (select rel from notes) union all (select 'RECENT', rel from notes where mtime_ms >= {NOW} - 45 * 60000 and lang <> 'fr' order by mtime_ms desc, rel limit 15)")
def q10(spark, sf):
    d = table(spark, sf, "documents").where("lang <> 'de'")  # other notes were deleted
    n = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel"), "lang", (F.lit(NOW) - F.col("doc_id") * 60_000).alias("mtime_ms"))
    return jobs.heartbeat(n.drop("lang"), views.entries(spark, sf), n.where("lang = 'fr'").select("rel"), NOW)


def _window(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("ord"), "role", "text")


_LAST = "last as (select (conv_id * 1000 + turn)::bigint as ord, role, left(text, 1200) as text from conversations order by 1 desc limit 400)"


@query("q11_capture", f"with {_LAST} select 'snapshot' as mode, ord, role, md5(text) as text_md5 from last union all select 'reference', null, null, null")
def q11(spark, sf):
    """A snapshot that was just taken, and the stub of one that is too old."""
    both = jobs.capture(_window(spark, sf), NOW - 60_000, NOW).unionByName(jobs.capture(_window(spark, sf), NOW - 600_000, NOW))
    return both.select("mode", "ord", "role", F.md5("text").alias("text_md5"))


@query("x21_window_digest", f"with {_LAST} select left(sha256(string_agg(role || ':' || text, chr(10) order by ord)), 8) as digest from last")
def x21(spark, sf):
    return jobs.digest(jobs.capture(_window(spark, sf), NOW, NOW).select("ord", "role", "text"))


@query(
    "q14_stale_logs",
    f"""with l as (select event_type as name, epoch_us(max(ts)) // 1000 as ms from events group by 1),
w as (select * from (values ('click', 1.0), ('purchase', 1e9), ('absent', 1.0)) t(name, most))
select name, round(({NOW} - ms) / 3600000.0::double, 3) as hours,
  case when ms is null then 'missing' when ({NOW} - ms) / 3600000.0::double > most then 'stale' else 'fresh' end as state from w left join l using (name)""",
)
def q14(spark, sf):
    logs = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("mtime_ms"))
    return jobs.stale_logs(logs, {"click": 1.0, "purchase": 1e9, "absent": 1.0}, NOW)


@query("a02_a07_counts", "select lang as type, count(*) as chunks, count(distinct source) as files, max(doc_id) as newest from documents group by 1")
def a02(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"), F.max("doc_id").alias("newest"))


@query(
    "q15_briefing",
    _EDGES.rstrip() + "," + ",\n".join((ENTRIES, _AGED)) + "," + oracles.CLUSTERS + "," + oracles.INSIGHTS
    + f""", shown as (select rel from aged where d >= 3 order by round({_SURFACE}, 9) desc, rel limit 3), learned as (select members from insights order by runs desc, strength desc, id limit 12),
flagged as (select distinct rel from chunk where contains(text, 'reconcile: review') order by rel limit 30)
select 'surfaced' as section, rel as item from shown union all select 'learned', array_to_string(members, ', ') from learned union all select 'pending', rel from flagged""",
)
def q15(spark, sf):
    clusters = graph.promotable(graph.dense_clusters(_rounds(spark, sf)), recurrence=2)
    insights = graph.merge_insights(graph.merge_insights(spark.createDataFrame([], graph.INSIGHT), clusters, NOW), clusters, NOW + 1)
    pending = jobs.flagged(views.chunk(spark, sf))
    return jobs.briefing(views.entries(spark, sf), insights, pending, NOW)


_SLUG = "left(coalesce(nullif(regexp_replace(regexp_replace(lower(left(split_part(text, chr(10), 1), 80)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'note'), 50)"


@query(
    "q12_save_notes",
    _with(
        CHUNK, "asked as (select doc_id, text from documents where doc_id % 100 = 0)", oracles.redaction("asked"),
        f"named as (select doc_id as id, 'memory/02-semantic/' || {_SLUG} || '-' || left(sha256('fact' || chr(10) || text || chr(10)), 8) || '.md' as path from t{len(T.SECRETS)})",
        "first as (select path, min(id) as id from named group by path)",
        "near as (select c.ord as id, max(round(list_cosine_similarity(c.vector, x.vector), 6)) as top_score from chunk c join chunk x on c.ord % 100 = 0 and x.rel <> c.rel and c.vector is not null and x.vector is not null group by 1)",
    )
    + f"select id, path, 'fact' as type, coalesce(top_score >= {MID}, false) as review, top_score from first left join near using (id) where coalesce(top_score, 0) < {HIGH}",
)
def q12(spark, sf):
    c = views.chunk(spark, sf)
    cands = c.where("ord % 100 = 0").select(F.col("ord").alias("id"), "rel", F.lit("fact").alias("type"), "text", "vector")
    return jobs.save_notes(cands, spark.createDataFrame([], "path string"), c, mid=MID, high=HIGH).drop("text")


# --- the index over time, the learn job, reports -----------------------------------------------------------------


def _refreshed(spark, sf):
    """The index as it was, with notes that are gone by now, and after a refresh: labelled notes have changed."""
    from engramlake.sources import index

    d = table(spark, sf, "documents").where("text is not null")
    marked = table(spark, sf, "labels").where("quality is not null").select("doc_id").distinct().withColumn("_new", F.lit(1))
    rel, mtime = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.col("doc_id") * 1000
    notes = d.join(marked, "doc_id", "left").select(rel.alias("rel"), "text", "lang", (mtime + F.coalesce("_new", F.lit(0))).alias("mtime_ms"))
    old = d.select(rel.alias("rel"), mtime.alias("mtime_ms"), F.explode(T.chunks(F.col("text"))).alias("c")).select("rel", "mtime_ms", "c.start_line", "c.text")
    gone = table(spark, sf, "benchmark").select(F.concat(F.lit("gone/"), F.col("item_id").cast("string")).alias("rel"), F.lit(1).cast("long").alias("mtime_ms"), F.lit(1).alias("start_line"), "text")
    stored = old.unionByName(gone).withColumn("vector", F.array(F.lit(-1.0)))
    new = index.refresh(notes.select("rel", "mtime_ms", F.col("text").alias("content")), stored, lambda t: F.array(F.length(t).cast("double")), 1)
    return stored, new, notes


@query("t01_t08_s07_index", oracles.INDEX)
def t01(spark, sf):
    _, new, notes = _refreshed(spark, sf)
    c = new.join(notes.select("rel", "lang"), "rel")
    return c.select("ord", "rel", "start_line", F.col("lang").alias("type"), F.md5("text").alias("text_md5"), "reused", F.element_at("vector", 1).alias("v"))


@query("a09_index_counts", oracles.INDEX_COUNTS)
def a09(spark, sf):
    from engramlake.sources import index

    stored, new, _ = _refreshed(spark, sf)
    return index.counts(stored, new)


@query("g09_q05_learn", _with(CHUNK).rstrip() + "," + oracles.LEARNED)
def g09(spark, sf):
    none = spark.createDataFrame([], graph.EDGE)
    _, clusters, _ = jobs.learn(views.embedded(spark, sf), none, spark.createDataFrame([], graph.INSIGHT), 1, NOW, 0.2, least=2, recurrence=1, strength=0.3)
    return clusters.select("cluster", F.array_join("members", ",").alias("members"), "n_edges", "density", "strength", "theme")


@query("g10_to_phrase", _EDGES.rstrip() + "," + oracles.CLUSTERS + "," + oracles.INSIGHTS + "," + oracles.TO_PHRASE)
def g10(spark, sf):
    clusters = graph.promotable(graph.dense_clusters(_rounds(spark, sf)), recurrence=2)
    insights = graph.merge_insights(graph.merge_insights(spark.createDataFrame([], graph.INSIGHT), clusters, NOW), clusters, NOW + 1)
    return jobs.to_phrase(insights, views.chunk(spark, sf).select(F.col("ord").cast("string").alias("id"), "text"))


@query("s01_s04_s12_notes", oracles.NOTES)
def s01(spark, sf):
    """Notes as files, written, found again and cut."""
    from engramlake.sources import notes

    root, d = new_folder(spark, "notes"), table(spark, sf, "documents").where("text is not null")
    notes.write_files(d.select(F.concat(F.lit("memory/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("value")), root)
    c = notes.note_chunks(notes.scan_notes(spark, root))
    return c.select("ord", "rel", "start_line", "type", "status", F.md5("text").alias("text_md5"))


@query("s02_s05_t02_tails", oracles.TAILS)
def s02(spark, sf):
    """Transcripts as files, read by their tails in two runs, and their shards read back."""
    from engramlake.sources import notes, transcripts

    root, out, cursor = (new_folder(spark, n) for n in ("transcripts", "shards", "cursor"))
    said = F.to_json(F.struct(F.lit("user_message").alias("type"), F.lit("2024-01-01").alias("timestamp"), F.struct(F.col("text").alias("content")).alias("data")))
    lines = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("value")))).alias("l"))
    files = lines.select(F.concat(F.lit("threads/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.transform("l", lambda x: x["value"]).alias("v"))
    whole = lambda v: F.concat(F.array_join(v, "\n"), F.lit("\n"))
    notes.write_files(files.select("path", whole(F.slice("v", 1, 1)).alias("value")), root)
    transcripts.ingest_tails(spark, root, out, cursor, "1")
    notes.write_files(files.where("size(v) > 1").select("path", whole("v").alias("value")), root)
    transcripts.ingest_tails(spark, root, out, cursor, "2")
    return transcripts.read_shards(spark, out, "thread").select("id", "src", "month")


@query("w13_heads", oracles.HEADS)
def w13(spark, sf):
    return jobs.heads(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content")), 3)


@query("s13_distilled_notes", oracles.DISTILLED)
def s13(spark, sf):
    from engramlake.sources import notes

    d = table(spark, sf, "documents").where("text is not null")
    n = d.select(F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"), "source", F.col("text").alias("content"), F.array("lang").alias("tags"), F.lit("2024-06-01").alias("date"), F.lit(False).alias("review"))
    return notes.distilled_files(n).select("path", F.md5("value").alias("value_md5"))


@query("s14_report", _METRIC + f", m as (select query, k, round(recall, 6) as recall, round(precision, 6) as precision, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from ({_metric('rank')}))\n"
       + "select 'query' as scope, query::varchar as query, k, recall, precision, mrr, ndcg from m union all select 'aggregate', null, k, round(avg(recall), 5), round(avg(precision), 5), round(avg(mrr), 5), round(avg(ndcg), 5) from m group by k")
def s14(spark, sf):
    from engramlake.sources import notes

    m = metrics.ir_metrics(*_label_ranking(spark, sf), ks=(1, 5, 10))
    names = ("recall", "precision", "mrr", "ndcg")
    r = notes.report(m.select("query", "k", *(F.round(c, 6).alias(c) for c in names)))
    return r.select("scope", "query", "k", *(F.when(F.col("scope") == "query", F.col(c)).otherwise(F.round(c, 5)).alias(c) for c in names))


@query("s15_links_tsv", "select source || '/' || doc_id || ':1' || chr(9) || coalesce(lang, 'note') || chr(9) || printf('%.3f', (doc_id % 1000) / 1000.0::double) || chr(9) || 'same source' as value from documents")
def s15(spark, sf):
    from engramlake.sources import notes

    d = table(spark, sf, "documents")
    return notes.links_tsv(d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.col("lang").alias("type"), (F.col("doc_id") % 1000 / 1000.0).alias("rel"), F.lit("same\tsource").alias("reason")))


@query("s11_versions", "select doc_id, lang, source from documents")
def s11(spark, sf):
    """A version is read whole, whatever other versions stand beside it."""
    from engramlake.sources import notes

    path, d = new_folder(spark, "versions"), table(spark, sf, "documents").select("doc_id", "lang", "source")
    notes.write_version(d.limit(0), path, "1")
    notes.write_version(d, path, "2")
    return notes.read_version(spark, path)


@query("s16_audit_log", "select strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, event_type as action, user_id::varchar as file, 'job' as actor, 'auto' as approval, 'event ' || event_id as summary from events")
def s16(spark, sf):
    from engramlake.sources import notes

    path = new_folder(spark, "audit")
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("file"), F.lit("job").alias("actor"), F.lit("auto").alias("approval"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("summary"))
    notes.append_audit(e.where("action = 'click'"), path)
    notes.append_audit(e.where("action <> 'click'"), path)
    return notes.read_audit(spark, path)


@query("p18_messages", oracles.MESSAGES)
def p18(spark, sf):
    from engramlake.sources import messages as M

    text = F.concat(F.lit("<system-reminder>"), F.col("text"), F.lit("</system-reminder>"))
    said = F.to_json(F.struct(F.lit("user").alias("role"), text.alias("content"), F.lit("2024-01-01").alias("ts")))
    block = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("hidden").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    answer = F.to_json(F.struct(F.lit("assistant").alias("type"), block.alias("content"), F.lit("2024-01-02").alias("timestamp")))
    bare = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)
    value = F.when(F.col("role") == "user", said).when(F.col("role") == "assistant", answer).otherwise(bare)
    m = M.normalise(table(spark, sf, "conversations").select("conv_id", "turn", value.alias("value")), "conv_id", "turn")
    return m.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "ts")


@query("q17_datasets", oracles.DATASETS)
def q17(spark, sf):
    from engramlake.sources import messages as M

    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), F.concat(F.lit("D1:"), F.col("turn").cast("string")).alias("dia_id"), "text")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    g = c.groupBy("conv_id").agg(turns.alias("turns"), said.alias("said"))
    asked = F.concat(F.lit("Who said "), F.col("conv_id").cast("string"), F.lit("?"))
    dialogs = g.select(F.col("conv_id").cast("string").alias("sample_id"), F.create_map(F.lit("session_1"), F.parse_json(F.to_json("turns")), F.lit("speaker_a"), F.parse_json(F.lit("1"))).alias("conversation"), F.array(F.struct(asked.alias("question"), F.array(F.lit("D1:0")).alias("evidence"), F.lit(5).alias("category"))).alias("qa"))
    corpus, none = M.from_dialogs(dialogs)
    key = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    sessions = g.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"), asked.alias("question"), F.array(key).alias("haystack_session_ids"), F.array("said").alias("haystack_sessions"), F.array(key).alias("answer_session_ids"))
    hay, queries = M.from_sessions(sessions)
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.md5("text").alias("text_md5"))
    out = part(corpus, "turns").unionByName(part(hay, "sessions"))
    return out.unionByName(queries.unionByName(none).select(F.lit("asked").alias("kind"), F.col("relevant")[0].alias("id"), F.md5("query").alias("text_md5")))


# --- upkeep ------------------------------------------------------------------------------------------------------


@query(
    "x30_q22_triggers_and_routes",
    f"""with a as (select conv_id, turn, case turn % 4 when 0 then 'Please remember that ' when 1 then 'Scratch that: ' when 2 then 'How do I ' else '' end || lower(text) as t from conversations)
select conv_id, turn, case when regexp_matches(t, {oracles.quoted(upkeep.FORGET, True)}) then 'forget' when regexp_matches(t, {oracles.quoted(upkeep.REMEMBER, True)}) then 'remember'
    when regexp_matches(t, {oracles.quoted(upkeep.REFLECT, True)}) then 'reflect' end as trigger,
  case when contains(t, 'when did') then 'episodic' when contains(t, 'what do you know') then 'semantic' when contains(lower(t), 'how do i') then 'procedural'
    when contains(t, 'what''s the latest') then 'recent' else 'core' end as store from a""",
)
def x30(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ("Please remember that ", "Scratch that: ", "How do I ", ""))), (F.col("turn") % 4 + 1).cast("int"))
    c = table(spark, sf, "conversations").withColumn("t", F.concat(said, F.lower("text")))
    return c.select("conv_id", "turn", upkeep.trigger(F.col("t")).alias("trigger"), upkeep.route(F.col("t")).alias("store"))


_KIND = "['decision', 'fact', 'preference', 'rumour'][(turn % 4 + 1)::int]"


@query(
    "q21_episodes",
    f"""with k as (select *, {_KIND} as type, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+', ''), '\\s+$', '')) as body,
    row_number() over (partition by conv_id order by turn) - 1 as pos from conversations)
select conv_id::varchar as name, pos::int as pos, lpad((turn % 24)::varchar, 2, '0') || ':30' as time, type, 'high' as confidence, role || ',memory' as tags, body as text from k where type <> 'rumour'""",
)
def q21(spark, sf):
    """Conversations as daily logs, an entry a turn, parsed again."""
    kind = F.element_at(F.array(*map(F.lit, ("decision", "fact", "preference", "rumour"))), (F.col("turn") % 4 + 1).cast("int"))
    head = F.concat(F.lit("## "), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":30 | "), kind, F.lit(" | confidence:high | tags:["), "role", F.lit(", memory]\n"))
    entry = F.struct("turn", F.concat(head, F.regexp_replace("text", r"\s+", " ")).alias("e"))
    logs = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    content = F.concat(F.lit("# Log\n\n"), F.array_join(F.transform("l", lambda x: x["e"]), "\n\n"))
    e = upkeep.episodes(logs.select("name", content.alias("content")))
    return e.select("name", "pos", "time", "type", "confidence", F.array_join("tags", ",").alias("tags"), "text")


@query(
    "q18_reflection_scope",
    _with(ENTRIES) + f"""select 'episode' as what, doc_id::varchar as id from documents where {NOW} - doc_id * 3600000 > {NOW} - 86400000 * 3 union all select 'entity', rel from entries where importance > 0.3""",
)
def q18(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.lit(NOW) - F.col("doc_id") * 3_600_000).alias("ms"))
    e = views.entries(spark, sf).select(F.col("rel").alias("id"), F.col("importance").alias("score"))
    return upkeep.reflection_scope(d, e, NOW - 3 * 86_400_000, NOW)


_AUDIT = "a as (select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, event_type as action, user_id::varchar as file, 'job:' || event_type as actor, event_id from events)"


@query("q20_audit_rows", f"with {_AUDIT} (select 'last' as what, event_id from a order by timestamp desc, action, file, actor, event_id limit 30) union all select 'file', event_id from a where file = '7' union all select 'clicks', event_id from a where actor like 'job:cl%' and action in ('click', 'view')")
def q20(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    a = table(spark, sf, "events").select(stamp.alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("file"), F.concat(F.lit("job:"), "event_type").alias("actor"), "event_id")
    part = lambda what, df: df.select(F.lit(what).alias("what"), "event_id")
    out = part("last", upkeep.audit_rows(a, last=30)).unionByName(part("file", upkeep.audit_rows(a, file="7")))
    return out.unionByName(part("clicks", upkeep.audit_rows(a, actor="job:cl", actions=("click", "view"))))


@query(
    "q23_retention",
    """with n as (select lang as series, doc_id as date, row_number() over (partition by lang order by doc_id desc) as n from documents)
select series, date, case when n <= 10 then 'full' when n <= 50 then 'line' else 'archive' end as tier from n""",
)
def q23(spark, sf):
    return upkeep.retention(table(spark, sf, "documents").select(F.col("lang").alias("series"), F.col("doc_id").alias("date")))


@query(
    "q24_alerts",
    """select doc_id::varchar as file, case when lang = 'en' then 'changed' else 'unauthorised' end as why from documents
where doc_id in (select doc_id from labels) and doc_id not in (select doc_id from labels where quality = 1)""",
)
def q24(spark, sf):
    """Labelled documents are critical; those of good quality are as known; English ones were changed by hand."""
    d, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    files = d.select(F.col("doc_id").cast("string").alias("file"), F.md5(F.coalesce("text", F.lit(""))).alias("checksum"), F.when(F.col("lang") == "en", "manual").otherwise("job").alias("actor"))
    known = files.join(marks.where("quality = 1").select(F.col("doc_id").cast("string").alias("file")).distinct(), "file", "left_semi").select("file", "checksum")
    return upkeep.alerts(files, known, marks.select(F.col("doc_id").cast("string").alias("file")))


@query(
    "q25_proposals",
    """with p as (select item_id as id, ['commit', 'reject', 'defer', null][(item_id % 4 + 1)::int] as d from benchmark)
select id, case when d = 'commit' and id % 8 = 0 then '00-core' else '02-semantic' end as store, case d when 'commit' then 'committed' when 'reject' then 'rejected' else 'pending' end as status,
  case d when 'commit' then 'CREATE' when 'reject' then 'REJECT' end as action, case when d in ('commit', 'reject') then 'bot:commit-from:scout' end as actor from p""",
)
def q25(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    decision = F.element_at(F.array(F.lit("commit"), F.lit("reject"), F.lit("defer"), F.lit(None).cast("string")), (F.col("id") % 4 + 1).cast("int"))
    decisions = b.select("id", decision.alias("decision"), F.when(F.col("id") % 8 == 0, "00-core").alias("store")).where("decision is not null")
    return upkeep.settle(b.withColumn("store", F.lit("02-semantic")), decisions, "scout")


# --- streams -----------------------------------------------------------------------------------------------------


@query("t09_access_stream", "select user_id, count(*) as access, epoch_us(max(ts)) // 1000 as last_ms from events where event_type = 'click' group by 1")
def t09(spark, sf):
    from engramlake.streaming import jobs as streams

    out, mark = new_folder(spark, "access"), new_folder(spark, "access-checkpoint")
    streams.access_counts(spark, sf, "events.parquet", out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.sum("access").alias("access"), F.max("last_ms").alias("last_ms"))


@query("t13_windowed_counts", "select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2")
def t13(spark, sf):
    e = table(spark, sf, "events")
    w = e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
