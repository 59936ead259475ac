"""Registered queries over the given tables, and the SQL that each is held against. Doubles are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, contracts, metrics, panel, retrieval, vectors
from rankloom.sources.folders import ROWS, small_tasks, stored
from rankloom.sources.views import judgments, view, with_views

BLOCKS, BLOCK, TOP = 8, 4, 50
#: Numbers in a vector of `embeddings`.
DIMENSION = 64


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to 6 places (and no negative zero), counts as long. Means of few rows, which may lie halfway between two
    such values, take 9."""
    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            # First to 12 places: sums taken in another order differ there, and must not part at a half of the last.
            return (F.round(F.round(c.cast("double"), 12), places) + 0.0).alias(name)
        return c.cast("long").alias(name) if kind in ("int", "bigint", "smallint", "tinyint") else c.alias(name)

    return df.select(*[one(*x) for x in df.dtypes])


def shelves(spark: SparkSession, sf_dir: str, blocks: list[int], k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """The catalogs of the blocks by title, with each title's k smallest ids."""
    products = view(spark, sf_dir, "v_products")
    with small_tasks(spark, ROWS):
        groups, heads = retrieval.by_title(products, retrieval.members_by_block(products, blocks, "title"), k)
        return stored(groups, "titles"), stored(heads, "heads")


def words(queries: DataFrame, groups: DataFrame) -> DataFrame:
    return retrieval.bm25(queries, groups).withColumn("bm25_score", F.round("bm25_score", 9))


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, (groups, heads) = stored(view(spark, sf_dir, "v_queries"), "queries"), shelves(spark, sf_dir, [BLOCK])
    with small_tasks(spark, retrieval.pairs(queries, groups)):
        return stored(retrieval.best(words(queries, groups), "bm25_score", groups, heads, TOP).drop("scope", "title"), "lexical")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    return rounded(metrics.ndcg(ranked, judgments(spark, sf_dir, ranked), 10))


def exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    return rounded(metrics.exposure(ranked, judgments(spark, sf_dir, ranked), 10))


def log_and_products(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "v_interactions"), view(spark, sf_dir, "v_products")


def embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (rows whose id is divisible by 50) and all rows."""
    rows = view(spark, sf_dir, "embeddings")
    return vectors.as_vectors(rows.where("vec_id % 50 = 0"), "vec_id", "query_id"), vectors.as_vectors(rows, "vec_id", "vec_id")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.nearest(*embedded(spark, sf_dir), 5))


def near_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.approximate(*embedded(spark, sf_dir), 5, DIMENSION))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, products = log_and_products(spark, sf_dir)
    return rounded(contracts.temporal_split(log, products).groupBy("split").agg(F.count("*").alias("n"), F.min("time_block").alias("first"), F.max("time_block").alias("last")))


QUERIES = {
    "a1_scan_supplier": lambda s, d: rounded(view(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))),
    "b3_b7_column_checks": lambda s, d: rounded(contracts.column_checks(view(s, d, "v_interactions"), ["product_id", "position"], "event_seq", {"logging_propensity": (0.2, 1.0)})),
    "b10_foreign_keys": lambda s, d: rounded(contracts.orphans(view(s, d, "v_interactions"), view(s, d, "v_products").where("launch_block <= 2"), "product_id")),
    "b11_funnel": lambda s, d: rounded(contracts.funnel(view(s, d, "v_interactions"))),
    "b12_availability": lambda s, d: rounded(contracts.unavailable(view(s, d, "events").selectExpr("event_id as event_seq", "user_id as product_id", "cast(event_id % 8 as int) as time_block"), view(s, d, "v_products"))),
    "c2_first_observed": lambda s, d: rounded(behavior.first_observed(view(s, d, "v_interactions"))),
    "d1_release_catalog": lambda s, d: rounded(view(s, d, "v_products").where(F.col("launch_block") <= BLOCK).select("product_id", "title", "launch_block", "price", F.log1p(F.greatest("price", F.lit(0.0))).alias("price_log"))),
    "d3_temporal_split": split,
    "d7_d8_query_text": lambda s, d: rounded(contracts.query_text(view(s, d, "documents").select(F.col("text").alias("query"))).groupBy("query_key").agg(F.count("*").alias("n"))),
    "e1_prior_features": lambda s, d: rounded(behavior.prior_features(*log_and_products(s, d)).select("event_seq", "prior_impressions", "prior_clicks", "prior_purchases", "smoothed_ctr", "smoothed_purchase_rate", "first_observed_age", "zero_history", "sparse_history")),
    "e5a_event_velocity": lambda s, d: rounded(behavior.event_velocity(view(s, d, "v_interactions"))),
    "e6_snapshot": lambda s, d: rounded(behavior.snapshot(*log_and_products(s, d), 5)),
    "e7_reference": lambda s, d: rounded(behavior.reference(*log_and_products(s, d), BLOCKS)),
    "e9_category_priors": lambda s, d: rounded(behavior.category_priors(behavior.reference(*log_and_products(s, d), BLOCKS), view(s, d, "v_products"))),
    "f5_bm25_top": lambda s, d: rounded(lexical(s, d).select("query_id", "product_id", "bm25_score", "rank")),
    "f11_nearest_vectors": nearest,
    "f11_nearest_of_all_vectors": nearest,
    "f12_hashed_neighbours": near_by_hash,
    "k2_ndcg_lexical": flagship,
    "k4_exposure": exposed,
    "k8_calibration_error": lambda s, d: rounded(metrics.calibration_error(view(s, d, "v_calibration"))),
    "k9_binary_scores": lambda s, d: rounded(metrics.binary_scores(view(s, d, "v_calibration"))),
    "l2_off_policy": lambda s, d: rounded(metrics.off_policy(view(s, d, "v_ope"), 1.5)),
    "l7_doubly_robust": lambda s, d: rounded(metrics.doubly_robust(view(s, d, "v_ope"))),
    "o7_paired_delta": lambda s, d: rounded(panel.paired_delta(view(s, d, "v_daily"))),
    "o8_action_utility": lambda s, d: rounded(panel.action_utility(view(s, d, "v_daily"))),
    "o12_action_contrast": lambda s, d: rounded(panel.contrast(view(s, d, "v_daily"), "view")),
    "w2_percentiles": lambda s, d: rounded(lexical(s, d).select("query_id", "product_id", retrieval.percentile("bm25_score", ["query_id"]).alias("percentile"))),
}

_BM25 = """
members as (select product_id, title from v_products where launch_block <= 4),
words as (select product_id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{2,}')) as term from members),
lens as (select product_id, count(*) as dl from words group by 1),
stats as (select count(*) as n, greatest(avg(coalesce(dl,0)),1e-9) as avgdl from members left join lens using (product_id)),
tf as (select product_id, term, count(*) as tf from words group by 1,2),
df as (select term, count(*) as df from tf group by 1),
asked as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]{2,}')) as term from v_queries),
scored as (select a.query_id, t.product_id, round(sum(ln(1+(s.n-d.df+0.5e0)/(d.df+0.5e0))*t.tf*2.5e0/(t.tf+1.5e0*(0.25e0+0.75e0*l.dl/s.avgdl)+1e-12)),9) as bm25_score
 from asked a join tf t on a.term=t.term join df d on d.term=t.term join lens l on l.product_id=t.product_id cross join stats s group by 1,2),
lexical as (select * from (select *, row_number() over (partition by query_id order by bm25_score desc, product_id) as rank from scored) where rank <= 50)"""
_TOP = "with " + _BM25.strip() + "\n"
_PRIOR = """
with per as (select product_id, time_block, sum(impressed) i, sum(clicked) c, sum(purchased) p from v_interactions group by 1,2),
state as (select a.product_id, a.time_block, coalesce(sum(b.i),0) as i, coalesce(sum(b.c),0) as c, coalesce(sum(b.p),0) as p
 from per a left join per b on a.product_id=b.product_id and b.time_block<a.time_block group by 1,2)"""
_REFERENCE = """
with per as (select product_id, time_block as b, sum(impressed) i, sum(clicked) c, sum(purchased) p from v_interactions group by 1,2),
grid as (select product_id, category, launch_block, cast(t.b as int) as time_block from v_products, (select unnest(range(8)) as b) t where launch_block <= t.b),
ref as (select g.product_id, g.category, g.launch_block, g.time_block, coalesce(sum(p.i),0) as i, coalesce(sum(p.c),0) as c, coalesce(sum(p.p),0) as p,
  coalesce(sum(p.c*pow(0.75e0, g.time_block-1-p.b)),0e0) as v from grid g left join per p on p.product_id=g.product_id and p.b<g.time_block group by 1,2,3,4)"""
_RATES = "round((c+1)/(i+5e0),6) as smoothed_ctr, round((p+0.5e0)/(i+8e0),6) as smoothed_purchase_rate"
_FLAGS = "cast(c+p=0 as bigint) as zero_history, cast(c+p<=2 as bigint) as sparse_history"
_COUNTS = "cast(i as bigint) as prior_impressions, cast(c as bigint) as prior_clicks, cast(p as bigint) as prior_purchases"
_PAIRS = """
with paired as (select seed, proposal_index, action, scenario, replication, day, max(case when policy='base' then utility end) as base, max(case when policy='treatment' then utility end) as treatment
 from v_daily group by 1,2,3,4,5,6)"""
_BLOCKS_SQL = _PAIRS + """, block as (select seed, proposal_index, action, scenario, replication, sum(treatment-base) as delta from paired where base is not null and treatment is not null group by 1,2,3,4,5)"""

ORACLE_SQL = {
    "a1_scan_supplier": "select cast(s_nationkey as bigint) as s_nationkey, count(*) as n from supplier group by 1",
    "b3_b7_column_checks": with_views("""select 'not_null' as check, 'product_id' as key, cast(sum(case when product_id is null then 1 else 0 end) as bigint) as n from v_interactions
 union all select 'not_null','position', cast(sum(case when position is null then 1 else 0 end) as bigint) from v_interactions
 union all select 'unique','event_seq', cast(count(*)-count(distinct event_seq) as bigint) from v_interactions
 union all select 'bounded','logging_propensity', cast(sum(case when logging_propensity between 0.2e0 and 1e0 then 0 else 1 end) as bigint) from v_interactions""", "v_interactions"),
    "b10_foreign_keys": with_views("select product_id, count(*) as n from v_interactions where product_id not in (select product_id from v_products where launch_block<=2) group by 1", "v_interactions", "v_products"),
    "b11_funnel": with_views("select count(*) as n, cast(coalesce(sum(case when purchased>clicked then 1 else 0 end),0) as bigint) as purchased_unclicked, cast(coalesce(sum(case when clicked>impressed then 1 else 0 end),0) as bigint) as clicked_unseen from v_interactions", "v_interactions"),
    "b12_availability": with_views("select cast(e.event_id as bigint) as event_seq, cast(e.user_id as bigint) as product_id, cast(e.event_id%8 as bigint) as time_block, cast(p.launch_block as bigint) as launch_block from events e join v_products p on p.product_id=e.user_id where p.launch_block>e.event_id%8", "v_products"),
    "c2_first_observed": with_views("select product_id, cast(min(time_block) as bigint) as first_block from v_interactions group by 1", "v_interactions"),
    "d1_release_catalog": with_views("select product_id, title, cast(launch_block as bigint) as launch_block, round(price,6) as price, round(ln(1+greatest(price,0)),6) as price_log from v_products where launch_block<=4", "v_products"),
    "d3_temporal_split": with_views("""select split, count(*) as n, cast(min(time_block) as bigint) as first, cast(max(time_block) as bigint) as last from (
 select i.time_block, case when i.time_block=m.m then 'future' when i.time_block=m.m-1 then 'test' when i.time_block=m.m-2 then 'validation' else 'train' end as split
 from v_interactions i cross join (select max(time_block) as m from v_interactions) m join v_products p on p.product_id=i.product_id where p.launch_block<=m.m-1) group by 1""", "v_interactions", "v_products"),
    "d7_d8_query_text": """select query_key, count(*) as n from (select -cast(('0x'||substr(sha256(q),1,8)) as bigint)-1 as query_key from (
 select trim(regexp_replace(text,'[ \\t\\n\\x0b\\f\\r]+',' ','g')) as q from documents) where length(q) between 1 and 300) group by 1""",
    "e1_prior_features": with_views(_PRIOR + f" select e.event_seq, {_COUNTS}, {_RATES}, cast(greatest(0, e.time_block-q.launch_block) as bigint) as first_observed_age, {_FLAGS} from v_interactions e join state s on s.product_id=e.product_id and s.time_block=e.time_block join v_products q on q.product_id=e.product_id", "v_interactions", "v_products"),
    "e5a_event_velocity": with_views("""with r as (select product_id, time_block, clicked, row_number() over (partition by product_id order by time_block, query_id, position, event_seq) as rn from v_interactions),
 blocks as (select product_id, time_block, min(rn)-1 as before from r group by 1,2)
 select b.product_id, cast(b.time_block as bigint) as time_block, round(coalesce(sum(r.clicked*pow(0.75e0, b.before-r.rn)),0e0),6)+0e0 as velocity
 from blocks b left join r on r.product_id=b.product_id and r.rn<=b.before group by 1,2""", "v_interactions"),
    "e6_snapshot": with_views(f"""with past as (select product_id, sum(impressed) i, sum(clicked) c, sum(purchased) p, sum(case when time_block>=3 then clicked else 0 end) v from v_interactions where time_block<5 group by 1),
 s as (select q.product_id, q.launch_block, coalesce(i,0) i, coalesce(c,0) c, coalesce(p,0) p, coalesce(v,0) v from v_products q left join past on past.product_id=q.product_id)
 select product_id, {_COUNTS}, cast(v as bigint) as behavior_velocity, {_RATES}, cast(greatest(0,5-launch_block) as bigint) as first_observed_age, {_FLAGS} from s""", "v_interactions", "v_products"),
    "e7_reference": with_views(_REFERENCE + f" select product_id, cast(time_block as bigint) as time_block, {_COUNTS}, round(v,6) as behavior_velocity, {_RATES}, cast(greatest(0,time_block-launch_block) as bigint) as first_observed_age, {_FLAGS} from ref", "v_interactions", "v_products"),
    "e9_category_priors": with_views(_REFERENCE + """, x as (select *, greatest(i,1) as w, (c+1)/(i+5e0) as ctr, (p+0.5e0)/(i+8e0) as pr from ref),
 g as (select time_block, coalesce(sum(case when i>0 then w*ctr end)/sum(case when i>0 then w end), sum(w*ctr)/sum(w)) as gc, coalesce(sum(case when i>0 then w*pr end)/sum(case when i>0 then w end), sum(w*pr)/sum(w)) as gp from x group by 1),
 k as (select time_block, category, sum(case when i>0 then w*ctr end)/sum(case when i>0 then w end) as kc, sum(case when i>0 then w*pr end)/sum(case when i>0 then w end) as kp from x group by 1,2)
 select cast(k.time_block as bigint) as time_block, category, round(coalesce(kc,gc),6) as prior_ctr, round(coalesce(kp,gp),6) as prior_purchase, round(gc,6) as global_prior_ctr, round(gp,6) as global_prior_purchase from k join g on g.time_block=k.time_block""", "v_interactions", "v_products"),
    "f5_bm25_top": with_views(_TOP + "select query_id, product_id, round(bm25_score,6) as bm25_score, rank from lexical", "v_products", "v_queries"),
    "f11_nearest_vectors": """with p as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(cast(q.embedding as double[]),cast(v.embedding as double[]))/sqrt(list_dot_product(cast(q.embedding as double[]),cast(q.embedding as double[]))*list_dot_product(cast(v.embedding as double[]),cast(v.embedding as double[]))),9) as s
 from embeddings q join embeddings v on q.vec_id<>v.vec_id where q.vec_id%50=0)
 select query_id, vec_id, round(s,6) as similarity, rank from (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from p) where rank<=5""",
    "f11_nearest_of_all_vectors": """with p as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(cast(q.embedding as double[]),cast(v.embedding as double[]))/sqrt(list_dot_product(cast(q.embedding as double[]),cast(q.embedding as double[]))*list_dot_product(cast(v.embedding as double[]),cast(v.embedding as double[]))),9) as s
 from embeddings q join embeddings v on q.vec_id<>v.vec_id where q.vec_id%50=0)
 select query_id, vec_id, round(s,6) as similarity, rank from (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from p) where rank<=5""",
    "k2_ndcg_lexical": with_views(_TOP + """, r as (select l.query_id, l.product_id, l.rank, v.relevance, row_number() over (partition by l.query_id order by v.relevance desc nulls last, l.product_id) as ir
 from lexical l left join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id),
 q as (select query_id, coalesce(sum(case when rank<=10 then (pow(2e0,relevance)-1)/log2(rank+1) end),0e0) as d, coalesce(sum(case when ir<=10 then (pow(2e0,relevance)-1)/log2(ir+1) end),0e0) as i from r group by 1)
 select query_id, round(d/i,6) as ndcg from q where i>0""", "v_products", "v_queries", "v_relevance"),
    "k4_exposure": with_views(_TOP + """, q as (select l.query_id, avg(case when v.relevance is null then 0e0 else 1e0 end) as c, avg(case when v.relevance is not null then case when v.relevance=0 then 1e0 else 0e0 end end) as i,
  avg(case when v.relevance is not null then case when v.relation='substitute' then 1e0 else 0e0 end end) as s
 from lexical l left join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id where l.rank<=10 group by 1)
 select round(avg(c),6) as coverage, round(avg(1-c),6) as unjudged, round(avg(i),6) as irrelevant, round(avg(s),6) as substitute from q""", "v_products", "v_queries", "v_relevance"),
    "k8_calibration_error": with_views("select round(sum(n*g)/sum(n),6) as ece from (select count(*) as n, abs(avg(y)-avg(p)) as g from v_calibration where p between 0 and 1 group by least(floor(p*10),9))", "v_calibration"),
    "k9_binary_scores": with_views("""with r as (select y, p, rank() over (order by p)+(count(*) over (partition by p)-1)/2e0 as k from v_calibration),
 c as (select y, least(greatest(p,1e-6),1-1e-6) as q, p from v_calibration)
 select (select round((sum(y*k)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*sum(1-y)),6) from r) as auc, (select round(avg(pow(p-y,2)),6) from c) as brier, (select round(avg(-(y*ln(q)+(1-y)*ln(1-q))),6) from c) as log_loss""", "v_calibration"),
    "l2_off_policy": with_views("""with w as (select candidate_propensity/greatest(logging_propensity,1e-8) as w, reward, logging_propensity from v_ope)
 select round(avg(w*reward),6) as ips, round(sum(w*reward)/sum(w),6) as snips, round(avg(least(w,1.5e0)*reward),6) as clipped_ips, round(pow(sum(w),2)/sum(w*w),6) as ess, round(max(w),6) as max_weight,
 round(avg(w),6) as mean_weight, round(avg(case when w>1.5e0 then 1e0 else 0e0 end),6) as clipped_rate, round(avg(case when logging_propensity>1e-4 then 1e0 else 0e0 end),6) as support from w""", "v_ope"),
    "l7_doubly_robust": with_views("""with r as (select *, cast(('0x'||substr(md5(cast(obs_id as varchar)),1,8)) as bigint)%5 as fold from v_ope),
 acts as (select action, max(candidate_propensity) as pi from r group by 1), ctx as (select distinct context from r), folds as (select distinct fold from r),
 mu as (select c.context, a.action, a.pi, f.fold, coalesce((select avg(reward) from r where r.context=c.context and r.action=a.action and r.fold<>f.fold), (select avg(reward) from r where r.fold<>f.fold), 0e0) as mu from ctx c cross join acts a cross join folds f),
 dm as (select context, fold, sum(pi*mu) as dm from mu group by 1,2)
 select round(avg(dm),6) as direct, round(avg(dm+candidate_propensity/greatest(logging_propensity,1e-8)*(reward-mu)),6) as doubly_robust
 from r join mu on mu.context=r.context and mu.action=r.action and mu.fold=r.fold join dm on dm.context=r.context and dm.fold=r.fold""", "v_ope"),
    "o7_paired_delta": with_views(_PAIRS + " select action, scenario, cast(count(*) as bigint) as keys, cast(sum(case when base is not null and treatment is not null then 1 else 0 end) as bigint) as pairs, round(avg(treatment-base),6) as mean_delta from paired group by 1,2", "v_daily"),
    "o8_action_utility": with_views(_BLOCKS_SQL + " select seed, proposal_index, action, count(*) as blocks, round(avg(delta),6) as utility from block group by 1,2,3", "v_daily"),
    "o12_action_contrast": with_views(_BLOCKS_SQL + """ select a.seed, a.proposal_index, a.action, count(*) as blocks, round(avg(a.delta-b.delta),6) as contrast, round(quantile_cont(a.delta-b.delta,0.5),6) as median
 from block a join block b on a.seed=b.seed and a.proposal_index=b.proposal_index and a.scenario=b.scenario and a.replication=b.replication and b.action='view' where a.action<>'view' group by 1,2,3""", "v_daily"),
    "w2_percentiles": with_views(_TOP + "select query_id, product_id, round((rank() over (partition by query_id order by bm25_score)+(count(*) over (partition by query_id, bm25_score)-1)/2e0)/count(*) over (partition by query_id),6) as percentile from lexical", "v_products", "v_queries"),
}
