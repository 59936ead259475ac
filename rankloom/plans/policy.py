"""Registered queries of the promotion policy: fused candidates, relation features, lent rates, the gate, its sweep and
placements - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, metrics, promotion, retrieval, transfer
from rankloom.plans.registry import _BM25, _REFERENCE, BLOCK, TOP, rounded, shelves, words
from rankloom.plans.reports import _percentile_sql
from rankloom.sources.folders import small_tasks, stored
from rankloom.sources.views import judgments, view, with_views

WIDTH, LENDERS, BOOSTS, TARGETS = 8, 8, [0.0, 0.005, 0.01275, 0.05], [1, 3, 5, 10]
#: Thresholds that let some of the given rows through; the class's own are those of production.
GATE = promotion.Gate(semantic=0.05, confidence=0.02, compatibility=0.2, risk=0.6, min_support=2)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_products").where(F.col("launch_block") <= BLOCK)


def dense(queries: DataFrame, groups: DataFrame) -> DataFrame:
    return retrieval.tfidf(queries, groups).withColumn("dense_score", F.round("dense_score", 9))


def dense_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, (groups, heads) = asked(spark, sf_dir), shelves(spark, sf_dir, [BLOCK], 20)
    with small_tasks(spark, retrieval.pairs(queries, groups)):
        return stored(retrieval.best(dense(queries, groups), "dense_score", groups, heads, 20), "dense")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries, worked out once: their view reads the whole catalog twice, and several joins read the view."""
    return stored(view(spark, sf_dir, "v_queries"), "queries")


def hybrid(spark: SparkSession, sf_dir: str, queries: DataFrame | None = None) -> DataFrame:
    queries, (groups, heads) = queries or asked(spark, sf_dir), shelves(spark, sf_dir, [BLOCK])
    with small_tasks(spark, retrieval.pairs(queries, groups)):
        both = retrieval.fused(words(queries, groups), dense(queries, groups), groups, heads, TOP).withColumn("retrieval_score", F.round("retrieval_score", 9))
        return stored(both.drop("scope"), "hybrid")


def known(spark: SparkSession, sf_dir: str, *rows: DataFrame) -> DataFrame:
    """The catalog's rows of the products that any of `rows` names."""
    ids = rows[0].select("product_id")
    for r in rows[1:]:
        ids = ids.union(r.select("product_id"))
    return stored(catalog(spark, sf_dir).join(ids.distinct(), "product_id", "left_semi"), "known")


def anchors(fused: DataFrame) -> DataFrame:
    return retrieval.top(fused, "retrieval_score", 1, ["query_id"]).select("query_id", "product_id")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.edges(catalog(spark, sf_dir), WIDTH, ["category"])


def lent(spark: SparkSession, sf_dir: str, fused: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    queries, targets = queries or asked(spark, sf_dir), fused.select("query_id", "product_id")
    log = view(spark, sf_dir, "v_interactions", v_queries=queries)
    edges = stored(transfer.edges(catalog(spark, sf_dir), WIDTH, ["category"], targets), "edges")
    pairs = stored(targets.union(targets.join(edges, "product_id").select("query_id", "neighbor_product_id")).distinct(), "pairs")
    products = known(spark, sf_dir, pairs)
    related = stored(transfer.rule_relations(transfer.relations(pairs, queries, products, anchors(fused))).select("query_id", "product_id", "p_exact", "p_substitute", "p_complement", "p_irrelevant"), "related")
    # Rates of categories are those of all products, the rest is of those asked for: both meet the log's counts.
    counts = stored(behavior.counts_before(log, BLOCK), "counts")
    priors = stored(behavior.category_priors(behavior.standing(counts, catalog(spark, sf_dir), BLOCK, "category").withColumn("time_block", F.lit(BLOCK))), "priors")
    state = stored(behavior.standing(counts, products, BLOCK), "state")
    out = transfer.transfer(targets, related, edges, state, priors, products, LENDERS)
    return out.join(state.select("product_id", "smoothed_ctr", "zero_history"), "product_id")


def gate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    fused = hybrid(spark, sf_dir, queries)
    rows = lent(spark, sf_dir, fused, queries).join(fused.select("query_id", "product_id", "dense_score", "retrieval_score"), ["query_id", "product_id"])
    return stored(retrieval.blended(rows, "retrieval_score", "smoothed_ctr", 0.65, ["query_id"]), "gate-input")


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion.promote(gate_input(spark, sf_dir), GATE, BOOSTS)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per value of max_boost: boosts given, and mean NDCG@10 of the base and final ranking over the judged queries."""
    rows = stored(promoted(spark, sf_dir), "promoted")
    judged = judgments(spark, sf_dir, rows)
    boosts = rows.groupBy("max_boost").agg(F.count_if(F.col("action") == "BOOST").alias("boosts"), F.count("*").alias("n"))
    per = rows.withColumn("one_query", F.struct("max_boost", "query_id"))
    gains = per.join(judged.select("query_id", "product_id", "relevance"), ["query_id", "product_id"], "left")
    gains = stored(gains.select(F.col("one_query").alias("query_id"), "product_id", "relevance", "base_rank", "final_rank"), "gains")
    score = lambda rank, name: metrics.ndcg(gains.select("query_id", "product_id", F.col(rank).alias("rank")), gains.select("query_id", "product_id", "relevance"), 10).withColumnRenamed("ndcg", name)
    both = score("base_rank", "base").join(score("final_rank", "final"), "query_id")
    means = both.groupBy(F.col("query_id.max_boost").alias("max_boost")).agg(F.avg("base").alias("base_ndcg"), F.avg("final").alias("final_ndcg"), F.avg(F.col("final") - F.col("base")).alias("delta"))
    return rounded(boosts.join(means, "max_boost"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = anchors(hybrid(spark, sf_dir))
    top = first.join(known(spark, sf_dir, first), "product_id").select("query_id", "model", "brand", "attribute", "category")
    return top.join(view(spark, sf_dir, "v_queries").select("query_id", "query"), "query_id").select("query_id", retrieval.intent().alias("intent"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate_input(spark, sf_dir)
    return promotion.placements(rows, rows.where("zero_history = 1"), TARGETS)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion.order_agreement(gate_input(spark, sf_dir).withColumn("stored", promotion.ranked("base_score", ["query_id"])), "stored", "base_score")


def related_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    fused = hybrid(spark, sf_dir, queries)
    return transfer.relations(fused.select("query_id", "product_id"), queries, known(spark, sf_dir, fused), anchors(fused))


_LENT = ["query_id", "product_id", "target_utility", "p_irrelevant", "compatibility", "support", "support_score", "dispersion", "confidence", "ctr", "purchase", "ctr_lower", "purchase_lower", "transfer_source"]
_OUT = ["query_id", "product_id", "max_boost", "base_rank", "boost", "action", "reason", "final_score", "final_rank"]

QUERIES = {
    "f6_tfidf_top": lambda s, d: rounded(dense_lists(s, d).select("query_id", "product_id", "dense_score", "rank")),
    "f13_hybrid": lambda s, d: rounded(hybrid(s, d).select("query_id", "product_id", "bm25_score", "dense_score", "candidate_source", "retrieval_score")),
    "f14_anchors": lambda s, d: rounded(anchors(hybrid(s, d))),
    "f18_intents": intents,
    "h1_edges": lambda s, d: rounded(graph(s, d)),
    "h3_relation_features": lambda s, d: rounded(related_features(s, d)),
    "h15_transfer": lambda s, d: rounded(lent(s, d, hybrid(s, d)).select(*_LENT)),
    "w9_promotion": lambda s, d: rounded(promoted(s, d).select(*_OUT)),
    "w13_order_agreement": lambda s, d: rounded(agreement(s, d)),
    "w14_placements": lambda s, d: rounded(placed(s, d), 9),
    "w16_best_proposals": lambda s, d: rounded(promotion.best_proposals(gate_input(s, d).withColumn("base_rank", promotion.ranked("base_score", ["query_id"]))).select("query_id", "product_id", "confidence", "base_rank")),
    "n4_boost_sweep": sweep,
}

_GRAMS = "list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i+1]))"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{1,}}'))"
_DENSE = _BM25 + f""",
gd as (select product_id, term, 1+ln(count(*)) as s from (select product_id, unnest({_GRAMS}) as term from (select product_id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}') as t from members) x) y group by 1,2),
gi as (select term, ln((1+(select count(*) from members))/(1e0+count(*)))+1 as idf from gd group by 1),
gw as (select product_id, gd.term, s*idf as w from gd join gi on gi.term=gd.term),
gq as (select query_id, q.term, (1+ln(count(*)))*max(idf) as w from (select query_id, unnest({_GRAMS}) as term from (select query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{2,}}') as t from v_queries) x) q join gi on gi.term=q.term group by 1,2),
gl as (select product_id, sqrt(sum(w*w)) as len from gw group by 1), gk as (select query_id, sqrt(sum(w*w)) as len from gq group by 1),
dense as (select q.query_id, d.product_id, round(sum(q.w*d.w)/(max(gl.len)*max(gk.len)),9) as dense_score from gq q join gw d on d.term=q.term join gl on gl.product_id=d.product_id join gk on gk.query_id=q.query_id group by 1,2),
nearest as (select * from (select *, row_number() over (partition by query_id order by dense_score desc, product_id) as rank from dense) x where rank<=50)"""
_HYBRID = _DENSE + f""",
met as (select query_id, product_id, max(l) as l, max(d) as d from (select query_id, product_id, 1 as l, 0 as d from lexical union all select query_id, product_id, 0, 1 from nearest) x group by 1,2),
both_scores as (select m.query_id, m.product_id, case when l=1 and d=1 then 'hybrid' when l=1 then 'bm25' else 'dense' end as candidate_source, coalesce(s.bm25_score,0e0) as bm25_score, coalesce(t.dense_score,0e0) as dense_score
 from met m left join scored s on s.query_id=m.query_id and s.product_id=m.product_id left join dense t on t.query_id=m.query_id and t.product_id=m.product_id),
fused as (select *, round(0.45e0*{_percentile_sql('bm25_score')}+0.55e0*{_percentile_sql('dense_score')},9) as retrieval_score from both_scores),
anchor as (select query_id, product_id from (select *, row_number() over (partition by query_id order by retrieval_score desc, product_id) as n from fused) x where n=1)"""
_EDGES = f"""catalog as (select * from v_products where launch_block<=4),
titled as (select product_id, category, list_distinct(regexp_extract_all(lower(title),'[\\p{{L}}\\p{{N}}_]+')) as t from catalog),
ee as (select a.product_id, b.product_id as neighbor_product_id, round(len(list_intersect(a.t,b.t))/sqrt(cast(len(a.t)*len(b.t) as double)),9) as sim
 from titled a join titled b on a.category=b.category and a.product_id<>b.product_id),
edges as (select product_id, neighbor_product_id, sim from (select *, row_number() over (partition by product_id order by sim desc, neighbor_product_id) as nth from ee) x where nth<={WIDTH})"""


def _features_sql(pairs: str) -> str:
    num = "cast(coalesce({0}, false) as int)*1e0".format
    q = _WORDS.format("q.query")
    shared = f"len(list_intersect({q},{_WORDS.format('p.title')}))/cast(greatest(len(list_distinct(list_concat({q},{_WORDS.format('p.title')}))),1) as double)"
    cols = {"overlap": shared, "category_hit": num(f"list_has_any({q},{_WORDS.format(chr(40) + 'replace(p.category,' + repr('_') + ',' + repr(' ') + '))')})"), "attribute_hit": num(f"list_has_any({q},{_WORDS.format('p.attribute')})")}
    cols |= {f"{c}_named": num(f"length(p.{c})>0 and contains(lower(q.query),lower(p.{c}))") for c in ("brand", "model")}
    cols |= {"category_match": num("p.category=q.category")} | {f"anchor_{c}_match": num(f"p.{c}=a.{c}") for c in ("category", "attribute", "brand", "model")}
    cols |= {"accessory": num(f"list_has_any({q},[{','.join(repr(w) for w in transfer.ACCESSORY)}])"), "query_length": f"least(len({q}),12)/12e0"}
    cols |= {f"intent_{i}": num(f"q.intent='{i}'") for i in transfer.INTENTS} | {"quality_value": "p.quality", "price_value": "ln(1+greatest(p.price,0))/10e0"}
    body = ", ".join(f"{v} as {k}" for k, v in cols.items())
    return f"select x.query_id, x.product_id, {body} from {pairs} x join v_queries q on q.query_id=x.query_id join catalog p on p.product_id=x.product_id left join anchor an on an.query_id=x.query_id left join catalog a on a.product_id=an.product_id"


_LENT_SQL = "with " + _HYBRID.strip() + ",\n" + _EDGES + ",\n" + _REFERENCE.strip()[5:] + f""",
asked_pairs as (select query_id, product_id from fused union select f.query_id, e.neighbor_product_id from fused f join edges e on e.product_id=f.product_id),
feats as ({_features_sql('asked_pairs')}),
logits as (select query_id, product_id, exp(3*model_named+2*overlap+anchor_model_match) as x, exp(2*category_match+attribute_hit+anchor_attribute_match) as s, exp(category_hit+accessory) as c, exp(2-2*category_match) as i from feats),
rel as (select query_id, product_id, (x+0.85e0*s+0.08e0*c)/(x+s+c+i) as u, i/(x+s+c+i) as p_irrelevant, least((x+s)/(x+s+c+i),1e0) as compatibility from logits),
stt as (select product_id, category, i, c, p, (c+1)/(i+5e0) as ctr, (p+0.5e0)/(i+8e0) as pr, greatest(i,1) as w from ref where time_block=4),
gpr as (select coalesce(sum(case when i>0 then w*ctr end)/sum(case when i>0 then w end), sum(w*ctr)/sum(w)) as gc, coalesce(sum(case when i>0 then w*pr end)/sum(case when i>0 then w end), sum(w*pr)/sum(w)) as gp from stt),
kpr as (select category, coalesce(sum(case when i>0 then w*ctr end)/sum(case when i>0 then w end), max(gc)) as kc, coalesce(sum(case when i>0 then w*pr end)/sum(case when i>0 then w end), max(gp)) as kp from stt cross join gpr group by 1),
lend as (select f.query_id, f.product_id, e.neighbor_product_id as n, s.ctr, s.pr, r.u, case when np.attribute=tp.attribute then 1e0 else 0e0 end as pair, round(e.sim*r.u*(0.2e0+0.8e0*case when np.attribute=tp.attribute then 1e0 else 0e0 end),12) as w
 from fused f join edges e on e.product_id=f.product_id and e.sim>0 join stt s on s.product_id=e.neighbor_product_id and s.i>0 join catalog np on np.product_id=e.neighbor_product_id join catalog tp on tp.product_id=f.product_id join rel r on r.query_id=f.query_id and r.product_id=e.neighbor_product_id),
lenders as (select * from (select *, row_number() over (partition by query_id, product_id order by w desc, n) as k from lend where w>0) x where k<=8),
summed as (select query_id, product_id, count(*) as support, sum(w*ctr)/sum(w) as n_ctr, sum(w*pr)/sum(w) as n_pr, sum(w*u)/sum(w) as n_q, sum(w*pair)/sum(w) as n_pair, sum(w*ctr*ctr)/sum(w) as n_sq from lenders group by 1,2),
sure as (select f.query_id, f.product_id, f.dense_score, f.retrieval_score, r.u as target_utility, r.p_irrelevant, r.compatibility, coalesce(s.support,0) as support, least(1e0,coalesce(s.support,0)/8e0) as support_score,
  case when s.support>=2 then sqrt(greatest(n_sq-n_ctr*n_ctr,0e0)) else 1e0 end as dispersion, n_ctr, n_pr, n_q, n_pair, kc, kp, t.ctr as smoothed_ctr, cast(t.c+t.p=0 as int) as zero_history
 from fused f join rel r on r.query_id=f.query_id and r.product_id=f.product_id join stt t on t.product_id=f.product_id join kpr on kpr.category=t.category left join summed s on s.query_id=f.query_id and s.product_id=f.product_id),
held as (select *, case when support>=2 then least(n_q*n_pair*compatibility*support_score*greatest(0e0,1-least(dispersion,1e0)),1e0) else 0e0 end as confidence from sure),
shrunk as (select *, case when support>=2 then confidence*n_ctr+(1-confidence)*kc else kc end as ctr, case when support>=2 then confidence*n_pr+(1-confidence)*kp else kp end as purchase from held),
lent as (select *, case when support>=2 then greatest(0e0,ctr-dispersion) else ctr end as ctr_lower, case when support>=2 then greatest(0e0,purchase-0.5e0*dispersion) else purchase end as purchase_lower, case when support>=2 then 'neighbours' else 'category_prior' end as transfer_source from shrunk),
gate_in as (select *, row_number() over (partition by query_id order by base_score desc, product_id) as base_rank from (select *, round(0.65e0*{_percentile_sql('retrieval_score')}+0.35e0*{_percentile_sql('smoothed_ctr')},9) as base_score from lent) x)"""
_G = GATE
_PROMOTED = _LENT_SQL + f""",
tests as (select g.*, b.max_boost, zero_history=1 as cold, dense_score>={_G.semantic!r}::double as t1, p_irrelevant<={_G.risk!r}::double as t2, compatibility>={_G.compatibility!r}::double as t3, support>={_G.min_support} as t4, confidence>={_G.confidence!r}::double as t5
 from gate_in g cross join (values {', '.join(f'({b!r}::double)' for b in BOOSTS)}) b(max_boost)),
prop as (select *, cold and t1 and t2 and t3 and t4 and t5 as ok, base_rank>{_G.top_k} and base_rank<={_G.top_k + _G.window} as inside from tests),
boosts as (select *, case when ok then least(confidence*greatest(0.75e0*ctr_lower+0.25e0*purchase_lower,0e0), max_boost) else 0e0 end as b0 from prop),
cands as (select *, ok and inside and b0>0 as cand, round(b0+1e-3*target_utility+1e-6*confidence,12) as pri from boosts),
chosen as (select *, cand and row_number() over (partition by query_id, max_boost order by cand desc, pri desc, product_id)<={_G.budget} as sel0 from cands),
tried as (select *, row_number() over (partition by query_id, max_boost order by base_score+case when sel0 then b0 else 0e0 end desc, product_id) as tr from chosen),
settled as (select *, sel0 and tr>{_G.top_k} as refused, sel0 and tr<={_G.top_k} as sel from tried),
final as (select *, case when sel then b0 else 0e0 end as boost, base_score+case when sel then b0 else 0e0 end as final_score,
 case when sel then 'BOOST' when cold and not (t1 and t2 and t3) then 'BLOCK' when cold and support>0 and (not ok or (cand and not sel) or (ok and not inside)) then 'SHRINK' when cold and support=0 then 'FALLBACK' else 'NATIVE' end as action,
 case when sel then 'eligible_reliable_transfer' when refused then 'no_top_k_entry' when cold and not t1 then 'semantic_threshold' when cold and not t2 then 'irrelevant_risk' when cold and not t3 then 'compatibility' when cold and not t4 then 'insufficient_support'
  when cold and not t5 then 'low_confidence' when ok and not inside then 'outside_promotion_window' when cand and not sel then 'promotion_budget' when cold and support=0 then 'no_substitute_support' else 'native_history' end as reason from settled),
promoted as (select *, row_number() over (partition by query_id, max_boost order by final_score desc, product_id) as final_rank from final)"""
_RETRIEVED = ("v_products", "v_queries")
_ALL = ("v_products", "v_queries", "v_interactions", "v_relevance")
_NUMBERS = ", ".join(f"round({c},6) as {c}" if c not in ("query_id", "product_id", "support", "transfer_source") else c for c in _LENT)
_MOVES = " union all ".join(f"select query_id, product_id, {t} as target, base_rank, base_score, n, max(case when base_rank={t} then base_score end) over (partition by query_id) as edge, zero_history from sized" for t in TARGETS)
_ORDERS = {
    "score_desc_id_asc": "base_score desc, product_id", "score_desc_id_desc": "base_score desc, product_id desc", "score_asc_id_asc": "base_score, product_id", "id_asc": "product_id",
    "id_text_asc": "cast(product_id as varchar)", "rounded_desc_id_asc": "round(base_score,3) desc, product_id", "score_desc_id_text": "base_score desc, cast(product_id as varchar)",
}

ORACLE_SQL = {
    "f6_tfidf_top": with_views("with " + _DENSE.strip() + " select query_id, product_id, round(dense_score,6) as dense_score, rank from nearest where rank<=20", *_RETRIEVED),
    "f13_hybrid": with_views("with " + _HYBRID.strip() + " select query_id, product_id, round(bm25_score,6) as bm25_score, round(dense_score,6) as dense_score, candidate_source, round(retrieval_score,6) as retrieval_score from fused", *_RETRIEVED),
    "f14_anchors": with_views("with " + _HYBRID.strip() + " select query_id, product_id from anchor", *_RETRIEVED),
    "f18_intents": with_views("with " + _HYBRID.strip() + """, x as (select q.query_id, lower(q.query) as q, list_filter(string_split(replace(lower(q.query),'_',' '),' '), lambda w: w<>'') as t, p.* from anchor a join v_queries q on q.query_id=a.query_id join v_products p on p.product_id=a.product_id)
 select query_id, case when contains(q,lower(model)) then 'exact_model' when list_has_any(t,string_split(lower(attribute),' ')) then 'attribute' when contains(q,lower(brand)) and list_has_any(t,string_split(replace(lower(category),'_',' '),' ')) then 'brand_category'
  when list_has_any(t,['case','cover','charger','strap','replacement']) then 'accessory' else 'generic' end as intent from x""", *_RETRIEVED),
    "h1_edges": with_views("with " + _EDGES + " select product_id, neighbor_product_id, round(sim,6) as similarity from edges", "v_products"),
    "h3_relation_features": with_views("with " + _HYBRID.strip() + ",\ncatalog as (select * from v_products where launch_block<=4), feats as (" + _features_sql("fused") + ") select query_id, product_id, round(columns(* exclude (query_id, product_id)),6) from feats", *_RETRIEVED),
    "h15_transfer": with_views(_LENT_SQL + f" select {_NUMBERS} from lent", *_ALL[:3]),
    "w9_promotion": with_views(_PROMOTED + " select query_id, product_id, round(max_boost,6) as max_boost, base_rank, round(boost,6) as boost, action, reason, round(final_score,6) as final_score, final_rank from promoted", *_ALL[:3]),
    "w13_order_agreement": with_views(_LENT_SQL + f""", o as (select query_id, {', '.join(f'bool_and(k{i}=base_rank) as a{i}' for i in range(len(_ORDERS)))} from (select query_id, base_rank, {', '.join(f'row_number() over (partition by query_id order by {o}) as k{i}' for i, o in enumerate(_ORDERS.values()))} from gate_in) x group by 1)
 {' union all '.join(f"select '{k}' as strategy, count(*) as queries, cast(coalesce(sum(cast(a{i} as int)),0) as bigint) as agreeing from o" for i, k in enumerate(_ORDERS))}""", *_ALL[:3]),
    "w14_placements": with_views(_LENT_SQL + f""", sized as (select *, count(*) over (partition by query_id) as n from gate_in), moves as ({_MOVES})
 select query_id, product_id, cast(target as bigint) as target, base_rank, case when target<=n and target<=base_rank then target else base_rank end as achieved, target<=n and target<=base_rank as feasible,
  case when target<=n and target<=base_rank then round(round(greatest(edge-base_score,0e0),12),9) end as required_lift from moves where zero_history=1""", *_ALL[:3]),
    "w16_best_proposals": with_views(_LENT_SQL + " select query_id, product_id, round(confidence,6) as confidence, base_rank from (select *, row_number() over (partition by query_id order by confidence desc, compatibility desc, target_utility desc, base_rank, product_id) as k from gate_in where zero_history=1) x where k=1", *_ALL[:3]),
    "n4_boost_sweep": with_views(_PROMOTED + """, g as (select r.max_boost, r.query_id, r.product_id, r.base_rank, r.final_rank, v.relevance as gain, row_number() over (partition by r.query_id, r.max_boost order by v.relevance desc nulls last, r.product_id) as ir
 from promoted r left join v_relevance v on v.query_id=r.query_id and v.product_id=r.product_id),
 d as (select max_boost, query_id, coalesce(sum(case when base_rank<=10 then (pow(2e0,gain)-1)/log2(base_rank+1) end),0e0) as b, coalesce(sum(case when final_rank<=10 then (pow(2e0,gain)-1)/log2(final_rank+1) end),0e0) as f, coalesce(sum(case when ir<=10 then (pow(2e0,gain)-1)/log2(ir+1) end),0e0) as i from g group by 1,2),
 m as (select max_boost, avg(b/i) as bn, avg(f/i) as fn, avg(f/i-b/i) as delta from d where i>0 group by 1),
 c as (select max_boost, sum(case when action='BOOST' then 1 else 0 end) as boosts, count(*) as n from promoted group by 1)
 select round(c.max_boost,6) as max_boost, cast(boosts as bigint) as boosts, n, round(bn,6) as base_ndcg, round(fn,6) as final_ndcg, round(delta,6)+0e0 as delta from c join m on m.max_boost=c.max_boost""", *_ALL),
}
