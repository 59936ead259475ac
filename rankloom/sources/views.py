"""The domain tables as views over the given tables. One SQL text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (SQL, names of the views and tables it reads)
VIEWS = {
    "v_products": """
select p_partkey as product_id, concat(p_brand,' ',p_name,' ',p_type) as title, p_brand as brand,
 split_part(p_name,' ',2) as category, split_part(p_name,' ',1) as attribute, concat('M',p_size) as model, lower(p_type) as color,
 p_retailprice as price, cast((p_partkey*7919)%6 as int) as launch_block, round(0.1e0+((p_partkey*104729)%89)/100e0,2) as quality, p_name
from part""",
    "v_queries": """
select query_id, case query_id%4 when 0 then category when 1 then p_name when 2 then concat(brand,' ',category) else concat(brand,' ',model) end as query,
 case query_id%4 when 0 then 'generic' when 1 then 'attribute' when 2 then 'brand_category' else 'exact_model' end as intent,
 category, target_product_id, p_name
from (select cast(dense_rank() over(order by p.p_name)-1 as bigint) as query_id, p.product_id as target_product_id, p.brand, p.model, p.category, p.p_name
 from v_products p join (select p_name, min(product_id) as m from v_products group by p_name) t on p.product_id=t.m) x""",
    "v_relevance": """
select query_id, product_id, case relation when 'exact' then 3 when 'substitute' then 2 when 'complement' then 1 else 0 end as relevance, relation,
 cast(case when relation in ('exact','substitute') then 1 else 0 end as int) as attribute_compatible
from (select q.query_id, p.product_id, case when p.product_id=q.target_product_id or (q.intent='exact_model' and p.brand=t.brand and p.model=t.model) then 'exact'
  when p.category=q.category and (p.attribute=t.attribute or q.intent in ('generic','brand_category')) then 'substitute'
  when p.category=q.category then 'complement' else 'irrelevant' end as relation
 from v_queries q join v_products t on t.product_id=q.target_product_id cross join v_products p
 where p.product_id=q.target_product_id or (q.query_id+p.product_id)%3<>0) x""",
    "v_interactions": """
select e.event_id as event_seq, e.time_block, e.user_id, q.query_id, p.product_id, cast(1+e.event_id%10 as int) as position, 1 as impressed,
 case when e.event_type in ('click','purchase') then 1 else 0 end as clicked, case when e.event_type='purchase' then 1 else 0 end as purchased,
 round(1e0/(1+e.event_id%10),6) as logging_propensity
from (select *, cast(floor((extract(day from ts)-1)/4e0) as int) as time_block,
  (cast(regexp_extract(props,'([0-9]+)',1) as bigint)*20+user_id%20)%(select max(p_partkey)+1 from part) as pid from events) e
join v_products p on p.product_id=e.pid join v_queries q on q.p_name=p.p_name
where e.time_block>=p.launch_block""",
    "v_ope": """
select o_orderkey as obs_id, o_orderstatus as context, o_orderpriority as action, case when o_totalprice>150000 then 1 else 0 end as reward,
 (6-cast(substr(o_orderpriority,1,1) as int))/15e0 as logging_propensity,
 cast(substr(o_orderpriority,1,1) as int)/15e0 as candidate_propensity
from orders""",
    "v_daily": """
select user_id%3 as seed, user_id%2 as proposal_index, event_type as action, k%3 as scenario, k%5 as replication,
 cast(floor((extract(day from ts)-1)/6e0)+1 as int) as day,
 case when event_id%2=0 then 'base' else 'treatment' end as policy, round(sum(value),2) as utility
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k from events) e
group by user_id%3, user_id%2, event_type, k%3, k%5, cast(floor((extract(day from ts)-1)/6e0)+1 as int),
 case when event_id%2=0 then 'base' else 'treatment' end""",
    "v_calibration": """
select d.doc_id, l.quality as y, least(d.n_chars,5000)/5000e0 as p from labels l join documents d on l.doc_id=d.doc_id""",
}
#: For Spark alone: a catalog whose file is small is still too large to be sent whole to all tasks.
HINTS = {"v_interactions": ("select e.event_id", "select /*+ merge(p) */ e.event_id")}
READS = {
    "v_products": ["part"], "v_queries": ["v_products"], "v_relevance": ["v_queries", "v_products"], "v_interactions": ["events", "part", "v_products", "v_queries"],
    "v_ope": ["orders"], "v_daily": ["events"], "v_calibration": ["labels", "documents"],
}


def needed(names: list[str]) -> list[str]:
    """The views behind `names`, each after what it reads."""
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [x for x in [*needed(READS[n]), n] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str, **done: DataFrame) -> DataFrame:
    """One domain table. The given tables it reads become temporary views of this session. Views that are `done`, worked out
    before, are read as they are."""
    for v, df in done.items():
        df.createOrReplaceTempView(v)
    for v in needed([name]):
        if v in done:
            continue
        for t in READS[v]:
            if t not in VIEWS:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        spark.sql(VIEWS[v].replace(*HINTS[v]) if v in HINTS else VIEWS[v]).createOrReplaceTempView(v)
    return spark.table(name) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judgments(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """The rows of v_relevance for `pairs` (query_id, product_id) alone: those that are asked for are judged, where the view has
    every query with every product."""
    for v in READS["v_relevance"]:
        view(spark, sf_dir, v)
    asked = pairs.select("query_id", "product_id").distinct()
    asked.createOrReplaceTempView("v_asked")
    # A catalog whose file is small would be sent whole to all tasks: only what is asked for or a query's own is joined, by a shuffle.
    ids = asked.select("product_id").union(spark.table("v_queries").select("target_product_id")).distinct()
    spark.table("v_products").join(ids, "product_id", "left_semi").createOrReplaceTempView("v_known")
    sql = VIEWS["v_relevance"].replace("cross join v_products p", "join v_asked a on a.query_id=q.query_id join v_known p on p.product_id=a.product_id")
    return spark.sql(sql.replace("join v_products t", "join v_known t").replace("select q.query_id,", "select /*+ merge(t, p) */ q.query_id,"))


def with_views(sql: str, *names: str) -> str:
    """`sql` for the oracle, which has the given tables alone."""
    heads = [f"{v} as ({VIEWS[v].strip()})" for v in needed(list(names))]
    body = sql.strip()
    if body[:5].lower() == "with ":
        return "with " + ",\n".join(heads) + ",\n" + body[5:]
    return "with " + ",\n".join(heads) + "\n" + body
