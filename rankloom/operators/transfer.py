"""Behaviour lent to products without history by similar products of their category: neighbour edges, relation
features of (query, product), and the weighted, shrunk rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import vectors
from rankloom.operators.retrieval import tokens, top
from rankloom.sources.folders import stored

# Intents, words that mark an accessory query, and the utility of each relation.
INTENTS = ["exact_model", "attribute", "brand_category", "generic", "accessory"]
ACCESSORY = ["case", "cover", "charger", "strap", "replacement"]
UTILITY = {"exact": 1.0, "substitute": 0.85, "complement": 0.08}


def edges(products: DataFrame, width: int, within: list[str], asked: DataFrame | None = None) -> DataFrame:
    """product_id, neighbor_product_id, similarity: the `width` nearest products of each one's group by the cosine of their
    titles' sets of words, ties to the smaller id; with `asked` (product_id) those of its products alone. All products of a
    group are compared, in blocks, but products of one set of words as one: only sets are compared, each named by its smallest
    id. A set's list has one product more than `width`, for those of its own that are left out of their own lists."""
    named = products.select(*within, "product_id", "title").where("title is not null and product_id is not null")
    for c in within:
        named = named.where(F.col(c).isNotNull())
    key, of_text = [*within, "vector"], [*within, "title"]
    # A set's smallest ids are among the smallest of its texts: few rows of the catalog go further.
    by_text = Window.partitionBy(*of_text).orderBy("product_id")
    smallest = stored(named.select(*of_text, "product_id").withColumn("_nth", F.row_number().over(by_text)).where(F.col("_nth") <= width + 1), "smallest")
    # Words are taken from each text once; products meet the set of their text by a shuffle, not sent whole to all tasks.
    texts = smallest.where("_nth = 1").select(*of_text, F.col("product_id").alias("first")).withColumn("vector", F.array_sort(F.array_distinct(tokens(F.col("title"), 1))))
    sets = texts.groupBy(*key).agg(F.min("first").alias("set_id"))
    set_of = texts.select(*key, "title").join(sets, key).select(*of_text, "set_id")
    met = vectors.nearest(sets.select(*within, "vector", F.col("set_id").alias("query_id")), sets.select(*within, "vector", F.col("set_id").alias("vec_id")), width, within, sets=True)
    own = sets.select(F.col("set_id").alias("query_id"), F.col("set_id").alias("vec_id"), F.when(F.size("vector") > 0, 1.0).otherwise(0.0).alias("similarity"))
    nth = Window.partitionBy("set_id").orderBy("product_id")
    placed = smallest.hint("merge").join(set_of, of_text).select("set_id", "product_id")
    heads = placed.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= width + 1).select(F.col("set_id").alias("vec_id"), "product_id")
    found = top(met.select("query_id", "vec_id", "similarity").union(own).join(heads, "vec_id"), "similarity", width + 1, ["query_id"])
    lists = found.groupBy(F.col("query_id").alias("set_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "product_id", "similarity"))).alias("_list"))
    members = named if asked is None else named.join(asked.select("product_id").distinct(), "product_id", "left_semi")
    placed = members.hint("merge").join(set_of, of_text).select("set_id", "product_id")
    rows = placed.join(lists, "set_id").select("product_id", F.slice(F.filter("_list", lambda x: x["product_id"] != F.col("product_id")), 1, width).alias("_list"))
    return rows.select("product_id", F.explode("_list").alias("_e")).select("product_id", F.col("_e.product_id").alias("neighbor_product_id"), "_e.similarity")


def features(rows: DataFrame) -> dict[str, Column]:
    """The 19 relation features of rows with query, query_category, intent, the product's title, category, attribute,
    brand, model, quality and price, and its anchor's as anchor_*. A null anchor matches nothing."""
    q = F.array_distinct(tokens(F.col("query"), 1))
    title = F.array_distinct(tokens(F.col("title"), 1))
    num = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    named = lambda c: num((F.length(c) > 0) & F.contains(F.lower("query"), F.lower(c)))
    out = {
        "overlap": F.size(F.array_intersect(q, title)) / F.greatest(F.size(F.array_union(q, title)), F.lit(1)),
        "category_hit": num(F.arrays_overlap(q, tokens(F.replace("category", F.lit("_"), F.lit(" ")), 1))),
        "attribute_hit": num(F.arrays_overlap(q, tokens(F.col("attribute"), 1))),
        "brand_named": named(F.col("brand")), "model_named": named(F.col("model")),
        "category_match": num(F.col("category") == F.col("query_category")),
    }
    out |= {f"anchor_{c}_match": num(F.col(c) == F.col(f"anchor_{c}")) for c in ("category", "attribute", "brand", "model")}
    out |= {"accessory": num(F.arrays_overlap(q, F.array(*[F.lit(w) for w in ACCESSORY]))), "query_length": F.least(F.size(q), F.lit(12)) / 12}
    out |= {f"intent_{i}": num(F.col("intent") == i) for i in INTENTS}
    return out | {"quality_value": F.col("quality").cast("double"), "price_value": F.log1p(F.greatest(F.col("price"), F.lit(0.0))) / 10}


def rule_relations(rows: DataFrame) -> DataFrame:
    """p_exact, p_substitute, p_complement, p_irrelevant from the features by a fixed softmax: a stand-in for a fitted
    classifier, with the same columns."""
    logits = {
        "exact": 3 * F.col("model_named") + 2 * F.col("overlap") + F.col("anchor_model_match"), "substitute": 2 * F.col("category_match") + F.col("attribute_hit") + F.col("anchor_attribute_match"),
        "complement": F.col("category_hit") + F.col("accessory"), "irrelevant": 2 - 2 * F.col("category_match"),
    }
    out = rows.withColumns({f"_{k}": F.exp(v) for k, v in logits.items()})
    total = sum((F.col(f"_{k}") for k in logits), F.lit(0.0))
    return out.withColumns({f"p_{k}": F.col(f"_{k}") / total for k in logits}).drop(*[f"_{k}" for k in logits])


def utility() -> Column:
    return sum((w * F.col(f"p_{k}") for k, w in UTILITY.items()), F.lit(0.0))


def relations(pairs: DataFrame, queries: DataFrame, products: DataFrame, anchors: DataFrame) -> DataFrame:
    """Features of each (query_id, product_id). Query and anchor attributes are joined by key; what the query table
    lacks falls back to 'generic' and 'unknown'."""
    named = ["category", "attribute", "brand", "model"]
    of_anchor = anchors.join(products.select("product_id", *[F.col(c).alias(f"anchor_{c}") for c in named]), "product_id", "left").drop("product_id")
    asked = queries.select("query_id", "query", F.coalesce("intent", F.lit("generic")).alias("intent"), F.coalesce("category", F.lit("unknown")).alias("query_category"))
    rows = pairs.join(asked, "query_id").join(of_anchor, "query_id", "left").join(products.select("product_id", "title", *named, "quality", "price"), "product_id")
    cols = features(rows)
    return rows.select("query_id", "product_id", *[v.alias(k) for k, v in cols.items()])


def query_context(rows: DataFrame, queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """time_block, query_id, query, query_category, intent, anchor: the context in which each (time_block, query_id) of `rows` is
    scored. What the rows say themselves (query_text, query_category, query_intent, query_anchor_product_id; the smallest
    value where they differ) goes before the query table (query, category, intent) and `anchors` (query_id, product_id), and these
    before 'unknown' and 'generic'. Without any anchor it is the row of the greatest retrieval_score, or of the greatest
    bm25_score + dense_score where rows carry none, ties to the smaller id. A query without a text fails the job."""
    has = set(rows.columns)
    own = lambda c: F.min(c) if c in has else F.lit(None).cast("string")
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) if c in has else F.lit(0.0)
    fused = number("retrieval_score") if "retrieval_score" in has else number("bm25_score") + number("dense_score")
    by = rows.groupBy("time_block", "query_id").agg(
        own("query_text").alias("_text"), own("query_category").alias("_category"), own("query_intent").alias("_intent"), own("query_anchor_product_id").cast("long").alias("_anchor"),
        F.max_by("product_id", F.struct(fused, -F.col("product_id"))).alias("_best"))
    known = by.join(queries.select("query_id", "query", "category", "intent"), "query_id", "left").join(anchors.select("query_id", F.col("product_id").alias("_given")), "query_id", "left")
    text = F.coalesce("_text", "query", F.lit(""))
    checked = F.when(text == "", F.raise_error(F.concat(F.lit("no text of query "), F.col("query_id").cast("string"))).cast("string")).otherwise(text)
    return known.select(
        "time_block", "query_id", checked.alias("query"), F.coalesce("_category", "category", F.lit("unknown")).alias("query_category"), F.coalesce("_intent", "intent", F.lit("generic")).alias("intent"),
        F.coalesce("_anchor", "_given", "_best").alias("anchor"))


def checked_blocks(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """`rows`, if every time_block they ask for is one of `reference`; an error that names those which are not, if not."""
    lost = rows.select("time_block").distinct().join(reference.select("time_block").distinct(), "time_block", "left_anti")
    # Blocks are few; ten are enough to name.
    if gone := [r.time_block for r in lost.orderBy("time_block").limit(10).collect()]:
        raise ValueError(f"the behaviour reference has no rows of the blocks {gone}")
    return rows


def transfer(targets: DataFrame, related: DataFrame, graph: DataFrame, state: DataFrame, priors: DataFrame, products: DataFrame, n: int = 8, min_support: int = 2) -> DataFrame:
    """Per target (query_id, product_id) the lent rates. `related` has p_* of targets and of their neighbours, `state`
    the counts and rates of products at the block (one row a product), `priors` the rates by category with the global
    ones for the rest. Only neighbours with impressions and a positive weight lend, the `n` heaviest of them; a row
    depends on no other candidate. Below `min_support` the category's rates stand, with confidence 0 and dispersion 1."""
    world = F.broadcast(priors.select(F.first("global_prior_ctr").alias("gc"), F.first("global_prior_purchase").alias("gp")))
    kinds = products.select("product_id", "category", "attribute").join(priors.select("category", "prior_ctr", "prior_purchase"), "category", "left").join(world)
    kinds = kinds.select("product_id", "attribute", F.coalesce("prior_ctr", "gc").alias("prior_ctr"), F.coalesce("prior_purchase", "gp").alias("prior_purchase"))
    rows = targets.select("query_id", "product_id").join(related.select("query_id", "product_id", utility().alias("target_utility"), "p_irrelevant", F.greatest(F.least(F.col("p_exact") + F.col("p_substitute"), F.lit(1.0)), F.lit(0.0)).alias("compatibility")), ["query_id", "product_id"]).join(kinds, "product_id")
    lent = state.where("prior_impressions > 0").select(F.col("product_id").alias("neighbor_product_id"), F.col("smoothed_ctr").alias("ctr"), F.col("smoothed_purchase_rate").alias("pr"))
    # Edges meet history before queries do: products without impressions lend nothing to any query.
    lenders = graph.where("similarity > 0").join(lent, "neighbor_product_id").join(products.select(F.col("product_id").alias("neighbor_product_id"), F.col("attribute").alias("n_attribute")), "neighbor_product_id")
    lenders = lenders.join(products.select("product_id", "attribute"), "product_id").withColumn("pair", F.coalesce(F.col("attribute") == F.col("n_attribute"), F.lit(False)).cast("double")).drop("attribute", "n_attribute")
    found = rows.select("query_id", "product_id").join(lenders, "product_id").join(related.select("query_id", F.col("product_id").alias("neighbor_product_id"), utility().alias("u")), ["query_id", "neighbor_product_id"])
    found = found.withColumn("w", F.round(F.col("similarity") * F.col("u") * (0.2 + 0.8 * F.col("pair")), 12)).where("w > 0")
    best = top(found, "w", n, ["query_id", "product_id"], "neighbor_product_id")
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    by = best.groupBy("query_id", "product_id").agg(
        F.count("*").alias("support"), mean(F.col("ctr")).alias("n_ctr"), mean(F.col("pr")).alias("n_pr"), mean(F.col("u")).alias("n_quality"), mean(F.col("pair")).alias("n_pair"), mean(F.col("ctr") * F.col("ctr")).alias("n_sq"))
    out = rows.join(by, ["query_id", "product_id"], "left").na.fill(0, ["support"])
    enough = F.col("support") >= min_support
    score = F.least(F.lit(1.0), F.col("support") / max(n, 1))
    spread = F.when(enough, F.sqrt(F.greatest(F.col("n_sq") - F.col("n_ctr") * F.col("n_ctr"), F.lit(0.0)))).otherwise(1.0)
    sure = F.col("n_quality") * F.col("n_pair") * F.col("compatibility") * F.col("support_score") * F.greatest(F.lit(0.0), 1 - F.least("dispersion", F.lit(1.0)))
    out = out.withColumns({"support_score": score, "dispersion": spread}).withColumn("confidence", F.when(enough, F.greatest(F.least(sure, F.lit(1.0)), F.lit(0.0))).otherwise(0.0))
    shrunk = lambda a, b: F.when(enough, F.col("confidence") * F.col(a) + (1 - F.col("confidence")) * F.col(b)).otherwise(F.col(b))
    low = lambda c, part: F.when(enough, F.greatest(F.lit(0.0), F.col(c) - part * F.col("dispersion"))).otherwise(F.col(c))
    out = out.withColumns({"ctr": shrunk("n_ctr", "prior_ctr"), "purchase": shrunk("n_pr", "prior_purchase")})
    return out.select(
        "query_id", "product_id", "target_utility", "p_irrelevant", "compatibility", "support", "support_score", "dispersion", "confidence", "ctr", "purchase",
        low("ctr", 1.0).alias("ctr_lower"), low("purchase", 0.5).alias("purchase_lower"), F.when(enough, "neighbours").otherwise("category_prior").alias("transfer_source"))
