"""Truncated SVD of TF-IDF rows, per scope, and queries in the same space.

The matrix stays a table of (scope, row, term, weight). A randomised range finder multiplies it with a few columns at a time
through joins and sums: signs from a hash of each term, then rounds of transposed and plain products, made orthonormal in
between by the small matrix of all inner products - the only thing that comes to the driver, `width` squared numbers a
scope. The singular vectors of the terms are a table as well; rows and queries are both weighed sums of it.

Products of one text are one row of the matrix, times the root of their number: that has the same factors. Such a row
goes by the smallest id of its products in the scope.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankloom.operators import retrieval, vectors
from rankloom.operators.retrieval import grams
from rankloom.sources.folders import small_tasks, stored

#: Columns beyond those asked for, rounds of products, and the part of the largest eigenvalue below which one is 0.
MORE, ROUNDS, FLAT = 10, 3, 1e-12


@dataclass
class Space:
    """vectors (scope, product_id, vector of length 1) and weights (scope, product_id, n, term, w) with a row of the matrix for
    each text, terms (scope, term, idf, loading), strengths (scope, singular values), sizes (scope, n, v, d), groups (scope, title, n,
    first) and members (scope, title, product_id) as in `retrieval.by_title`. A scope of fewer than two products or terms has no
    factors: its loadings are null, d is 0, and its rows are compared by their TF-IDF weights."""

    vectors: DataFrame
    terms: DataFrame
    strengths: DataFrame
    sizes: DataFrame
    weights: DataFrame
    groups: DataFrame
    members: DataFrame


def term_counts(rows: DataFrame, id_: str, text: str) -> DataFrame:
    counts = rows.select(id_, F.explode(grams(F.col(text))).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("tf"))
    return counts.select(id_, "term", (1 + F.log("tf")).alias("s"))


def weighed(groups: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scope, product_id, n, term, w) with rows of length 1 for the texts of `groups`, (scope, term, held, idf), and (scope, n, v);
    `n` has how many members a scope has. All counts are of members but `held`, which is of texts."""
    text = groups.select("scope", F.col("first").alias("product_id"), "n", F.explode(grams(F.col("title"))).alias("term"))
    inside = stored(text.groupBy("scope", "product_id", "n", "term").agg((1 + F.log(F.count("*"))).alias("s")), "counts")
    df = inside.groupBy("scope", "term").agg(F.sum("n").alias("df"), F.count("*").alias("held")).join(F.broadcast(n.withColumnRenamed("n", "size")), "scope")
    idf = stored(df.select("scope", "term", "held", (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    raw = retrieval.meet(inside, idf).withColumn("w", F.col("s") * F.col("idf"))
    length = raw.groupBy("scope", "product_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
    rows = stored(raw.join(length.hint("merge"), ["scope", "product_id"]).select("scope", "product_id", "n", "term", (F.col("w") / F.col("_length")).alias("w")), "weights")
    return rows, idf, n.join(idf.groupBy("scope").agg(F.count("*").alias("v")), "scope", "left").na.fill(0, ["v"])


def signs(term: Column, width: int) -> Column:
    """`width` numbers of 1 or -1 out of hashes of the term."""
    part = [F.xxhash64(F.lit(i), term) for i in range(-(-width // 64))]
    return F.array(*[(1.0 - 2.0 * F.shiftrightunsigned(part[j // 64], j % 64).bitwiseAND(F.lit(1))) for j in range(width)])


def summed(rows: DataFrame, by: list[str], vector: str, width: int) -> DataFrame:
    """Sums of w times a vector; partial sums meet before the shuffle, so a term of all rows weighs no more than another."""
    sums = rows.groupBy(*by).agg(*[F.sum(F.col("w") * F.get(vector, j)).alias(f"_{j}") for j in range(width)])
    return sums.select(*by, F.array(*[F.coalesce(f"_{j}", F.lit(0.0)) for j in range(width)]).alias("vector"))


def inner_products(rows: DataFrame) -> dict[object, np.ndarray]:
    """Per scope the sum of vector times its transpose."""

    def run(batches):
        held: dict[object, np.ndarray] = {}
        for b in batches:
            scope = np.array(b.column("scope").to_pylist(), object)
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for s in set(scope.tolist()):
                own = x[scope == s]
                held[s] = held.get(s, 0) + own.T @ own
        for s, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * g.size, kind), pa.array(np.arange(g.size)), pa.array(g.ravel())], names=["scope", "at", "x"])

    name, kind = rows.schema["scope"].dataType.simpleString(), to_arrow_type(rows.schema["scope"].dataType)
    parts = rows.mapInArrow(run, f"scope {name}, at long, x double").groupBy("scope", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[object, dict[int, float]] = {}
    for r in parts:
        out.setdefault(r.scope, {})[r["at"]] = r.x
    return {s: np.array([x[i] for i in range(len(x))]).reshape(int(len(x) ** 0.5), -1) for s, x in out.items()}


def factors(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors; what is 0 but for rounding is left out."""
    value, vector = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(-value)
    value, vector = value[order], vector[:, order]
    kept = value > FLAT * max(value[0], 1e-300)
    return value[kept], vector[:, kept]


def times(rows: DataFrame, by: list[str], small: dict[object, np.ndarray]) -> DataFrame:
    """Each vector times its scope's small matrix; short results are filled with 0 to the matrix' height."""
    sent = rows.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        for b in batches:
            scope = np.array(b.column("scope").to_pylist(), object)
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            out = np.zeros_like(x)
            for s in set(scope.tolist()):
                m = sent.value[s]
                out[scope == s, : m.shape[1]] = x[scope == s] @ m
            vector = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], vector], names=[*by, "vector"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    return rows.select(*by, "vector").mapInArrow(run, f"{kinds}, vector array<double>")


def fit(products: DataFrame, members: DataFrame, dimension: int = 64, text: str = "title", rounds: int = ROUNDS) -> Space:
    """The space of each scope of `members` (scope, product_id): min(dimension, products - 1, terms - 1) factors. Null titles have
    no terms: such products have no vector. Signs of factors are arbitrary. Members that carry the text themselves don't
    meet the catalog; others do by a shuffle, as a catalog whose file is small would be sent whole through the driver."""
    spark = products.sparkSession
    listed = members if text in members.columns else members.join(products.select("product_id", text).hint("merge"), "product_id")
    listed = listed.select("scope", F.col(text).alias("title"), "product_id")
    groups = stored(retrieval.by_title(listed, listed, 1)[0], "titles")
    # As many rows as the texts have terms, or fewer.
    n_terms = groups.agg(F.sum(F.greatest(F.size(grams(F.col("title"))), F.lit(0)))).first()[0] or 0
    with small_tasks(spark, n_terms):
        return _fit(groups, listed, n_terms, members.groupBy("scope").agg(F.count("*").alias("n")), dimension, rounds)


def _fit(groups: DataFrame, listed: DataFrame, n_terms: int, n: DataFrame, dimension: int, rounds: int) -> Space:
    spark = groups.sparkSession
    # Titles are short: as files are read, one task would count the terms of a great many.
    weights, idf, sizes = weighed(retrieval.spread(groups, n_terms, "scope", "first"), n)
    d = F.least(F.lit(dimension), F.col("n") - 1, F.col("v") - 1)
    sizes = stored(sizes.withColumn("d", F.when((F.col("n") < 2) | (F.col("v") < 2), 0).otherwise(d).cast("int")), "sizes")
    want = {r.scope: r.d for r in sizes.where("d > 0").collect()}
    width = dimension + MORE
    own = weights.join(F.broadcast(sizes.where("d > 0").select("scope")), "scope", "left_semi").withColumn("w", F.col("w") * F.sqrt("n")).drop("n")
    rows, held = ["scope", "product_id"], idf.select("scope", "term", "held")
    y = stored(summed(own.withColumn("_sign", signs(F.col("term"), width)), rows, "_sign", width), "range")
    for _ in range(rounds):
        z = stored(summed(own.join(y.hint("merge"), rows), ["scope", "term"], "vector", width), "range")
        root = {s: e / np.sqrt(x) for s, (x, e) in ((s, factors(g)) for s, g in inner_products(z).items())}
        basis = stored(times(z, ["scope", "term"], root).join(held, ["scope", "term"]), "basis")
        y = stored(summed(retrieval.meet(own, basis), rows, "vector", width), "range")
    found = {s: factors(g) for s, g in inner_products(y).items()}
    cut = {s: (np.sqrt(x[: want[s]]), e[:, : want[s]]) for s, (x, e) in found.items()}
    kind = groups.schema["scope"].dataType.simpleString()
    strengths = spark.createDataFrame([(s, [float(v) for v in x]) for s, (x, _) in cut.items()], f"scope {kind}, strengths array<double>")
    idf = idf.drop("held")
    if not want:
        terms = idf.withColumn("loading", F.lit(None).cast("array<double>"))
        return Space(own.select("scope", "product_id", F.array().cast("array<double>").alias("vector")), terms, strengths, sizes, weights, groups, listed)
    turn = {s: e for s, (_, e) in cut.items()}
    loading = times(basis, ["scope", "term"], turn).withColumnRenamed("vector", "loading")
    terms = stored(idf.join(loading, ["scope", "term"], "left"), "loadings")
    return Space(stored(of_length_one(times(y, rows, turn)), "vectors"), terms, strengths, sizes, weights, groups, listed)


def of_length_one(rows: DataFrame) -> DataFrame:
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_size", size).withColumn("vector", F.when(F.col("_size") > 0, F.transform("vector", lambda x: x / F.col("_size"))).otherwise(F.col("vector"))).drop("_size")


def encoded(queries: DataFrame, space: Space, text: str = "query") -> DataFrame:
    """scope, query_id, vector: queries as rows of the fitted space, of length 1. Terms that a scope doesn't know count for
    nothing; a query without a known term has no row."""
    asked = term_counts(queries, "query_id", text).join(space.terms.where("loading is not null"), "term").withColumn("w", F.col("s") * F.col("idf"))
    width = space.terms.agg(F.max(F.size("loading"))).first()[0] or 0
    if width <= 0:
        return asked.select("scope", "query_id", F.col("loading").alias("vector"))
    return of_length_one(summed(asked, ["scope", "query_id"], "loading", width))


def plain_scores(queries: DataFrame, space: Space, text: str) -> DataFrame:
    """Cosines of TF-IDF weights in the scopes that have no factors."""
    few = F.broadcast(space.sizes.where("d = 0").select("scope"))
    asked = term_counts(queries, "query_id", text).join(space.terms.join(few, "scope", "left_semi").select("scope", "term", "idf"), "term").withColumn("q", F.col("s") * F.col("idf"))
    length = asked.groupBy("scope", "query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("_length"))
    # The weights are as many as the texts' terms, whether any scope needs them or not.
    dots = asked.join(space.weights.hint("merge"), ["scope", "term"]).groupBy("scope", "query_id", "product_id").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    return dots.join(length, ["scope", "query_id"]).select("scope", "query_id", "product_id", F.round(F.col("dot") / F.col("_length"), 9).alias("dense_score"))


def top(queries: DataFrame, space: Space, k: int, text: str = "query") -> DataFrame:
    """scope, query_id, product_id, dense_score, rank: each query's k best rows of each scope by cosine, ties to the smaller
    id. Queries without a known term have no rows."""
    # Ids of queries are made negative: a product of the same number is another thing.
    asked = encoded(queries, space, text).withColumn("query_id", -F.col("query_id") - 1)
    found = vectors.best_of_blocks(asked, space.vectors.withColumnRenamed("product_id", "vec_id"), k, ["scope"])
    dense = found.select("scope", (-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("product_id"), F.col("similarity").alias("dense_score"))
    every = dense.unionByName(plain_scores(queries, space, text)).withColumnRenamed("product_id", "first")
    # As in `retrieval.best`: the k best texts, and the k smallest ids of each. Both meet by a shuffle, however small their files.
    texts = retrieval.top(every, "dense_score", k, ["scope", "query_id"], "first").drop("rank")
    titled = texts.join(space.groups.select("scope", "title", "first").hint("merge"), ["scope", "first"]).drop("first")
    heads = retrieval.by_title(space.members, space.members, k)[1]
    listed = titled.join(heads.hint("merge"), ["scope", "title"]).select("scope", "query_id", "product_id", "dense_score")
    return retrieval.top(listed, "dense_score", k, ["scope", "query_id"])
