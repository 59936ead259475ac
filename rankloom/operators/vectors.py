"""Nearest rows by cosine: exact in blocks, over all rows or within groups, and approximate through hash tables.

Queries and rows are dealt to blocks; each pair of blocks meets in one group of a cogroup, is multiplied there and gives
back the k best rows of each query, and a window merges these. No pair of rows ever is a row of a table, no group is larger
than a block, and large groups (a category, a hash bucket, all rows) take as many blocks as they need.
"""

from __future__ import annotations

from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries in a block, about, and queries multiplied at a time.
ROW_BLOCK, QUERY_BLOCK, SET_BLOCK, AT_A_TIME = 16_384, 4096, 2048, 256
PLACES = 9


def unit(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of numbers as rows of length 1; without length they stay 0."""
    x = column.combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def dense_scores(q: pa.ChunkedArray, v: pa.ChunkedArray):
    a, b = unit(q), unit(v)
    return lambda at: a[at] @ b.T


def set_scores(q: pa.ChunkedArray, v: pa.ChunkedArray):
    """Cosine of sets of words: shared words over the root of both sizes. Words meet through lists of their rows."""
    held: dict[str, tuple[list[int], list[int]]] = {}
    for side, rows in enumerate((q.to_pylist(), v.to_pylist())):
        for i, words in enumerate(rows):
            for w in words:
                held.setdefault(w, ([], []))[side].append(i)
    shared = np.zeros((len(q), len(v)), np.int32)
    for a, b in held.values():
        if a and b:
            shared[np.ix_(a, b)] += 1
    size = lambda c: np.array([len(x) for x in c.to_pylist()], np.int64)
    both = np.sqrt((size(q)[:, None] * size(v)[None, :]).astype(np.float64))
    found = np.divide(shared, both, out=np.zeros(shared.shape), where=both > 0)
    return lambda at: found[at]


def in_blocks(rows: DataFrame, within: list[str], block: int, name: str) -> DataFrame:
    """Groups of more than `block` rows, with how many blocks they take; at most one in `block` rows is such a group."""
    counts = rows.groupBy(*within) if within else rows.groupBy(F.lit(0).alias("_all"))
    return counts.agg(F.ceil(F.count("*") / block).cast("int").alias(name)).where(f"{name} > 1")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, within: list[str] = (), sets: bool = False, row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: for each of `queries` (query_id, vector, and the columns `within`) its k nearest of
    `rows` (vec_id, vector, within) that agree with it in `within`, the row of its own id left out; ties to the smaller
    id. Vectors are arrays of numbers of one length or, with `sets`, arrays of distinct words. Rows without a vector or an id
    are left out; a vector without length is similar to none (0). An id belongs to one group and one row."""
    return ranked(best_of_blocks(queries, rows, k, within, sets, row_block, query_block), k)


def best_of_blocks(queries: DataFrame, rows: DataFrame, k: int, within: list[str] = (), sets: bool = False, row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """The columns `within`, query_id, vec_id, similarity: each query's k best of each block of rows that it meets."""
    row_block, query_block = row_block or (SET_BLOCK if sets else ROW_BLOCK), query_block or (SET_BLOCK if sets else QUERY_BLOCK)
    within = list(within)
    keys = within or ["_all"]
    has = lambda df, id_: (df if within else df.withColumn("_all", F.lit(0))).where(f"vector is not null and {id_} is not null").select(*[F.col(c).alias(c) for c in (*keys, id_, "vector")])
    q, v = has(queries, "query_id"), has(rows, "vec_id")
    for c in within:
        q, v = q.where(F.col(c).isNotNull()), v.where(F.col(c).isNotNull())
    sizes = [F.broadcast(in_blocks(v, keys, row_block, "_nv")), F.broadcast(in_blocks(q, keys, query_block, "_nq"))]

    def dealt(df: DataFrame, id_: str) -> DataFrame:
        for s in sizes:
            df = df.join(s, keys, "left")
        df = df.na.fill(1, ["_nv", "_nq"])
        own, other, n, m = ("_q", "_v", "_nq", "_nv") if id_ == "query_id" else ("_v", "_q", "_nv", "_nq")
        placed = df.withColumn(own, F.pmod(F.xxhash64(id_), F.col(n)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).select(*keys, "_q", "_v", id_, "vector")

    score = set_scores if sets else dense_scores
    kinds = pa.schema([pa.field("query_id", pa.int64()), pa.field("vec_id", pa.int64()), pa.field("similarity", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema([*[(left if left.num_rows else right).schema.field(c) for c in within], *kinds]).empty_table()
        right = right.sort_by("vec_id")
        ids, v = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        scores, out = score(left.column("vector"), right.column("vector")), []
        for at in range(0, len(ids), AT_A_TIME):
            part = slice(at, at + AT_A_TIME)
            found = np.round(scores(part), PLACES)
            found[ids[part, None] == v[None, :]] = -np.inf
            if len(v) > 4 * k:
                # Rows below the k-th best can't be among them; those that tie with it can.
                least = np.partition(found, -k, axis=1)[:, -k]
                i, j = np.nonzero((found >= least[:, None]) & np.isfinite(found))
            else:
                i, j = np.nonzero(np.isfinite(found))
            s = found[i, j]
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.table([ids[part][i[kept]], v[j[kept]], s[kept]], schema=kinds))
        found = pa.concat_tables(out)
        for n, c in enumerate(within):
            found = found.add_column(n, c, pa.array([left.column(c)[0].as_py()] * len(found), left.schema.field(c).type))
        return found

    cast = lambda df, id_: df.withColumn(id_, F.col(id_).cast("long"))
    group = [*keys, "_q", "_v"]
    return dealt(cast(q, "query_id"), "query_id").groupBy(*group).cogroup(dealt(cast(v, "vec_id"), "vec_id").groupBy(*group)).applyInArrow(best, "".join(f"{c} {dict(q.dtypes)[c]}, " for c in within) + "query_id long, vec_id long, similarity double")


def agreement(cosine: float) -> float:
    """The chance that two vectors of this cosine lie on one side of a random plane."""
    return 1 - acos(max(-1.0, min(1.0, cosine))) / pi


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Hash tables of `bits` planes each, so that a pair of at least this cosine shares a bucket with chance `recall`."""
    return max(1, ceil(log(1 - recall) / log(1 - agreement(cosine) ** bits))) if cosine < 1 else 1


def planes(dimension: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dimension))


def hashed(df: DataFrame, id_: str, normals: np.ndarray, tables: int, bits: int) -> DataFrame:
    """A row for each table: table, bucket (the sides of its planes), id and vector."""
    sent, kind = df.sparkSession.sparkContext.broadcast(normals), dict(df.dtypes)["vector"]
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            x = unit(pa.chunked_array([b.column("vector")]))
            side = (x @ sent.value.T > 0).reshape(len(x), tables, bits)
            code = pa.array((side * weights).sum(2).ravel())
            buckets = pa.ListArray.from_arrays(np.arange(0, len(x) * tables + 1, tables, dtype=np.int32), code)
            yield pa.RecordBatch.from_arrays([b.column(id_), b.column("vector"), buckets], names=[id_, "vector", "buckets"])

    coded = df.where(f"vector is not null and {id_} is not null").select(F.col(id_).cast("long").alias(id_), "vector").mapInArrow(run, f"{id_} long, vector {kind}, buckets array<long>")
    return coded.select(id_, "vector", F.posexplode("buckets").alias("table", "bucket"))


def approximate(queries: DataFrame, rows: DataFrame, k: int, dimension: int, bits: int = 4, cosine: float = 0.3, recall: float = 0.97, seed: int = 7) -> DataFrame:
    """query_id, vec_id, similarity, rank as `nearest` gives them, among the rows that share a bucket with the query in any
    hash table of random planes; similarities are exact. A row of at least `cosine` is met with chance `recall`: near
    neighbours of high cosine take many bits and few tables, far ones (`cosine` 0.3) few bits and many tables."""
    tables = tables_for(bits, cosine, recall)
    normals = planes(dimension, tables, bits, seed)
    q, v = (hashed(df, id_, normals, tables, bits) for df, id_ in ((queries, "query_id"), (rows, "vec_id")))
    # A row that shares several buckets with a query comes back from each.
    met = best_of_blocks(q, v, k, ["table", "bucket"]).groupBy("query_id", "vec_id").agg(F.max("similarity").alias("similarity"))
    return ranked(met, k)


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n (rows of `exact`), hits (those of them that `found` has) and recall."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.select("query_id", "vec_id").join(hit, ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))


def as_vectors(df: DataFrame, id_: str, to: str, vector: str = "embedding") -> DataFrame:
    return df.select(F.col(id_).alias(to), F.col(vector).alias("vector"))

