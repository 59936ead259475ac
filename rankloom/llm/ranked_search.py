"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners: rare and heavy terms to the first, common and light ones to the last, each owner with about the
same number of postings. Items travel in bundles, and documents are dealt to slices; a bundle with a slice carries its
items' terms and a sparse list of document accumulators through the owners, one after the other. At each, a cogroup
brings the slice's postings of the owner's terms, and their integer contributions are added. What lies ahead of an item is
bounded (each term's largest contribution in any document), so an accumulator that can't reach the slice's own k-th best
any more is dropped: no document of the result is. After the last owner each slice names its best, and these are ranked.

A group of a cogroup has the documents of one slice and the items of one bundle, whatever the input.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import join_rows, map_batches, table, text_bytes, written
from rankloom.llm.contamination import words_of

TOP, OWNERS = 50, 4
#: Documents in a slice and items in a bundle, about.
SLICE_DOCS, BUNDLE_ITEMS = 4096, 256
#: Bits of the bitmap of the items' terms, as a power of two: 1 MB whatever the input. What it lets through meets the terms themselves.
BITS = 23
_SCALE, _FLAT, _SATURATION, _GAIN = 1000, 50, 20, 1_000_000_000
_TERM = "_i: bigint, tid: bigint, owner: int, bound: bigint"
ACCUMULATORS = f"bundle int, slice int, terms array<struct<{_TERM}>>, item binary, ord binary, score binary"


def place_of(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - BITS)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, term, place: the distinct terms of each item. Items without an id are left out; rows of one id are one item."""
    rows = text_bytes(items.where(items[item].isNotNull()), item, text=text)

    def batch(b):
        terms = [sorted(set(words_of(t.as_py()))) for t in b.column("_text")]
        return {"item_id": b.column(item), "term": terms, "place": [[place_of(w) for w in x] for x in terms]}

    listed = map_batches(rows, batch, f"item_id {items.schema[item].dataType.simpleString()}, term array<binary>, place array<long>")
    return listed.select("item_id", F.explode(F.arrays_zip("term", "place")).alias("x")).select("item_id", "x.term", "x.place").distinct()


def bitmap(asked: DataFrame) -> np.ndarray:
    """2^BITS bits; at most a 64th as many rows come back."""
    words = asked.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def frequencies(docs: DataFrame, key: str, text: str, known: np.ndarray) -> DataFrame:
    """Per row: key, n (all terms), terms and tf of those that the bitmap knows."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def batch(b):
        bits, asked = shared.value, {}
        out: dict[str, list] = {"n": [], "terms": [], "tf": []}
        for t in b.column("_text"):
            words = words_of(t.as_py())
            counts, own = Counter(words), []
            for w in counts:
                if (hit := asked.get(w)) is None:
                    at = place_of(w)
                    hit = asked[w] = bool(bits[at >> 3] >> (at & 7) & 1)
                if hit:
                    own.append(w)
            out["n"].append(len(words))
            out["terms"].append(own)
            out["tf"].append([counts[w] for w in own])
        return out | {key: b.column(key)}

    return map_batches(text_bytes(docs, key, text=text), batch, f"{key} {docs.schema[key].dataType.simpleString()}, n long, terms array<binary>, tf array<int>", 1000)


def gain() -> Column:
    """What a unit of weight gets from tf occurrences in a document of length measure m."""
    return F.expr(f"({_GAIN} * tf) div ({_SCALE} * tf + {_SATURATION} * m)")


def add_owner(owner: int, last: bool, k: int):
    """The work of one owner on a bundle with a slice."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(left.column(name)[0].as_py(), kind)

        if not left.num_rows:
            return (_best_rows([], [], 0) if last else left)
        terms = left.column("terms").combine_chunks().flatten()
        i, tid, of, bound = (terms.field(f).to_numpy(zero_copy_only=False) for f in ("_i", "tid", "owner", "bound"))
        items, at = np.unique(i, return_inverse=True)
        a_item, a_ord, a_score = column("item", np.int32), column("ord", np.int32), column("score", np.int64)
        p_tid, p_ord, p_gain = (right.column(f).to_numpy() for f in ("tid", "ord", "gain"))
        acc = np.zeros((len(items), max(a_ord.max(initial=-1), p_ord.max(initial=-1)) + 1), np.int64)
        acc[a_item, a_ord] = a_score
        own = np.flatnonzero(of == owner)
        own = own[np.argsort(tid[own], kind="stable")]
        order = np.argsort(p_tid, kind="stable")
        p_tid, p_ord, p_gain = p_tid[order], p_ord[order], p_gain[order]
        first = np.flatnonzero(np.concatenate(([True], p_tid[1:] != p_tid[:-1]))) if len(p_tid) else np.zeros(0, np.int64)
        begin, end = np.searchsorted(tid[own], p_tid[first], "left"), np.searchsorted(tid[own], p_tid[first], "right")
        edge = np.append(first, len(p_tid))
        for a, z, x, y in zip(edge[:-1], edge[1:], begin, end, strict=True):
            acc[np.ix_(at[own[x:y]], p_ord[a:z])] += p_gain[a:z]
        ahead = np.zeros(len(items), np.int64)
        np.add.at(ahead, at, np.where(of > owner, bound, 0))
        best = np.partition(acc, -k, axis=1)[:, -k] if acc.shape[1] > k else np.zeros(len(items), np.int64)
        r, c = np.nonzero((acc > 0) & (acc + ahead[:, None] >= best[:, None]))
        s = acc[r, c]
        if last:
            by = np.lexsort((c, -s, r))  # ordinals follow doc_id
            r, c, s = r[by], c[by], s[by]
            nth = np.arange(len(r)) - np.searchsorted(r, r, "left")
            return _best_rows(items[r[nth < k]], c[nth < k], left.column("slice")[0].as_py(), s[nth < k])
        packed = {"item": r.astype(np.int32), "ord": c.astype(np.int32), "score": s}
        for name, x in packed.items():
            left = left.set_column(left.schema.get_field_index(name), name, pa.array([x.tobytes()], pa.binary()))
        return left

    return add


def _best_rows(item, ord_, slice_: int, score=()) -> pa.Table:
    return pa.table({"_i": pa.array(item, pa.int64()), "slice": pa.array([slice_] * len(item), pa.int32()), "ord": pa.array(ord_, pa.int32()), "score": pa.array(score, pa.int64())})


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: int = OWNERS, text: str = "text", key: str = "doc_id", item: str = "item_id", slice_docs: int = SLICE_DOCS, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """Per item its `k` documents of the highest score above 0: item, rank, key, score; equal scores by ascending key,
    rows without one last. All rows of `docs` are ranked, also those that share a key.

    Null and empty texts have no terms: such documents are in no count and such items have no rows; items without an id are
    left out, and rows that share one are one item with the terms of all. Empty tables give no rows.
    """
    asked = written(item_terms(items, item, text), "item-terms")
    found = written(frequencies(docs, key, text, bitmap(asked)).where("n > 0").withColumn("_d", F.monotonically_increasing_id()), "term-frequencies")
    rows, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    slices = max(1, -(-rows // slice_docs))
    found = found.withColumn("slice", F.pmod(F.xxhash64("_d"), F.lit(slices)).cast("int"))
    by_key = Window.partitionBy("slice").orderBy(F.asc_nulls_last(key))
    placed = found.select("slice", (F.row_number().over(by_key) - 1).alias("ord"), key, "terms", "tf", F.expr(f"100 - {_FLAT} + ({_FLAT} * n * {rows}) div {total}").alias("m"))
    placed = written(placed, "placed-documents")
    each = placed.select("slice", "ord", "m", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("slice", "ord", "m", F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))

    seen = each.groupBy("term").agg(F.count("*").alias("n"), F.max(gain()).alias("most"))
    seen = seen.join(asked.select("term").distinct(), "term").withColumn("w", F.floor(1000 * F.log((2.0 * rows + 2) / (2 * F.col("n") + 1))).cast("long")).where("w > 0")
    seen = written(seen.withColumn("tid", F.monotonically_increasing_id()), "terms")
    cuts = seen.agg(F.percentile("w", [1 - j / owners for j in range(1, owners)], F.col("n"))).first()[0] or []
    owner = sum((F.when(F.col("w") < c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")

    ids = asked.select("item_id").distinct().withColumn("_i", F.monotonically_increasing_id())
    ids = written(ids, "items")
    bundles = max(1, -(-ids.count() // bundle_items))
    asked = asked.join(ids.withColumn("bundle", F.pmod(F.xxhash64("_i"), F.lit(bundles)).cast("int")), "item_id").select("_i", "bundle", "term")
    of_items = asked.groupBy("term").agg(F.count("*").alias("n"), F.collect_set("bundle").alias("bundles"))
    owned = written(seen.withColumn("owner", owner).join(of_items.select("term", "bundles", F.col("n").alias("n_items")), "term"), "owned-terms")
    carried = join_rows(asked, owned.select("term", "tid", "owner", (F.col("w") * F.col("most")).alias("bound"), F.col("n_items").alias("n")), "term")
    carried = carried.groupBy("bundle").agg(F.collect_list(F.struct("_i", "tid", "owner", "bound")).alias("terms"))

    met = join_rows(each, owned.select("term", "tid", "owner", "w", "bundles", "n"), "term")
    met = met.select(F.explode("bundles").alias("bundle"), "slice", "owner", "tid", "ord", (F.col("w") * gain()).alias("gain"))
    posted = written(met.sortWithinPartitions("owner"), "postings")

    none = F.lit(b"")
    state = written(carried, "bundles").select("bundle", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "terms", none.alias("item"), none.alias("ord"), none.alias("score"))
    for o in range(owners):
        last = o == owners - 1
        postings = posted.where(F.col("owner") == o).select("bundle", "slice", "tid", "ord", "gain")
        schema = "_i long, slice int, ord int, score long" if last else ACCUMULATORS
        state = state.groupBy("bundle", "slice").cogroup(postings.groupBy("bundle", "slice")).applyInArrow(add_owner(o, last, k), schema)
    best = state.join(placed.select("slice", "ord", key), ["slice", "ord"])
    order = Window.partitionBy("_i").orderBy(F.desc("score"), F.asc_nulls_last(key))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(ids, "_i").select(F.col("item_id").alias(item), "rank", key, "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS_SQL.format("coalesce(text,'')")} as t from documents),
s as (select r, doc_id, len(t) as n, t from d where len(t)>0),
c as (select count(*) as big_n, sum(n) as big_l from s),
f as (select r, term, count(*) as tf from (select r, unnest(t) as term from s) x group by 1, 2),
q as (select distinct item_id, unnest({_TERMS_SQL.format("coalesce(text,'')")}) as term from benchmark where item_id is not null),
w as (select term, cast(floor(1000*ln(cast(2*big_n+2 as double)/(2*df+1))) as bigint) as w from (select term, count(*) as df from f group by 1) x, c),
m as (select r, doc_id, 50+cast((cast(50 as hugeint)*n*big_n)//big_l as bigint) as m from s, c),
scores as (select q.item_id, f.r, m.doc_id, cast(sum(w.w*((1000000000*f.tf)//(1000*f.tf+20*m.m))) as bigint) as score
 from q join w on w.term=q.term join f on f.term=q.term join m on m.r=f.r group by 1, 2, 3),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score>0)
select * from ranked where rank<={TOP}
"""
