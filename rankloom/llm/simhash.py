"""SimHash near-duplicates: fingerprints, links at a few differing bits, and groups.

Links are found by the generalised pigeonhole principle. The 64 bits of a fingerprint are dealt into parts, bits that go
together into one part. For fingerprints that differ in at most t bits, and thresholds t_i >= -1 with
sum(t_i + 1) = t + 1, some part differs in at most t_i bits. Each fingerprint gets thresholds of its own, by dynamic
programming over what each part would cost: the fingerprints estimated to lie within each radius of its value, from
histograms of eight bits each, and the probes themselves. It then probes the values within t_i, and what it meets is
verified. Parts grow wider with the number of fingerprints, so that a value stays rare.

Copies share a fingerprint and meet as one. What shares a value is compared in blocks of bounded size, and each
block gives back a spanning forest, so the links written grow with the fingerprints and not with their pairs.

`near_duplicates` links fingerprints at a few bits. `similar` finds texts of shingle similarity >= 4/5: at 4/5 some 15 %
of a fingerprint's bits differ, which no few bits of 64 cover, so each text has several independent fingerprints, any of
which may bring a pair together, and what meets is verified by the sets of shingles.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import LOWER_BYTES, batch_rows, join_rows, map_batches, table, text_bytes, written
from rankloom.llm.shingle_sets import blocked, linked, shingles

SHINGLE, DIFFER = 3, 3
#: Fingerprints compared with one another in one block, and rows in one task.
BLOCK, ROWS = 8_000, 60_000
#: Pairs met by `similar` are verified by their sets if at most NEAR of 128 bits differ: of texts of similarity 4/5 about
#: 19 do (at most 34 but for one pair in 5,000), of unrelated ones 64.
NEAR = 34


def parts_for(n: int) -> int:
    """Parts of the 64 bits for n fingerprints: 16, 21 or 32 bits wide."""
    return 4 if n <= 1 << 24 else 3 if n <= 1 << 30 else 2


def words_for(parts: int) -> int:
    """Fingerprints a text needs, so that a pair of similarity 4/5 meets in some part with chance 0.95: a bit then agrees
    with chance 0.8485, and parts * words parts must hold an agreement, about 3 on average."""
    return ceil(3 / (parts * 0.8485 ** (64 / parts)))


def fingerprint(text: bytes, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """Bit i is 1 if more than half the shingles' XXH64 (seed 42) have it set; 0 for a text without words. Fingerprints
    after the first take the hash mixed with a number of their own."""
    from xxhash import xxh64_intdigest

    own = text.translate(LOWER_BYTES).split()
    if not own:
        return np.zeros(words, np.uint64)
    joined = b" ".join(own)
    ends = [x - 1 for x in accumulate([len(w) + 1 for w in own])]
    starts, shingle = [0, *[x + 1 for x in ends]], min(shingle, len(own))
    sums, n, step = np.zeros(64 * words, np.int64), len(own) - shingle + 1, 65536 // words
    for at in range(0, n, step):
        h = np.array([xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts[at : min(n, at + step)], ends[at + shingle - 1 :], strict=False)], np.uint64)
        sums += np.unpackbits(several(h, words).view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * sums > n).view(np.uint64)


def several(h: np.ndarray, words: int) -> np.ndarray:
    """(len(h), words): the hashes themselves, then mixtures of them."""
    x = h[:, None] + np.arange(words, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = h
    return np.ascontiguousarray(x)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp (the fingerprint as a signed long)."""
    kind = docs.select(key).schema[key].dataType.simpleString()

    def batch(b):
        fp = np.array([fingerprint(t.as_py(), shingle)[0] for t in b.column("_text")], np.uint64).view(np.int64)
        return {key: b.column(key), "fp": fp}

    return map_batches(text_bytes(docs, key, text=text), batch, f"{key} {kind}, fp long")


def words_in(b: pa.RecordBatch) -> np.ndarray:
    """(rows, words): the fingerprints in column `fps`, an array of longs in each row."""
    return b.column("fps").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)


def bit_parts(nodes: DataFrame, words: int, parts: int) -> list[list[list[int]]]:
    """For each fingerprint of a row the bits of each part, correlated bits together, from the co-occurrence of bits over
    all rows (2,080 numbers a fingerprint come back)."""

    def batch(b):
        i, j = np.triu_indices(64)
        out = []
        for k, x in enumerate(words_in(b).T):
            bit = np.unpackbits(np.ascontiguousarray(x).byteswap().view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            out.append((np.full(len(i), k), i, j, (bit.T @ bit).astype(np.int64)[i, j]))
        return dict(zip(("word", "i", "j", "n"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)) if out else None

    every = np.zeros((words, 64, 64))
    for r in map_batches(nodes.select("fps"), batch, "word int, i int, j int, n long").groupBy("word", "i", "j").agg(F.sum("n").alias("n")).collect():
        every[r["word"], r["i"], r["j"]] = every[r["word"], r["j"], r["i"]] = r["n"]
    total = max(1.0, float(nodes.count()))
    return [grouped_bits(both, total, parts) for both in every]


def grouped_bits(both: np.ndarray, total: float, parts: int) -> list[list[int]]:
    p = np.diag(both) / total
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / total - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = (64 * (k + 1)) // parts - (64 * k) // parts
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def chunks(bits: list[int]) -> list[list[int]]:
    return [bits[i : i + 8] for i in range(0, len(bits), 8)]


def nearby(nodes: DataFrame, bits: list[list[list[int]]], differ: int) -> dict[tuple[int, int], list[np.ndarray]]:
    """For each part (word, part) and each eight bits of it an array (differ + 1, 256): the share of all rows at each
    distance from each value. 256 numbers come back for each eight bits, whatever the number of rows."""
    places = [(w, p, c, own) for w, parts in enumerate(bits) for p, part in enumerate(parts) for c, own in enumerate(chunks(part))]

    def batch(b):
        x = words_in(b)
        n = np.stack([np.bincount(values(x[:, w], own), minlength=256) for w, _, _, own in places])
        at, value = np.nonzero(n)
        return {"at": at, "value": value, "n": n[at, value]}

    count = np.zeros((len(places), 256))
    for r in map_batches(nodes.select("fps"), batch, "at int, value int, n long").groupBy("at", "value").agg(F.sum("n").alias("n")).collect():
        count[r["at"], r["value"]] = r["n"]
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for (w, p, _, own), n in zip(places, count, strict=True):
        layer = np.zeros((differ + 1, 256))
        layer[0] = n / max(1.0, n.sum())
        for k in range(len(own)):
            flipped = layer[:, np.arange(256) ^ (1 << k)]
            layer[1:] += flipped[:-1]
        out.setdefault((w, p), []).append(layer)
    return out


def part_costs(fps: np.ndarray, bits: list[int], layers: list[np.ndarray], total: int) -> np.ndarray:
    """(differ + 2, rows): what threshold -1, 0, ... costs each row - rows estimated to lie within it (eight bits taken as
    independent of the others), and probes."""
    share = None
    for own, layer in zip(chunks(bits), layers, strict=True):
        new = layer[:, values(fps, own)]
        share = new if share is None else np.stack([sum(share[i] * new[r - i] for i in range(r + 1)) for r in range(len(new))])
    probes = np.array([comb(len(bits), r) for r in range(len(share))], np.float64)
    return np.concatenate([np.zeros((1, len(fps))), np.cumsum(total * share + probes[:, None], axis=0)])


def thresholds(cost: list[np.ndarray], differ: int) -> np.ndarray:
    """For each row the cheapest thresholds, as t_i + 1 by part."""
    n, budget = cost[0].shape[1], differ + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    took = []
    for c in cost:
        choice = np.stack([np.where(np.arange(budget + 1) >= u, np.roll(best, u, axis=1) + c[u][:, None], np.inf) for u in range(budget + 1)])
        took.append(choice.argmin(0))
        best = choice.min(0)
    out, left, row = np.zeros((n, len(cost)), np.int64), np.full(n, budget), np.arange(n)
    for k in range(len(cost) - 1, -1, -1):
        out[:, k] = took[k][row, left]
        left -= out[:, k]
    return out


def entries(nodes: DataFrame, bits: list[list[list[int]]], near: dict, total: int, differ: int) -> DataFrame:
    """place (which part), value, node, x, y: each row under its own value in every part, and under the values it probes.
    x and y are its first two fingerprints (y is 0 if it has one only)."""
    shared = nodes.sparkSession.sparkContext.broadcast(near)

    def batch(b):
        fps, node, out = words_in(b), b.column("node").to_numpy(), []
        x, y = fps[:, 0].view(np.int64), (fps[:, 1] if fps.shape[1] > 1 else np.zeros(len(fps), np.uint64)).view(np.int64)
        for w, parts in enumerate(bits):
            t = thresholds([part_costs(fps[:, w], own, shared.value[w, p], total) for p, own in enumerate(parts)], differ)
            for p, own in enumerate(parts):
                at = values(fps[:, w], own)
                out.append((w * 4 + p, at, node, x, y))
                for radius in range(1, differ + 1):
                    probing = t[:, p] > radius
                    if probing.any():
                        for flip in combinations(range(len(own)), radius):
                            out.append((w * 4 + p, at[probing] ^ sum(1 << f for f in flip), node[probing], x[probing], y[probing]))
        if not out:
            return None
        cols = [np.concatenate([np.full(len(o[1]), o[0]) for o in out]), *(np.concatenate(c) for c in list(zip(*out, strict=True))[1:])]
        return dict(zip(("place", "value", "node", "x", "y"), cols, strict=True))

    return map_batches(nodes.select("node", "fps"), batch, "place int, value long, node long, x long, y long", 4000)


def forest(node: np.ndarray, x: np.ndarray, segment: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among `node` (sorted by segment and node) within each segment, of rows of `x` that
    differ in at most `near` bits."""
    a, b = [], []
    edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
    size = np.diff(edge)
    small = np.repeat(size <= 64, size)
    for lag in range(1, min(64, int(size.max(initial=0)))):
        i = np.flatnonzero((segment[lag:] == segment[:-lag]) & small[lag:])
        i = i[np.bitwise_count(x[i] ^ x[i + lag]).sum(1, dtype=np.int64) <= near]
        a.append(node[i])
        b.append(node[i + lag])
    for k in np.flatnonzero(size > 64).tolist():
        own, first = np.unique(node[edge[k] : edge[k + 1]], return_index=True)
        bits, rest = x[edge[k] : edge[k + 1]][first], np.arange(len(own))
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                q = queue.pop()
                close = np.bitwise_count(bits[rest] ^ bits[q]).sum(1, dtype=np.int64) <= near
                if close.any():
                    found, rest = rest[close], rest[~close]
                    a.append(np.full(len(found), own[q]))
                    b.append(own[found])
                    queue += list(found)
    if not a:
        return (np.zeros(0, np.int64),) * 2
    one, two = np.concatenate(a), np.concatenate(b)
    names, where = np.unique(np.concatenate([one, two]), return_inverse=True)
    i, j = where[: len(one)], where[len(one) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[own], names[label[own]]


def links(nodes: DataFrame, differ: int = DIFFER, near: int | None = None, words: int = 1, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """a, b: links among the distinct rows of `nodes` (node, fps: `words` fingerprints) that connect whatever meets -
    some fingerprint differs in at most `differ` bits, or falls in a part within its thresholds - and differs in at most
    `near` bits of the first two fingerprints (`differ` bits of the only one)."""
    near, total = differ if near is None else near, nodes.count()
    bits = bit_parts(nodes, words, parts or parts_for(total))
    rows = written(entries(nodes, bits, nearby(nodes, bits, differ), total, differ), "simhash-entries")
    crowded = rows.groupBy("place", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = written(crowded.select("place", "value", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-crowded")
    placed = rows.join(crowded.select("place", "value", "blocks"), ["place", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = F.xxhash64("place", "value", F.least("own", "other"), F.greatest("own", "other"))
    placed = placed.select(keys.alias("segment"), "node", "x", "y")
    # Rows as they are once placed: a crowded value's rows meet each of its blocks.
    copies = crowded.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0] or 0
    tasks = max(8, (rows.count() + copies) // ROWS)

    def batch(g: pd.DataFrame) -> pd.DataFrame:
        node, segment = g["node"].to_numpy(), g["segment"].to_numpy()
        x = np.stack([g["x"].to_numpy(), g["y"].to_numpy()], axis=1).view(np.uint64)
        order = np.lexsort((node, segment))
        a, b = forest(node[order], x[order], segment[order], near)
        return pd.DataFrame({"a": a, "b": b})

    return placed.groupBy(F.pmod("segment", F.lit(tasks)).alias("task")).applyInPandas(batch, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of `edges` (a, b) reaches. Labels spread over links and jump to
    their own label's label, so rounds grow with the logarithm of the longest chain; each round is a written table."""
    # A node linked to several is linked to the smallest of them, and they to that one: of a large group, whose nodes meet
    # in many parts, few links are left.
    least = edges.withColumn("low", F.min("b").over(Window.partitionBy("a")))
    fewer = least.select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x"))
    edges = fewer.select("x.a", "x.b").where("a <> b").distinct()
    both = written(edges.union(edges.select("b", "a")), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("told"))
        low = labels.join(told, labels["node"] == told["a"]).select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        jumped = low.join(ahead, low["label"] == ahead["at"]).select("node", "was", F.least("label", "far").alias("label"))
        step = written(jumped, "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, differ: int = DIFFER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, fp, component_id (the smallest key reachable over links, its own included).

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with equal keys give a row each.
    """
    rows = written(fingerprints(docs, shingle, text, key), "fingerprints")
    nodes = written(rows.groupBy(F.col("fp").alias("node")).agg(F.min(key).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    found = grouped(nodes, components(links(nodes.select("node", F.array("node").alias("fps")), differ)))
    return join_rows(rows.withColumnRenamed("fp", "node"), found, "node").select(key, F.col("node").alias("fp"), "component_id")


def grouped(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """node, n, component_id: the smallest `first` of the nodes (node, first, n) with the same label."""
    label = label.withColumnRenamed("node", "in_group")
    named = nodes.join(label, nodes["node"] == label["in_group"], "left").select("node", "first", "n", F.coalesce("label", "node").alias("label"))
    named = written(named, "node-labels")
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return written(named.join(lowest, "label").select("node", "n", "component_id"), "node-groups")


def similar(docs: DataFrame, shingle: int = 5, text: str = "text", words: int | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, component_id (the smallest doc_id reachable over pairs of shingle Jaccard similarity
    >= 4/5, its own included). All pairs that meet are verified by their sets; a pair of similarity 4/5 meets with chance
    0.95 or more, a closer one more surely. Texts without words are equal to one another; texts whose fingerprints all
    agree are one. Null and empty texts have no words; rows without a doc_id take part but name no component.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = words or words_for(parts_for(docs.count()))
    texts = text_bytes(docs, "doc_id", text=text).withColumn("th", F.xxhash64("_text"))

    def batch(b):
        from xxhash import xxh64_intdigest

        fps = [fingerprint(t.as_py(), shingle, words) for t in b.column("_text")]
        node = np.array([xxh64_intdigest(f.tobytes(), 42) for f in fps], np.uint64).view(np.int64)
        return {"doc_id": b.column("doc_id"), "th": b.column("th"), "node": node, "fps": [f.view(np.int64) for f in fps]}

    with batch_rows(spark, 2000):
        rows = written(map_batches(texts, batch, f"doc_id {kind}, th long, node long, fps array<long>"), "text-fingerprints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("one")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("fps").alias("fps"), one), "distinct-texts")
    maybe = components(links(nodes.select("node", "fps"), near=NEAR, words=words))
    asked = written(nodes.join(maybe, "node").select("node", "label", F.col("one.doc_id").alias("at"), F.col("one.th").alias("at_th")), "texts-that-met")
    near = texts.join(asked, (texts["th"] == asked["at_th"]) & texts["doc_id"].eqNullSafe(asked["at"])).select("node", "label", "_text")

    def sets(b):
        own = [shingles(t.as_py(), shingle) for t in b.column("_text")]
        return {"node": b.column("node"), "label": b.column("label"), "n": [len(s) for s in own], "tokens": [s.tobytes() for s in own]}

    found = written(map_batches(near.dropDuplicates(["node"]), sets, "node long, label long, n long, tokens binary", 256), "shingle-sets")
    label = components(linked(blocked(found)))
    out = grouped(nodes.select("node", "first", "n"), label)
    return join_rows(rows.select("doc_id", "node"), out, "node").select("doc_id", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
