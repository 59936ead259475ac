"""Repeated passages by a sparse suffix array.

Of all suffixes of all texts only those are kept that begin at a minimiser: a word whose next `GRAM` words have the
smallest hash among `SPREAD + 1` places in a row. The choice depends on the content alone, so two copies of a
passage of `CORE + SPREAD` words keep the same suffix, and its next `CORE` words lie inside both.

Kept suffixes that agree in all words that any window of `LEAST` words around their core can reach are one row, a
class, with the smallest and the largest document that has it, so a passage in a third of all documents costs no more
than another. Classes whose core two documents have are sorted over the cluster, once by core and the words after it
and once by core and the words before it (the core by a hash of its words, all others by the words). Each is compared
with its neighbours in both orders, over the edges of partitions too, and the match is extended to the right and to
the left: with `l` common words before the core and `a` after it, the windows that begin SPREAD - a to l words before
the suffix are repeated. The neighbours have the largest `a` and the largest `l` of all classes of the core, so no
other window can be repeated than those from SPREAD - max(a) to max(l). Where the neighbours do not show all of these
to be, the windows of that core's classes are grouped by their words.

No task gets all classes of a core: ranges of sorted classes, windows and classes by hash are what tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rankloom.llm.common import LOWER_BYTES, join_rows, map_batches, table, text_bytes, written

#: Words a repeated passage has at least; places in a row of which one is kept, less one; words that choose it.
LEAST, SPREAD, GRAM = 51, 16, 8
CORE = LEAST - SPREAD
_STEP = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: int = _STEP) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64)) if n else np.zeros(0, np.uint64)


def rolling(x: np.ndarray, size: int | np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the `size` numbers from each place in `start`, from running sums of a polynomial modulo 2^64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers(len(x)))))
    inverse = powers(len(x), pow(_STEP, -1, 1 << 64))
    return mixed((total[start + size] - total[start]) * inverse[start])


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[np.frombuffer(text, np.uint8)], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased."""
    low = text.translate(LOWER_BYTES)
    begin, end = word_edges(low)
    if not len(begin):
        return np.zeros(0, np.uint64)
    return rolling(mixed(np.frombuffer(low, np.uint8).astype(np.uint64) + np.uint64(1)), end - begin, begin)


def minimisers(words: np.ndarray, least: int = LEAST, spread: int = SPREAD, gram: int = GRAM) -> np.ndarray:
    """The places of the kept suffixes: those with all their core words, smallest (leftmost) in some run of places."""
    n = len(words) - (least - spread) + 1
    if n < spread + 1:
        return np.zeros(0, np.int64)
    h = rolling(words, gram, np.arange(n))
    runs = np.lib.stride_tricks.sliding_window_view(h, spread + 1)
    return np.unique(runs.argmin(1) + np.arange(len(runs)))


def kept_suffixes(w: np.ndarray, least: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept places, and for each the hash of all words that its windows reach and of how many lie before it."""
    at = minimisers(w, least, spread)
    if not len(at):
        return at, np.zeros(0, np.int64)
    first, last = np.maximum(at - spread, 0), np.minimum(at + least, len(w))
    around = mixed(rolling(w, last - first, first) + np.uint64(_STEP) * (at - first).astype(np.uint64))
    return at, around.view(np.int64)


def joined(parts: dict[str, list]) -> dict | None:
    return {k: np.concatenate(v) for k, v in parts.items()} if next(iter(parts.values())) else None


def suffixes(docs: DataFrame, least: int, spread: int, text: str) -> DataFrame:
    """core, around, doc_id, nth (the row), at, n_words for each kept suffix."""

    def batch(b):
        out: dict[str, list] = {k: [] for k in ("core", "around", "doc_id", "nth", "at", "n_words")}
        for d, row, t in zip(b.column("doc_id").to_pylist(), b.column("_nth").to_pylist(), b.column("_text"), strict=True):
            w = word_hashes(t.as_py())
            at, around = kept_suffixes(w, least, spread)
            if d is not None and len(at):
                core = rolling(w, least - spread, at).view(np.int64)
                for k, v in zip(out, (core, around, np.full(len(at), d), np.full(len(at), row), at, np.full(len(at), len(w))), strict=True):
                    out[k].append(v)
        return joined(out)

    texts = text_bytes(docs, "doc_id", text=text).withColumn("_nth", F.monotonically_increasing_id())
    return map_batches(texts, batch, "core long, around long, doc_id long, nth long, at int, n_words int")


def short(word: bytes) -> bytes:
    """A word as it is sorted and compared: very long ones by a digest of 128 bits."""
    return word if len(word) <= 32 else blake2b(word, digest_size=16).hexdigest().encode()


def contexts(docs: DataFrame, classes: DataFrame, least: int, spread: int, text: str) -> DataFrame:
    """core, around, low, high, before, after: of each class the up to `spread` words before its core (the nearest
    first) and after it, each followed by a space, read from the text of its first document."""
    asked = classes.groupBy(F.col("low").alias("_speaker")).agg(F.collect_list(F.struct("core", "around", "high")).alias("_asked"))
    texts = docs.join(asked, docs["doc_id"] == asked["_speaker"]).select("doc_id", "_asked", F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("_text"))
    size = least - spread

    def batch(b):
        out: dict[str, list] = {k: [] for k in ("core", "around", "low", "high", "before", "after")}
        for d, asked, t in zip(b.column("doc_id").to_pylist(), b.column("_asked").to_pylist(), b.column("_text"), strict=True):
            raw = t.as_py()
            low = raw.translate(LOWER_BYTES)
            begin, end = word_edges(low)
            at, around = kept_suffixes(word_hashes(raw), least, spread)
            told = lambda places: b"".join(short(low[begin[j] : end[j]]) + b" " for j in places)
            wanted = {x["around"]: x for x in asked}
            for i, a in zip(at.tolist(), around.tolist(), strict=True):
                if x := wanted.pop(a, None):
                    before, after = told(range(i - 1, max(i - spread, 0) - 1, -1)), told(range(i + size, min(i + least, len(begin))))
                    row = (x["core"], a, d, x["high"], before, after)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
        return out

    return map_batches(texts, batch, "core long, around long, low long, high long, before binary, after binary", rows=256)


def common(a: list[bytes], b: list[bytes]) -> int:
    """Leading words that two lists share."""
    if a == b:
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def bits(before: int, after: int, spread: int) -> int:
    """Bit i is set for each window that begins i words before the suffix, from the words shared on both sides."""
    low = max(spread - after, 0)
    return (1 << (before + 1)) - (1 << low) if low <= before else 0


COMPARED = "core long, around long, l int, a int, mask long, low long, high long, edge_low long, edge_high long, before binary, after binary"


def compared(rows: DataFrame, spread: int) -> DataFrame:
    """Rows of `contexts`, sorted in each partition, each beside its neighbours: l and a (the most words shared with
    one of them before and after the core), mask (the windows that it shares with another document), and the smallest
    and largest document of those. The first and the last row of a partition come once more with their words."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(COMPARED))

    def begun(core, around, low, high, before, after):
        left, right = before.split(), after.split()
        mask = bits(len(left), len(right), spread) if low < high else 0
        return {"row": (core, around, low, high, before, after), "left": left, "right": right, "l": 0, "a": 0, "mask": mask, "low": low if mask else None, "high": high if mask else None}

    def meet(x, y):
        l, a = common(x["left"], y["left"]), common(x["right"], y["right"])
        low, high = min(x["row"][2], y["row"][2]), max(x["row"][3], y["row"][3])
        mask = bits(l, a, spread) if low < high else 0
        for z in (x, y):
            z["l"], z["a"] = max(z["l"], l), max(z["a"], a)
            if mask:
                z["mask"] |= mask
                z["low"] = low if z["low"] is None else min(z["low"], low)
                z["high"] = high if z["high"] is None else max(z["high"], high)

    def told(x):
        return (x["row"][0], x["row"][1], x["l"], x["a"], x["mask"], x["low"], x["high"], None, None, None, None)

    def edge(x):
        core, around, low, high, before, after = x["row"]
        return (core, around, 0, 0, 0, None, None, low, high, before, after)

    def columns(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for values in zip(*(b.column(k).to_pylist() for k in ("core", "around", "low", "high", "before", "after"))):
                x = begun(*values)
                if last is None:
                    out.append(edge(x))
                else:
                    if last["row"][0] == x["row"][0]:
                        meet(last, x)
                    out.append(told(last))
                last = x
            if out:
                yield columns(out)
        if last is not None:
            yield columns([told(last), edge(last)])

    return rows.mapInArrow(run, COMPARED)


def neighbours(rows: DataFrame, order: list[str], spread: int) -> DataFrame:
    """`compared` over the whole table in this order. The edges, two rows a partition, are compared with each other."""
    seen = written(compared(rows.repartitionByRange(*order).sortWithinPartitions(*order), spread), "neighbours")
    edges = seen.where("before is not null").select("core", "around", F.col("edge_low").alias("low"), F.col("edge_high").alias("high"), "before", "after")
    over = compared(edges.coalesce(1).sortWithinPartitions(*order), spread)
    return seen.where("before is null").unionByName(over.where("before is null")).select("core", "around", "l", "a", "mask", "low", "high")


def shared_windows(rows: DataFrame, spread: int) -> DataFrame:
    """core, around, mask, low, high of the classes with a repeated window: bit i of `mask` for the one that begins i
    words before the suffix."""
    both = neighbours(rows, ["core", "after", "before"], spread).unionByName(neighbours(rows, ["core", "before", "after"], spread))
    per = both.groupBy("core", "around").agg(F.max("l").alias("l"), F.max("a").alias("a"), F.bit_or("mask").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"))
    able = F.when(F.col("l") + F.col("a") >= spread, F.expr(f"shiftleft(1L, l + 1) - shiftleft(1L, {spread} - a)")).otherwise(F.lit(0).cast("long"))
    per = written(per.withColumn("able", able.bitwiseOR(F.col("mask"))).where("able <> 0"), "extended")
    cores = per.groupBy("core").agg(F.count("*").alias("n"), F.bool_or(F.expr("able <> mask")).alias("open"))
    # A core's windows all come, those that a neighbour has shown as well, so that none lacks its partner. Closed
    # cores are left out after the join, as a hot one of them must be known as hot.
    ways = join_rows(per, written(cores, "cores"), "core").where("open").select("core", "around", "able").join(rows, ["core", "around"])
    backs = F.filter(F.sequence(F.lit(0), F.lit(spread)), lambda i: F.expr("able").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    word = lambda side, n: F.concat_ws(" ", F.slice(F.split(F.decode(side, "ISO-8859-1"), " "), F.lit(1), n))
    windows = ways.select("core", "around", "low", "high", "before", "after", F.explode(backs).alias("back"))
    windows = windows.select("around", "low", "high", F.struct("core", "back", word("before", F.col("back")).alias("b"), word("after", spread - F.col("back")).alias("a")).alias("win"))
    windows = written(windows, "open-windows")
    twice = windows.groupBy("win").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("n")).where("least < most")
    found = join_rows(windows.select("win", "around"), written(twice, "open-repeated"), "win")
    found = found.select(F.col("win.core").alias("core"), "around", F.expr("shiftleft(1L, win.back)").alias("mask"), F.col("least").alias("low"), F.col("most").alias("high"))
    out = per.where("mask <> 0").select("core", "around", "mask", "low", "high").unionByName(found)
    return out.groupBy("core", "around").agg(F.bit_or("mask").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"))


def repeats(docs: DataFrame, least: int = LEAST, spread: int = SPREAD, text: str = "text") -> DataFrame:
    """Per row of `docs` with a passage of at least `least` words that another document holds too: doc_id, n_words,
    n_repeated (words in such passages), other_doc_id (the smallest document met in comparing that holds a part of
    them, or the largest where that is the row's own), and spans (array of first word, number of words, in order).

    Null, empty and short texts have no passages; rows without a doc_id are left out; repeats within one doc_id
    alone don't count; rows that share a doc_id give a row each. Other columns are left out. A doc_id that isn't a whole
    number may be of any type that has an order.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        # Numbers in the order of the ids take their place, and are put back.
        order = docs.select("doc_id").where("doc_id is not null").distinct().orderBy("doc_id")
        ids = written(order.withColumn("_id", F.monotonically_increasing_id()), "ordered-ids")
        found = repeats(docs.select("doc_id", text).join(ids, "doc_id").select(F.col("_id").alias("doc_id"), text), least, spread, text)
        named = lambda c: ids.select(F.col("_id").alias(c), F.col("doc_id").alias(f"_{c}"))
        both = found.join(named("doc_id"), "doc_id").join(named("other_doc_id"), "other_doc_id")
        return both.select(F.col("_doc_id").alias("doc_id"), "n_words", "n_repeated", F.col("_other_doc_id").alias("other_doc_id"), "spans")
    kept = written(suffixes(docs, least, spread, text), "suffixes")
    shared = kept.groupBy("core").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n")).where("a < z").select("core", "n")
    # Only suffixes whose core two documents have go on.
    kept = written(join_rows(kept, written(shared, "shared-cores"), "core"), "shared-suffixes")
    classes = kept.groupBy("core", "around").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    classes = written(classes, "suffix-classes")
    rows = written(contexts(docs, classes, least, spread, text), "contexts")
    found = shared_windows(rows, spread).join(classes.select("core", "around", "n"), ["core", "around"])
    hits = join_rows(kept, written(found, "repeated-classes"), ["core", "around"])
    hits = hits.groupBy("nth", "doc_id", "n_words").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("at", "mask")).alias("hits"))

    def batch(b):
        n, spans = [], []
        for words, found in zip(b.column("n_words").to_pylist(), b.column("hits"), strict=True):
            edge = np.zeros(words + 1, np.int64)
            at, mask = (np.array(found.values.field(k), np.int64) for k in ("at", "mask"))
            which, back = np.nonzero((mask[:, None] >> np.arange(spread + 1)[None, :]) & 1)
            begin = np.unique(at[which] - back)
            edge[begin] += 1
            edge[begin + least] -= 1
            turns = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0])))).reshape(-1, 2)
            n.append(int((turns[:, 1] - turns[:, 0]).sum()))
            spans.append([{"first": a, "n": z - a} for a, z in turns.tolist()])
        low, high, d = (b.column(k).to_numpy() for k in ("low", "high", "doc_id"))
        return {"doc_id": d, "n_words": b.column("n_words"), "n_repeated": n, "other_doc_id": np.where(low != d, low, high), "spans": spans}

    return map_batches(hits, batch, "doc_id long, n_words long, n_repeated long, other_doc_id long, spans array<struct<first:long,n:long>>")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
