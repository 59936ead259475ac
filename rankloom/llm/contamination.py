"""Benchmark decontamination as a prefix-filtered set join with exact windows.

A benchmark item of n words gives its windows of `window` consecutive words (one window of n words if it is
shorter). Each window is a set of shingles; shingles are ordered by rarity, counted over all documents. A
document that holds a window whole holds each of its shingles, so for containment 1 the prefix that must be
joined is a single shingle, the rarest. Documents meet the windows on that shingle; its place in the window and
in the document bounds where the window must begin and end (positional and length bounds); the words there are
then compared one by one.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. The benchmark is sent to the executors in
blocks of about `BLOCK_WINDOWS` windows, one at a time: every document is held against every block, so a benchmark
of any size is joined exactly, in two scans of the documents for each block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import LOWER_BYTES, map_batches, table, text_bytes, written

WINDOW, SHINGLE = 10, 5
BLOCK_WINDOWS = 200_000
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,n:long>>"
_OTHER = bytes(i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122))
#: For bytes.translate: A-Z lower-cased, every byte that is in no word a blank.
WORD_BYTES = bytes(32 if i in _OTHER else LOWER_BYTES[i] for i in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(ids: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of `size` word numbers, or of those that begin at `at`; equal runs have equal hashes, and
    equal hashes are compared again."""
    at = np.arange(max(0, len(ids) - size + 1)) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * _STEP + mixed(ids[at + j].astype(np.uint64) + np.uint64(1))
    return mixed(out)


class Windows:
    """One block of the benchmark: word numbers, windows, and which items hold each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int, shingle: int):
        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set] = defaultdict(set)
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                held[tuple(ids[i : i + window])].add(item)
        self.items = [sorted(x, key=str) for x in held.values()]
        self.length = np.array([len(w) for w in held], np.int64)
        self.ids = np.full((len(held), window), -2, np.int64)
        for i, w in enumerate(held):
            self.ids[i, : len(w)] = w
        self.shingle = shingle
        self.by_size: dict[int, np.ndarray] = {}  # windows by the size of their shingles
        sizes = np.minimum(self.length, shingle)
        for size in np.unique(sizes).tolist():
            self.by_size[size] = np.flatnonzero(sizes == size)
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def all_shingles(self) -> dict[int, np.ndarray]:
        """The distinct shingles of all windows by size, sorted."""
        out = {}
        for size, rows in self.by_size.items():
            found = [shingle_hashes(self.ids[w, : self.length[w]], size) for w in rows.tolist()]
            out[size] = np.unique(np.concatenate(found))
        return out

    def choose(self, seen: dict[tuple[int, int], int]) -> None:
        """For each window its rarest shingle by `seen` (ties: the smaller hash) and the shingle's place in it."""
        for size, rows in self.by_size.items():
            key, place = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
            for k, w in enumerate(rows.tolist()):
                h = shingle_hashes(self.ids[w, : self.length[w]], size)
                place[k] = min(range(len(h)), key=lambda i: (seen.get((size, int(h[i].astype(np.int64))), 0), int(h[i])))
                key[k] = h[place[k]]
            order = np.argsort(key, kind="stable")
            keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
            self.prefix[size] = (keys, first, count, rows[order], place[order])

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur in a document's word numbers: (first word, window)."""
        at, which = [], []
        for size, (keys, first, count, rows, place) in self.prefix.items():
            runs = known_runs(ids, size)
            if not len(runs):
                continue
            h = shingle_hashes(ids, size, runs)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[k] == h
            hit, k = runs[same], k[same]
            if not len(hit):
                continue
            n = count[k]
            each = np.repeat(np.arange(len(hit)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            entry = first[k][each] + nth
            begin, w = hit[each] - place[entry], rows[entry]
            inside = (begin >= 0) & (begin + self.length[w] <= len(ids))
            begin, w = begin[inside], w[inside]
            same = np.ones(len(w), bool)
            for j in range(self.ids.shape[1]):
                used = j < self.length[w]
                same &= ~used | (ids[np.minimum(begin + j, len(ids) - 1)] == self.ids[w, j])
            at.append(begin[same])
            which.append(w[same])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64),) * 2


def numbers(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    get = number.get
    return np.array([get(w, -1) for w in words], np.int64)


def known_runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Where runs of `size` words begin that are all words of the benchmark; no other run can match."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    return np.flatnonzero(known[size:] - known[:-size] == size)


def shingle_counts(texts: DataFrame, block: Windows) -> dict[tuple[int, int], int]:
    """Over all documents, how often each of a block's shingles occurs; at most one row for each of them comes back."""
    shared = texts.sparkSession.sparkContext.broadcast((block.number, block.all_shingles()))

    def batch(b):
        number, by_size = shared.value
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in by_size.items()}
        for t in b.column("_text"):
            ids = numbers(words_of(t.as_py()), number)
            for size, keys in by_size.items():
                if len(runs := known_runs(ids, size)):
                    h = shingle_hashes(ids, size, runs)
                    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    counts[size] += np.bincount(k[keys[k] == h], minlength=len(keys))
        seen = [(size, int(keys[k].astype(np.int64)), int(counts[size][k])) for size, keys in by_size.items() for k in np.flatnonzero(counts[size]).tolist()]
        return {name: [x[i] for x in seen] for i, name in enumerate(("size", "h", "n"))}

    got = map_batches(texts, batch, "size int, h long, n long").groupBy("size", "h").agg(F.sum("n").alias("n"))
    out = {(r["size"], r["h"]): r["n"] for r in got.collect()}
    shared.unpersist()
    return out


def in_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_windows: int) -> tuple[DataFrame, int]:
    """The items (item, t, block) and the number of blocks, such that a block has about `block_windows` windows: items are
    dealt by a hash, so Spark holds the benchmark and the driver sees one block of it at a time."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).cast("binary").alias("t"))

    def batch(b):
        return {"n": [max(1, n - window + 1) if (n := len(words_of(t.as_py()))) else 0 for t in b.column("t")]}

    windows = map_batches(rows.select("t"), batch, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = -(-windows // block_windows)
    return rows.withColumn("block", F.pmod(F.xxhash64(F.col("item").cast("string"), "t"), F.lit(max(1, blocks)))), blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Per row of `docs`: key, n_words, n_hit (words inside any occurrence of a window), items (sorted array of the
    item ids, as strings, with an occurring window) and spans (array of first word, number of words).

    Null and empty texts have no words and no hits; null or wordless items count for nothing; an empty benchmark
    hits nothing; equal items are all listed. Rows with equal keys give a row each, however many blocks there are.
    """
    items, blocks = in_blocks(benchmark, item, "text", window, block_windows)
    texts = text_bytes(docs, key, text=text)
    if blocks <= 1:
        return found_in_block(texts, items, [key], window, shingle)
    # Numbered once and written, so that every block sees the same rows under the same numbers.
    texts = written(texts.withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    parts = [written(found_in_block(texts, items.where(F.col("block") == k), [key, "_row"], window, shingle), "contamination") for k in range(blocks)]
    return merged_blocks(parts, key)


def found_in_block(texts: DataFrame, items: DataFrame, keys: list[str], window: int, shingle: int) -> DataFrame:
    """Per row of `texts` (`keys`, `_text`): `keys` and what `contamination` returns, for these items alone."""
    own = [(r["item"], words) for r in items.select("item", "t").toLocalIterator() if (words := words_of(bytes(r["t"])))]
    block = Windows(own, window, shingle)
    block.choose(shingle_counts(texts, block) if own else {})
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def batch(b):
        block = shared.value
        out: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": []}
        for t in b.column("_text"):
            words = words_of(t.as_py())
            begin, w = block.found(numbers(words, block.number)) if block.prefix else ((), ())
            edge = np.zeros(len(words) + 1, np.int64)
            if len(begin):
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + block.length[w], -1)
            hit = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
            out["n_words"].append(len(words))
            out["n_hit"].append(int(hit.sum()))
            out["items"].append(sorted({str(i) for x in np.unique(w).tolist() for i in block.items[x]}) if len(begin) else [])
            out["spans"].append([{"first": a, "n": z - a} for a, z in turns.tolist()])
        return out | {k: b.column(k) for k in keys}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    return map_batches(texts, batch, f"{kinds}, {FOUND}")


def merged_blocks(parts: list[DataFrame], key: str) -> DataFrame:
    """What the blocks found in each row, put together. Rows that no block hits have nothing to put together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rows = every.groupBy("_row").agg(F.first(key).alias(key), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("_spans"))

    def batch(b):
        out: dict[str, list] = {"n_hit": [], "spans": []}
        for n, spans in zip(b.column("n_words").to_pylist(), b.column("_spans").to_pylist(), strict=True):
            edge = np.zeros(n + 1, np.int64)
            for s in spans:
                edge[s["first"]] += 1
                edge[s["first"] + s["n"]] -= 1
            hit = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
            out["n_hit"].append(int(hit.sum()))
            out["spans"].append([{"first": a, "n": z - a} for a, z in turns.tolist()])
        return out | {k: b.column(k) for k in (key, "n_words", "items")}

    kind = rows.schema[key].dataType.simpleString()
    return map_batches(rows, batch, f"{key} {kind}, {FOUND}")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS_SQL.format("coalesce(text,'')")} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_WORDS_SQL.format("text")} as w from benchmark where text is not null and item_id is not null),
bw as (select distinct item_id, least({WINDOW},len(w)) as n, array_to_string(list_slice(w,i,i+least({WINDOW},len(w))-1),' ') as win
 from (select item_id, w, unnest(range(1,greatest(1,len(w)-{WINDOW - 1})+1)) as i from b where len(w)>0) x),
sizes as (select distinct n from bw),
dw as (select r, i, n, array_to_string(list_slice(w,i,i+n-1),' ') as win from (select d.r, d.w, s.n, unnest(range(1,len(d.w)-s.n+2)) as i from d, sizes s where len(d.w)>=s.n) x),
hits as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n=bw.n and dw.win=bw.win),
covered as (select r, count(distinct k) as n_hit from (select r, unnest(range(i,i+n)) as k from hits) x group by 1),
found as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id from hits) x group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit,0) as n_hit, coalesce(n_items,0) as n_items, sha256(coalesce(items,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated
from d left join covered c on c.r=d.r left join found f on f.r=d.r
"""
