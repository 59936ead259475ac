"""Incremental line deduplication that can be undone: sharded cuckoo filters over exact reference counts.

State is three tables, all keyed by shard (a slice of the line key's hash):

- postings (shard, k1, k2, doc_id): which document holds which line; the exact record behind everything;
- counts (shard, k1, k2, n_docs, first_doc): references of each line, and the smallest document that holds it;
- filters (shard, size, slots): a cuckoo filter of the lines that two or more documents hold.

Inserting documents adds postings and counts and puts a line into its shard's filter when a second document
takes it up. Deleting documents takes the postings away and takes a line out of the filter when it falls back
to one document, so a later clean-up gives each line back to whoever still holds it. A clean-up asks the
filters first; only lines that a filter knows travel to the exact counts, which decide.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased, as two
64-bit hashes. Null and empty texts are one empty line. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import SPACES, lower_ascii, map_batches, table, written

MIN_CHARS = 10
#: Lines a shard should hold; the number of shards follows the number of lines.
LINES_PER_SHARD = 200_000
#: Filters of up to this many bytes altogether go to every executor. Beyond it all lines meet the exact counts.
BROADCAST_BYTES = 32 << 20
SLOTS = 4

FILTERS = "shard int, size int, slots binary"


@dataclass
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


class CuckooFilter:
    """Four-slot buckets of 16-bit fingerprints; each item has two buckets, found from one another."""

    def __init__(self, size: int, slots: bytes | None = None):
        self.size = size
        self.slots = np.zeros((size, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(size, SLOTS).copy()

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, mask = self.mixed(keys.astype(np.int64).view(np.uint64)), np.uint64(self.size - 1)
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = (h & mask).astype(np.int64)
        return print_, one, one ^ self.offset(print_)

    def offset(self, print_: np.ndarray) -> np.ndarray:
        return (self.mixed(print_.astype(np.uint64)) & np.uint64(self.size - 1)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.int64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(keys)
        want = print_[:, None]
        return (self.slots[one] == want).any(1) | (self.slots[two] == want).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if an item finds no room; the filter is then to be made anew, twice the size."""
        slots, rng = self.slots, 12345
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                if (free := np.flatnonzero(slots[at] == 0)).size:
                    slots[at, free[0]] = p
                    break
            else:
                at = a
                for _ in range(500):
                    rng = (rng * 1103515245 + 12345) & 0x7FFFFFFF
                    k = (rng >> 16) % SLOTS
                    p, slots[at, k] = int(slots[at, k]), p
                    at ^= int(self.offset(np.array([p], np.uint16))[0])
                    if (free := np.flatnonzero(slots[at] == 0)).size:
                        slots[at, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out items that were put in before, one fingerprint for each."""
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                if (hit := np.flatnonzero(self.slots[at] == p)).size:
                    self.slots[at, hit[0]] = 0
                    break


def room_for(n: int) -> int:
    return max(16, 1 << max(0, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85))))))


def changed_filter(old: CuckooFilter | None, gone: np.ndarray, new: np.ndarray, all_now: np.ndarray) -> CuckooFilter:
    if old is not None:
        old.delete(gone)
        if len(all_now) <= 0.9 * SLOTS * old.size and old.insert(new):
            return old
    size = room_for(len(all_now))
    while not (made := CuckooFilter(size)).insert(all_now):
        size *= 2
    return made


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h (the text's hash), pos, k1, k2: the lines of each row that are long enough to be compared."""
    body = F.coalesce(docs[text], F.lit(""))
    lines = docs.select("doc_id", text_hash(docs[text]).alias("h"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "h", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "h", "pos", *key_hashes(F.col("key")))


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("k1", 20), F.lit(shards)).cast("int")


def counted(postings: DataFrame) -> DataFrame:
    """References of each line. Partial counts before the shuffle, so a line of all documents weighs no more than another."""
    return postings.groupBy("shard", "k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def empty_index(spark: SparkSession, shards: int, kind: str = "long") -> LineIndex:
    """`kind` is the type of doc_id: any that has an order."""
    return LineIndex(
        spark.createDataFrame([], f"shard int, k1 long, k2 long, doc_id {kind}"),
        spark.createDataFrame([], f"shard int, k1 long, k2 long, n_docs long, first_doc {kind}, last_doc {kind}"),
        spark.createDataFrame([], FILTERS),
        shards,
    )


def refreshed(index: LineIndex, postings: DataFrame) -> LineIndex:
    """Counts from the postings as they are now, and the filters changed by what differs from the counts before."""
    counts = written(counted(postings), "line-counts")
    now = counts.where("first_doc < last_doc").select("shard", "k1", "k2", F.lit(1).alias("now"))
    was = index.counts.where("first_doc < last_doc").select("shard", "k1", "k2", F.lit(1).alias("was"))
    shared = now.join(was, ["shard", "k1", "k2"], "full")

    def change(lines: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(lines):
            return filters
        old = CuckooFilter(int(filters["size"].iloc[0]), filters["slots"].iloc[0]) if len(filters) else None
        key = lines["k1"].to_numpy(np.int64)
        now, was = lines["now"].notna().to_numpy(), lines["was"].notna().to_numpy()
        made = changed_filter(old, key[was & ~now], key[now & ~was], key[now])
        return pd.DataFrame({"shard": [int(lines["shard"].iloc[0])], "size": [made.size], "slots": [made.slots.tobytes()]})

    filters = shared.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(change, FILTERS)
    return LineIndex(postings, counts, written(filters, "line-filters"), index.shards)


def insert(index: LineIndex, docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with the lines of `docs` added. Documents that it holds already are to be deleted first."""
    new = lines_of(docs, text, min_chars).select(shard_of(index.shards).alias("shard"), "k1", "k2", "doc_id").distinct()
    return refreshed(index, written(index.postings.unionByName(new), "line-postings"))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index as if the documents in `doc_ids` (column doc_id) had never been inserted."""
    return refreshed(index, written(index.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("shard", "k1", "k2", "doc_id"), "line-postings"))


def probed(index: LineIndex, lines: DataFrame) -> DataFrame:
    """The lines (doc_id, k1, k2) that their shard's filter knows; all lines where the filters are too large to send."""
    spark, shards = lines.sparkSession, index.shards
    total = index.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    if total > BROADCAST_BYTES:
        return lines
    shared = spark.sparkContext.broadcast({r["shard"]: (r["size"], bytes(r["slots"])) for r in index.filters.collect()})

    def batch(b: pa.RecordBatch):
        k1 = b.column("k1").to_numpy()
        shard = (k1 >> 20) % shards
        hit = np.zeros(len(k1), bool)
        for s in np.unique(shard).tolist():
            if s in shared.value:
                own = shard == s
                hit[own] = CuckooFilter(*shared.value[s]).contains(k1[own])
        return {n: b.column(n).filter(pa.array(hit)) for n in ("doc_id", "h", "pos", "k1", "k2")}

    return map_batches(lines, batch, f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, h long, pos int, k1 long, k2 long")


def cleaned(index: LineIndex, docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with `text` rewritten, and n_lines and n_dropped added: each line that the index knows from two or
    more documents stays in the smallest doc_id alone. Lines keep their order; a text may become empty.

    Rows meet the places of the lines they lose by doc_id and the text's hash, so rows that share a doc_id don't mix.
    """
    exact = index.counts.where("first_doc < last_doc").select("k1", "k2", "first_doc")
    lost = probed(index, lines_of(docs, text, min_chars)).join(exact, ["k1", "k2"]).where("doc_id > first_doc")
    lost = lost.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_set("pos")).alias("_lost"))
    found = docs.join(lost, (docs["doc_id"] == lost["_id"]) & (text_hash(docs[text]) == lost["_h"]), "left")
    found = found.withColumn("_lines", F.split(F.coalesce(docs[text], F.lit("")), "\n", -1))
    # The stretches between lost lines: one pass over a row, however many it loses.
    cuts = F.concat(F.array(F.lit(-1)), F.col("_lost"), F.array(F.size("_lines")))
    found = found.withColumn("_cuts", cuts)
    stretch = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda i: F.slice("_lines", F.get("_cuts", i) + 2, F.get("_cuts", i + 1) - F.get("_cuts", i) - 1))
    kept = F.when(F.col("_lost").isNull(), F.coalesce(docs[text], F.lit(""))).otherwise(F.array_join(F.flatten(stretch), "\n"))
    new = {text: kept, "n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long")}
    return found.select(*[new[c].alias(c) if c == text else docs[c] for c in docs.columns], *[new[c].alias(c) for c in ("n_lines", "n_dropped")])


def shards_for(docs: DataFrame, text: str = "text") -> int:
    """Enough shards that none holds much more than LINES_PER_SHARD lines."""
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(docs[text], F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return max(8, int(lines) // LINES_PER_SHARD)


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One batch from an empty index: insert all documents, then clean them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = insert(empty_index(docs.sparkSession, shards_for(docs, text), kind), docs, text, min_chars)
    return cleaned(index, docs, text, min_chars)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text,''), chr(10))) as line, unnest(range(len(string_split(coalesce(text,''), chr(10))))) as pos from documents),
keyed as (
  select doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as k from lines),
shared as (select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
marked as (select a.doc_id, a.pos, a.line, s.k is not null and a.doc_id > s.first_doc as lost from keyed a left join shared s on a.k = s.k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(sum(case when lost then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
"""
