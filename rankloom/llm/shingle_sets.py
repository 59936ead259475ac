"""Verification of near-duplicates by their sets of word shingles: Jaccard similarity >= 4/5.

Nodes that may be similar come in groups. A group is compared in blocks of bounded size and bytes, each block of it with
each other, and each pair of blocks gives back a spanning forest, so the links written grow with the nodes and not with
their pairs. Bitmaps of parities, whose differing bits never exceed the sets' difference, spare most set comparisons.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import LOWER_BYTES, written

#: Nodes compared with one another in one block, bytes of sets in a block, and bytes in a task.
BLOCK, BLOCK_BYTES, BYTES = 2_000, 8_000_000, 16_000_000
#: Bits of a bitmap, as a power of two.
WIDTH = 12


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the text's shingles, sorted; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = [x - 1 for x in accumulate([len(w) + 1 for w in words])]
    starts = [0, *[x + 1 for x in ends]]
    return np.unique(np.array([xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that are i modulo 2^WIDTH."""
    at = (tokens & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << WIDTH) & 1).astype(np.uint8)).view(np.uint64)


def forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (places) of a spanning forest over all pairs of similarity >= 4/5."""
    size, bits = np.array([len(s) for s in sets], np.int64), np.stack([bitmap(s) for s in sets])
    a, b, rest = [], [], np.arange(len(sets))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            both = size[rest] + size[q]
            # 9 * difference <= sum of sizes is similarity >= 4/5.
            found = 9 * np.abs(size[rest] - size[q]) <= both
            found[found] = 9 * np.bitwise_count(bits[rest[found]] ^ bits[q]).sum(1, dtype=np.int64) <= both[found]
            for k in np.flatnonzero(found):
                found[k] = 9 * len(np.intersect1d(sets[q], sets[rest[k]], assume_unique=True)) >= 4 * both[k]
            new, rest = rest[found], rest[~found]
            a += [q] * len(new)
            b += list(new)
            queue += list(new)
    return a, b


def blocked(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """segment, node, tokens: the rows of `sets` (node, label, tokens), each block of a group with each other."""
    size = sets.groupBy("label").agg(F.count("*").alias("many"), F.sum(F.octet_length("tokens").cast("long")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("many") / block), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    placed = sets.join(size.select("label", blocks.alias("blocks")), "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("segment"), "node", "tokens")


def linked(placed: DataFrame) -> DataFrame:
    """a, b: links within the segments of `placed` (segment, node, tokens)."""
    placed = written(placed, "set-blocks")
    total = placed.agg(F.sum(F.octet_length("tokens").cast("long") + 200)).first()[0] or 0

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["segment", "node"])
        node, segment = g["node"].to_numpy(), g["segment"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
        a, b = [], []
        for start, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            i, j = forest([np.frombuffer(x, np.uint64) for x in g["tokens"].iloc[start:end]])
            a += [node[start + k] for k in i]
            b += [node[start + k] for k in j]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return placed.groupBy(F.pmod("segment", F.lit(max(8, total // BYTES))).alias("task")).applyInPandas(compare, "a long, b long").distinct()
