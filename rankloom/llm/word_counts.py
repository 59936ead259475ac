"""Joining all words of all documents to a table of words, without a row for each word of each document.

Words are dealt with by how often they occur. The commonest go to the executors as a dictionary of at
most `COMMON` entries, and are summed where the texts are read. The rest are rare by definition, so no word of
them is hot: each document lists its rare words, these lists are spread out, joined to the table by a shuffle,
and summed back. Every word is counted in one of the two ways; the split changes the cost alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import map_batches, written

#: Words sent to the executors at most; one entry costs about 100 bytes in a worker.
COMMON = 300_000


def corpus_words(texts: DataFrame, words: Callable[[bytes], list], where: str | None = None) -> DataFrame:
    """word (binary), n (occurrences in the rows of `texts` (`_text`) where the boolean column `where` holds, or in
    all), n_all. Counts leave the Python workers by Arrow batch, and meet before the shuffle."""

    def batch(b):
        inside = b.column(where).to_pylist() if where else [True] * b.num_rows
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for i, t in zip(inside, b.column("_text"), strict=True):
            counts[bool(i)].update(words(t.as_py()))
        own, other = counts[True], counts[False]
        return {"word": [*own, *other], "n": [*own.values(), *[0] * len(other)], "n_all": [*own.values(), *other.values()]}

    counted = map_batches(texts, batch, "word binary, n long, n_all long", 4000)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def common_cut(counted: DataFrame, common: int) -> int:
    """The count (`n_all`) beyond which rows of `counted` are common: at most `common` rows are; ties at it are rare."""
    if counted.count() <= common:
        return 0
    left = common
    for r in counted.groupBy("n_all").count().orderBy(F.desc("n_all")).toLocalIterator():
        left -= r["count"]
        if left < 0:
            return r["n_all"]
    return 0


def summed_over_words(texts: DataFrame, words: Callable[[bytes], list], found: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], common: int = COMMON) -> DataFrame:
    """Per row of `texts`: `keys`, n_words, and for each name in `values` the sum over the row's words of its value.
    `found` is a written table of all words: word, n_all, and the columns in `values`, which maps a name to (type,
    value of a word, as an expression over `found`)."""
    spark = texts.sparkSession
    names = list(values)
    valued = found.select("word", "n_all", *[v.cast(t).alias(k) for k, (t, v) in values.items()])
    cut = common_cut(valued, common)
    rows = valued.where(F.col("n_all") > cut).toArrow()
    place = {w: i for i, w in enumerate(rows.column("word").to_pylist())}
    # The last entry, 0, is what words that aren't common find.
    shared = spark.sparkContext.broadcast((place, [np.append(rows.column(k).to_numpy(), 0) for k in names]))
    kinds = texts.select(*keys).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", n_words long, " + "".join(f"s_{k} {values[k][0]}, " for k in names) + "rare array<binary>, times array<int>"

    def batch(b):
        place, value = shared.value
        get = place.get
        out: dict[str, list] = {"n_words": [], "rare": [], "times": []} | {f"s_{k}": [] for k in names}
        for t in b.column("_text"):
            own = words(t.as_py())
            at = np.array([get(w, -1) for w in own], np.int64)
            rare = Counter([own[i] for i in np.flatnonzero(at < 0).tolist()])
            out["n_words"].append(len(own))
            out["rare"].append(list(rare))
            out["times"].append(list(rare.values()))
            for k, v in zip(names, value, strict=True):
                out[f"s_{k}"].append(v[at].sum())
        return out | {k: b.column(k) for k in keys}

    rows = written(map_batches(texts, batch, schema, 2000).withColumn("_nth", F.monotonically_increasing_id()), "common-sums")
    spread = rows.select("_nth", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_nth", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = spread.join(valued.where(F.col("n_all") <= cut), "word").groupBy("_nth").agg(*[F.sum(F.col("times") * F.col(k)).alias(f"r_{k}") for k in names])
    return rows.join(rare, "_nth", "left").select(*keys, "n_words", *[(F.col(f"s_{k}") + F.coalesce(F.col(f"r_{k}"), F.lit(0))).alias(k) for k in names])
