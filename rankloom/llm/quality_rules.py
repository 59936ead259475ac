"""Quality rules with thresholds that follow the data: quantile sketches by language and source, then a join.

Each document gets a few measures. Per language and source, KLL sketches of each measure are built in partial
aggregates and merged; cells of too few documents take the merged sketch of their language, and languages of too
few that of all documents. A measure is refused beyond its cell's fence: the quantile of 90 %, and REACH times as far
again as it lies from the middle. Where a cell's quantile is its middle (a rate that is 0 in nearly all documents), the
distance is what one more occurrence adds to the rate in a middling document of the cell: the median of 1 / words (times the
words of a window), 1 / lines or 1 / characters, out of sketches of the same kind. DataFrame functions only; no cutoff is fixed.

A sketch of up to SKETCH_K values is exact; beyond it ranks are off by some 2 / SKETCH_K, a hundredth of the tail, and as
sketches drop values by chance a rerun may move a fence by that much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table, written

WORD, WINDOW, LEAST_WORDS, LEAST_DOCS, TAIL, REACH, SKETCH_K = r"[^\x20\x09-\x0D]+", 8, 20, 200, 0.9, 3.0, 2000
#: Measures: what they are a share of and how much of it one occurrence takes, and whether small values are refused as well.
MEASURES = {"symbol_rate": ("n_words", 1, False), "repeat_rate": ("n_words", WINDOW, False), "dup_line_rate": ("n_lines", 1, False), "capital_rate": ("word_chars", 1, False), "word_length": ("n_words", 1, True)}
#: The shares that one takes: 1 over words, lines and characters.
STEPS = {c: f"one_of_{c}" for c, *_ in MEASURES.values()}
SKETCHED = [*MEASURES, *STEPS.values()]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def covered_words(windows: Column) -> Column:
    """Words inside the windows that begin at the given sorted places."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(WINDOW))).cast("long").alias("n"))
    return F.aggregate(windows, start, step, lambda a: a["n"])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source, the base measures and the rates made from them. Null texts have no words; a rate
    without words is null. Repeated windows are found by sorting a row's window hashes (64 bits)."""
    d = docs.select("doc_id", "lang", "source", F.coalesce(docs[text], F.lit("")).alias("t"))
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_capitals", F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long"))
    d = d.withColumn("n_lines", F.size("lines").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("t", "words", "lines")
    at = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    d = d.withColumn("windows", F.when(F.size("hashes") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), at)))
    d = d.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    d = d.withColumn("sorted", F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("hashes", "windows")
    d = d.withColumn("places", F.array_sort(F.transform(F.filter("sorted", lambda x, i: F.coalesce(x["h"] == F.when(i > 0, F.get("sorted", i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get("sorted", i + 1)["h"], F.lit(False))), lambda x: x["i"])))
    d = d.withColumn("n_repeat_words", F.coalesce(covered_words(F.col("places")), F.lit(0)))
    rates = {
        "symbol_rate": F.col("n_symbols") / F.nullif("n_words", F.lit(0)), "repeat_rate": F.col("n_repeat_words") / F.nullif("n_words", F.lit(0)),
        "dup_line_rate": F.col("n_dup_lines") / F.nullif("n_lines", F.lit(0)), "capital_rate": F.col("n_capitals") / F.nullif("word_chars", F.lit(0)),
        "word_length": F.col("word_chars") / F.nullif("n_words", F.lit(0)),
    }
    rates |= {name: 1 / F.nullif(c, F.lit(0)) for c, name in STEPS.items()}
    return d.withColumns({k: v.cast("double") for k, v in rates.items()}).select("doc_id", "lang", "source", *BASE, *SKETCHED)


def sketches(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KLL sketches of each measure by (lang, source), by lang, and of all: each is merged from the one before."""
    one = [F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in SKETCHED]
    more = [F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in SKETCHED]
    cells = written(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *one), "quality-sketches")
    langs = cells.groupBy("lang").agg(F.sum("n").alias("n"), *more)
    return cells, langs, langs.agg(F.sum("n").alias("n"), *more)


def fences(rows: DataFrame, least_docs: int = LEAST_DOCS, tail: float = TAIL) -> DataFrame:
    """lang, source, level (which sketch the fences come from: cell, language or all), and low_m, high_m for each measure m."""
    cells, langs, whole = sketches(rows)
    name = lambda df, p, *keep: df.select(*keep, *[F.col(c).alias(f"{p}_{c}") for c in ("n", *SKETCHED)])
    both = name(cells, "c", "lang", "source").join(name(langs, "l", F.col("lang").alias("l_lang")), F.col("lang").eqNullSafe(F.col("l_lang")))
    # The whole's sketches are a single row.
    both = both.withColumn("one", F.lit(1)).join(F.broadcast(name(whole, "w").withColumn("one", F.lit(1))), "one")
    level = F.when(F.col("c_n") >= least_docs, F.lit("cell")).when(F.col("l_n") >= least_docs, F.lit("language")).otherwise(F.lit("all"))
    out = ["lang", "source", level.alias("level")]
    for m, (share_of, times, both_sides) in MEASURES.items():

        def own(q, c=m, level=level):
            at = lambda p: F.when(F.kll_sketch_get_n_double(f"{p}_{c}") > 0, F.kll_sketch_get_quantile_double(f"{p}_{c}", F.lit(q)))
            return F.when(level == "cell", at("c")).when(level == "language", at("l")).otherwise(at("w"))

        step = F.coalesce(times * own(0.5, STEPS[share_of]), F.lit(0.0))
        reach = lambda q, own=own, step=step: F.coalesce(F.nullif(F.abs(own(q) - own(0.5)), F.lit(0.0)), step)
        low = own(1 - tail) - REACH * reach(1 - tail) if both_sides else F.lit(None).cast("double")
        out += [(own(tail) + REACH * reach(tail)).alias(f"high_{m}"), low.alias(f"low_{m}")]
    return both.select(*out)


def quality(docs: DataFrame, least_docs: int = LEAST_DOCS, tail: float = TAIL, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, the base measures, base_failed, kept, refused (the measures beyond their fence), and
    level (which sketch the fences come from).

    Refused at once are texts of under 20 words and those with over 30 % of their words in repeated windows. Null
    languages and sources are cells of their own. Rows with equal doc_id give a row each; other columns are left out.
    """
    rows = written(measured(docs, text), "quality-measures")
    limits = fences(rows, least_docs, tail).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = [F.when((F.col(m) > F.col(f"high_{m}")) | F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False)), F.lit(m)) for m in MEASURES]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("refused", F.array_compact(F.array(*beyond))).withColumn("base_failed", failed)
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("refused") == 0)).alias("kept"), "refused", "level")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")
