"""Text scores by context-tree weighting over bytes.

Each byte is eight binary decisions, most significant bit first; the bits before it name one of 255 nodes. Every
node has a context tree over the bytes before: at depth d its context is the last d bytes. A context estimates
the bit by Krichevsky-Trofimov from the zeros and ones it has seen, and context-tree weighting mixes all depths:
P(s) = 1/2 KT(s) + 1/2 * product of P over the contexts one byte longer. With the counts of the training texts
held fixed, the chance of a bit is a mix along the path of contexts, KT at depth d with weight
w_d = 1/2 KT(s) / P(s) of what the shorter ones left.

All of it follows from how often each run of DEPTH + 1 bytes occurs, which Spark counts over the whole corpus.
Trees are then built and read in groups that hold whole subtrees (the last two bytes decide the group); the two
depths above are a few grouped sums. The chance of every run goes into a table, and texts add up their runs'. A text is its
bytes and one end, the byte 0xFF, which UTF-8 never holds: chances of whole texts then add up to 1 at most.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import LOWER_BYTES, batch_rows, held_out, map_batches, table, written
from rankloom.llm.word_counts import common_cut, corpus_words, summed_over_words

DEPTH = 5
#: Runs sent to the executors at most, the commonest of all texts: 12 bytes each, some 50 in a worker. All others are
#: joined by a shuffle, so texts are read once and the model stays in Spark, however large it is.
COMMON_RUNS = 1_000_000
#: Rows of a batch of texts.
TEXT_ROWS = 2000
#: Runs that one task should work out.
TASK_RUNS = 60_000
START, END = b"\n" * DEPTH, b"\xff"


def runs(text: bytes) -> np.ndarray:
    """For each byte of a text and its end, the number made of it and the DEPTH bytes before it, the byte itself last."""
    text += END
    padded = START + text + bytes(7 - DEPTH)
    # Eight bytes from each place on as one number; what lies beyond the byte itself is shifted out.
    return (np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (7 - DEPTH))).astype(np.int64)


def run_counts(texts: DataFrame) -> DataFrame:
    """run, n (occurrences in the rows where `_train` holds), n_all (in all rows)."""

    def batch(b):
        parts = []
        for inside in (True, False):
            own = [t for t, i in zip(b.column("_text"), b.column("_train").to_pylist(), strict=True) if i is inside]
            found = [pd.Series(np.concatenate([runs(t.as_py()) for t in own[at : at + 250]])).value_counts(sort=False) for at in range(0, len(own), 250)]
            if found:
                parts.append((pd.concat(found).groupby(level=0, sort=False).sum(), inside))
        return {"run": np.concatenate([p.index.to_numpy() for p, _ in parts]), "n": np.concatenate([p.to_numpy() * int(k) for p, k in parts]), "n_all": np.concatenate([p.to_numpy() for p, _ in parts])}

    return map_batches(texts, batch, "run long, n long, n_all long", 2000).groupBy("run").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def gamma_table() -> np.ndarray:
    return np.array([lgamma(i + 0.5) for i in range(4096)])


_GAMMA = gamma_table()


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for whole numbers n; Stirling's series beyond the table."""
    x = np.maximum(n, 4000).astype(np.float64) + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, _GAMMA[np.minimum(n, 4095)], far)


def log_gamma_one(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1)."""
    x = n.astype(np.float64) + 1
    y = x + 8
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov chance of a sequence with so many zeros and ones."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - log(np.pi) - log_gamma_one(zeros + ones)


def node_of(byte: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the node (1 to 255) of its decision k and the bit there."""
    return (256 | byte) >> (8 - k), (byte >> (7 - k)) & 1


class Level:
    """All (context, node) pairs of one depth: counts, and the log of the weighted chance."""

    def __init__(self, context: np.ndarray, node: np.ndarray, bit: np.ndarray, n: np.ndarray):
        code = context * 256 + node
        self.codes, self.where = np.unique(code, return_inverse=True)
        self.zeros = np.bincount(self.where, n * (1 - bit), len(self.codes)).astype(np.int64)
        self.ones = np.bincount(self.where, n * bit, len(self.codes)).astype(np.int64)
        self.kt = log_kt(self.zeros, self.ones)

    def chance(self, bit: np.ndarray) -> np.ndarray:
        """KT's chance of each row's bit, given the counts."""
        a, b = self.zeros[self.where], self.ones[self.where]
        return (np.where(bit == 1, b, a) + 0.5) / (a + b + 1)


def subtree(run: np.ndarray, n: np.ndarray, top: int, k: int) -> tuple[list[Level], list[np.ndarray]]:
    """The levels from depth `top` to DEPTH over decision k of these runs, and each level's log weighted chance. The
    shorter a context, the fewer of a run's bytes before the last it keeps: the last d of them."""
    node, bit = node_of(run & 255, k)
    before = run >> 8
    levels = [Level(before & ((1 << (8 * d)) - 1), node, bit, n) for d in range(top, DEPTH + 1)]
    weighted = [levels[-1].kt]
    for level, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        parent = np.zeros(len(below.codes), np.int64)
        parent[below.where] = level.where
        children = np.bincount(parent, weighted[0], len(level.codes))
        weighted.insert(0, np.logaddexp(level.kt, children) - log(2))
    return levels, weighted


def path_chances(levels: list[Level], weighted: list[np.ndarray], bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mix of KT chances of each row's bit over these levels, and the weight left to what lies deeper."""
    total, left = np.zeros(len(bit)), np.ones(len(bit))
    for depth, (level, p) in enumerate(zip(levels, weighted, strict=True)):
        # The deepest contexts have no longer ones and take all that is left.
        w = np.exp(np.minimum(0.0, level.kt - log(2) - p))[level.where] if depth < len(levels) - 1 else np.ones(len(bit))
        total += left * w * level.chance(bit)
        left *= 1 - w
    return total, left


def top_levels(second: DataFrame) -> DataFrame:
    """From (context of two bytes, node): zeros, ones, p - the mix of depths 0 and 1 for a 0 and a 1, and what is left."""

    def stage(g: pd.DataFrame) -> pd.DataFrame:
        node, zeros, ones = (g[c].to_numpy() for c in ("node", "zeros", "ones"))
        _, last = np.unique(g["context"].to_numpy() & 255, return_inverse=True)
        a1, b1 = (np.bincount(last, x).astype(np.int64) for x in (zeros, ones))
        kt1 = log_kt(a1, b1)
        p1 = np.logaddexp(kt1, np.bincount(last, g["p"].to_numpy())) - log(2)
        a0, b0 = a1.sum(keepdims=True), b1.sum(keepdims=True)
        kt0 = log_kt(a0, b0)
        p0 = np.logaddexp(kt0, p1.sum()) - log(2)
        share0 = np.exp(np.minimum(0.0, kt0 - log(2) - p0))[0]
        share1 = np.exp(np.minimum(0.0, kt1 - log(2) - p1))[last]
        up1 = share0 * (b0[0] + 0.5) / (a0[0] + b0[0] + 1) + (1 - share0) * share1 * ((b1 + 0.5) / (a1 + b1 + 1))[last]
        left = (1 - share0) * (1 - share1)
        return pd.DataFrame({"context": g["context"], "node": node, "up1": up1, "up0": 1 - left - up1, "left": left})

    # A node's trees are apart from all others': at most 65,536 contexts of two bytes meet in a group.
    return second.groupBy("node").applyInPandas(stage, "context long, node int, up1 double, up0 double, left double")


def run_chances(counts: DataFrame) -> DataFrame:
    """run, n_all, logp (natural log of the chance of the run's last byte after the others)."""
    counts = written(counts, "runs")
    tasks = max(8, counts.count() // TASK_RUNS)
    keyed = counts.withColumn("context", F.shiftright("run", 8).bitwiseAND(F.lit(65535)))
    keyed = keyed.withColumn("task", F.pmod(F.xxhash64("context"), F.lit(tasks)).cast("int"))

    # Nodes of different decisions share no tree, so a group's decisions are worked out one after another.
    def up(g: pd.DataFrame) -> pd.DataFrame:
        run, n, task, parts = g["run"].to_numpy(), g["n"].to_numpy(), int(g["task"].iloc[0]), []
        for k in range(8):
            levels, weighted = subtree(run, n, 2, k)
            top = levels[0]
            parts.append(pd.DataFrame({"task": task, "context": top.codes >> 8, "node": (top.codes & 255).astype(np.int32), "zeros": top.zeros, "ones": top.ones, "p": weighted[0]}))
        return pd.concat(parts)

    second = written(keyed.groupBy("task").applyInPandas(up, "task int, context long, node int, zeros long, ones long, p double"), "context-roots")
    above = top_levels(second).withColumn("task", F.pmod(F.xxhash64("context"), F.lit(tasks)).cast("int"))

    def down(g: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({"run": [], "n_all": [], "logp": []})
        run, n, logp = g["run"].to_numpy(), g["n"].to_numpy(), np.zeros(len(g))
        codes = above["context"].to_numpy() * 256 + above["node"].to_numpy()
        order = np.argsort(codes)
        codes, up1, up0, rest = (x[order] for x in (codes, *(above[c].to_numpy() for c in ("up1", "up0", "left"))))
        for k in range(8):
            levels, weighted = subtree(run, n, 2, k)
            bit = node_of(run & 255, k)[1]
            at = np.searchsorted(codes, levels[0].codes)[levels[0].where]
            logp += np.log(np.where(bit == 1, up1[at], up0[at]) + rest[at] * path_chances(levels, weighted, bit)[0])
        return pd.DataFrame({"run": run, "n_all": g["n_all"], "logp": logp})

    return keyed.groupBy("task").cogroup(above.groupBy("task")).applyInPandas(down, "run long, n_all long, logp double")


def train(texts: DataFrame) -> DataFrame:
    """The written table (run, n_all, logp) for all runs of `texts` (`_text`, `_train`), counted where `_train` holds."""
    return written(run_chances(run_counts(texts)), "run-chances")


def scored(texts: DataFrame, model: DataFrame, keys: list[str], common: int = COMMON_RUNS) -> DataFrame:
    """Per row of `texts`: `keys`, n_bytes, score (log10 of the chance of the text and its end). The commonest runs go to
    the executors; each row lists its other runs, and these lists meet the model by a shuffle on the run."""
    cut = common_cut(model, common)
    valued = model.select("run", "n_all", (F.col("logp") / log(10)).alias("p"))
    own = valued.where(F.col("n_all") > cut).select("run", F.col("p").cast("float")).toArrow()
    shared = texts.sparkSession.sparkContext.broadcast((own.column("run").to_numpy(), np.append(own.column("p").to_numpy(), np.float32(0))))
    del own
    kinds = texts.select(*keys).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", n_bytes long, common double, rare array<long>, times array<int>"

    def batch(b):
        find, value = lookup_for(shared)
        out: dict[str, list] = {"n_bytes": [], "common": [], "rare": [], "times": []}
        for t in b.column("_text"):
            text = t.as_py()
            run = runs(text)
            at = find.get_indexer(run)
            rare, times = np.unique(run[at < 0], return_counts=True)
            for k, v in zip(out, (len(text), float(value[at].sum(dtype=np.float64)), rare, times), strict=True):
                out[k].append(v)
        return {k: b.column(k) for k in keys} | out

    rows = written(map_batches(texts, batch, schema, 2000).withColumn("_nth", F.monotonically_increasing_id()), "common-runs")
    spread = rows.select("_nth", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_nth", F.col("x.rare").alias("run"), F.col("x.times").alias("times"))
    rest = spread.join(valued.where(F.col("n_all") <= cut), "run").groupBy("_nth").agg(F.sum(F.col("times") * F.col("p")).alias("more"))
    return rows.join(rest, "_nth", "left").select(*keys, "n_bytes", (F.col("common") + F.coalesce("more", F.lit(0.0))).alias("score"))


_kept: list = [None, None]


def forget() -> None:
    """Lets go of a worker's index of an earlier model before texts of a new one are read."""
    _kept[:] = None, None


def lookup_for(shared):
    """One index of the common runs for each Python worker. Other runs find the 0 at the end."""
    if _kept[0] is not shared:
        forget()
        run, logp = shared.value
        _kept[:] = shared, (pd.Index(run), logp)
    return _kept[1]


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a lower-cased text, and one end (b"\\n", which is no word)."""
    return [*text.split(), b"\n"]


def lm_scores(docs: DataFrame, train_where, keys: list[str], text: str = "text") -> DataFrame:
    """Per row of `docs`: `keys`, n_tokens, n_known, train_tokens, base_score (unigram), score (context tree), n_bytes
    and bits_per_byte (the end counted as a byte). `train_where` is a boolean column; null and empty texts have one token, the end, and the
    tree's chance of an end at the start. A corpus without training rows knows no token (train_tokens 0) and its tree holds
    every bit for even. Rows are told apart by their keys and their order in the written table, so keys may repeat.
    """
    texts = docs.select(*keys, train_where.alias("_train"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("_text"))
    texts = texts.withColumn("_train", F.coalesce("_train", F.lit(False)))
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        lower = lowered(texts, keys)
        found = written(corpus_words(lower, words_of, "_train"), "training-words")
        total = found.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
        n, v = total["n"] or 0, total["v"] or 0
        scored_rows = scored(lower, train(lower), [*keys, "_row"])
        base = summed_over_words(
            lower, words_of, found, [*keys, "_row"],
            {"base_score": ("double", F.log10((F.col("n") + 0.5) / F.lit(n + 0.5 * (v + 1)))), "n_known": ("long", (F.col("n") > 0).cast("long"))},
        )
    out = base.withColumnRenamed("n_words", "n_tokens").join(scored_rows.select("_row", "n_bytes", "score"), "_row")
    bits = -F.col("score") * F.lit(log(10) / log(2)) / (F.col("n_bytes") + 1)
    return out.select(*keys, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))


def lowered(texts: DataFrame, keys: list[str]) -> DataFrame:
    """A-Z lower-cased, with `_row`, a number of the row. Written, so that all later reads see the same numbers."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema) + ", _train boolean, _text binary"

    def batch(b):
        forget()
        return {k: b.column(k) for k in (*keys, "_train")} | {"_text": [t.as_py().translate(LOWER_BYTES) for t in b.column("_text")]}

    low = map_batches(texts, batch, schema, 2000)
    return written(low.withColumn("_row", F.monotonically_increasing_id()), "lowered-texts")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm_scores(docs, ~held_out(F.col("doc_id"), 1), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
