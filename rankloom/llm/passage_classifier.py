"""Document quality by attention over passages (multiple-instance learning), learned from document labels.

A text is cut into passages of `PASSAGE` words. Every passage is encoded by what its bytes and words look like:
rates of classes of bytes and of their pairs, word lengths, and how much it repeats itself and the text before
it. A small network turns each passage into a vector; gated attention, `softmax(w . (tanh(V h) * sigmoid(U h)))`,
weighs the passages of a document, and the weighted sum is scored. Documents alone have labels; the weights say
which passages made the score.

The model is fitted with numpy on at most `SAMPLE` labelled documents, those with the smallest hashes of their id,
and is a few thousand numbers, so it goes to every executor. Encoding and scoring run where texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import held_out, map_batches, table, text_bytes, written

#: Words in a passage; labelled documents, and passages among them, that the model is fitted on at most.
PASSAGE, SAMPLE, SAMPLE_PASSAGES = 96, 5_000, 80_000
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 24, 12, 30, 0.01, 1e-4, 7

#: A class for each byte: white space, line end, lower, upper, digit, . , sentence marks, brackets and quotes, the symbols by kind, UTF-8 lead and following bytes.
_GROUPS = [b" \t\x0b\x0c\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",", b"!?", b";:", b"'\"()[]{}", b"|", b"#*", b"$%&", b"<>", b"-_/\\+=~^`@"]
CLASS = np.full(256, len(_GROUPS), np.int64)
CLASS[128:192] = len(_GROUPS) + 1
CLASS[192:] = len(_GROUPS) + 2
for _i, _g in enumerate(_GROUPS):
    CLASS[list(_g)] = _i
CLASSES = len(_GROUPS) + 3
FEATURES = CLASSES + CLASSES * CLASSES + 7
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def earlier(codes: np.ndarray) -> np.ndarray:
    """Whether each code occurred before."""
    order = np.argsort(codes, kind="stable")
    out = np.zeros(len(codes), bool)
    out[order[1:]] = codes[order[1:]] == codes[order[:-1]]
    return out


def passages(text: bytes, passage: int = PASSAGE) -> np.ndarray:
    """A row of features for each passage of a text; a text without words is one passage of its bytes."""
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    count = max(1, -(-n // passage))
    if not len(b):
        return np.zeros((1, FEATURES), np.float32)
    of_byte = np.zeros(len(b), np.int64)
    of_byte[start[passage::passage]] = 1
    of_byte = np.cumsum(of_byte)
    c = CLASS[b]
    size = np.bincount(of_byte, minlength=count).astype(np.float64)
    one = np.bincount(of_byte * CLASSES + c, minlength=count * CLASSES).reshape(count, CLASSES)
    two = np.bincount((of_byte[1:] * CLASSES + c[:-1]) * CLASSES + c[1:], minlength=count * CLASSES**2).reshape(count, -1)
    out = np.zeros((count, FEATURES))
    out[:, :CLASSES] = one / size[:, None]
    out[:, CLASSES : CLASSES + CLASSES**2] = two / size[:, None]
    if n:
        of_word = np.arange(n) // passage
        words = np.bincount(of_word, minlength=count).astype(np.float64)
        length = (end - start).astype(np.float64)
        # A word's number: a polynomial of its bytes, from running sums.
        power = np.cumprod(np.full(len(b), 0x9E3779B97F4A7C15, np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)))
        inverse = np.cumprod(np.full(len(b), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        word = (total[end] - total[start]) * inverse[start]
        mean = np.bincount(of_word, length, count) / words
        rest = out[:, CLASSES + CLASSES**2 :]
        rest[:, 0] = mean / 10
        rest[:, 1] = np.sqrt(np.maximum(np.bincount(of_word, length**2, count) / words - mean**2, 0)) / 10
        same = np.zeros(n, bool)
        same[1:] = word[1:] == word[:-1]
        rest[:, 2] = np.bincount(of_word, same, count) / words
        rest[:, 3] = np.bincount(of_word, earlier(word * np.uint64(31) + of_word.astype(np.uint64)), count) / words
        if n > 3:
            run = word[:-3] + word[1:-2] * np.uint64(3) + word[2:-1] * np.uint64(9) + word[3:] * np.uint64(27)
            rest[:, 4] = np.bincount(of_word[: n - 3], earlier(run), count) / words
        rest[:, 5] = np.log1p(n) / 10
        rest[:, 6] = (b == 10).sum() / n
    return out.astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return forward(self.p, np.clip((x - self.mean) / self.scale, -8, 8), of, n)["score"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Passages `x`, each of document `of` among n; every document has one at least."""
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    most = np.full(n, -np.inf)
    np.maximum.at(most, of, e)
    a = np.exp(e - most[of])
    a /= np.bincount(of, a, n)[of]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, of, a[:, None] * h)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, x, of, len(y))
    ds = (f["score"] - y) / len(y)
    dz = np.outer(ds, p["c"])[of]
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - np.bincount(of, f["a"] * da, len(y))[of])
    g = np.outer(de, p["w"])
    dv, du = g * f["u"] * (1 - f["v"] ** 2), g * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ ds, "d": np.array(ds.sum())}


def fit(bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Adam over mini-batches of documents; the same bags in the same order give the same model."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p = {"W": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.1, HIDDEN), "d": np.array(0.0)}
    if len(y) and 0 < y.mean() < 1:
        bags = [np.clip((x - mean) / scale, -8, 8) for x in bags]
        m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(y))
            for at in range(0, len(order), 64):
                own = order[at : at + 64]
                x = np.concatenate([bags[i] for i in own])
                of = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
                t += 1
                for k, g in gradients(p, x, of, y[own]).items():
                    g = g + DECAY * p[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    elif len(y):
        p["c"], p["d"] = np.zeros(HIDDEN), np.array(4.0 if y.mean() == 1 else -4.0)
    return Model(mean, scale, p)


def train(docs: DataFrame, labels: DataFrame, fold: int = 0, sample: int = SAMPLE, text: str = "text") -> Model:
    """Fits on documents whose crc32(doc_id) mod 5 is not `fold`. Rows without a 0/1 label or an id are left out; the
    sample is the `sample` smallest hashes of (doc_id, label, text's hash), cut where it reaches SAMPLE_PASSAGES."""
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), fold)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    chosen = own.withColumn("h", F.xxhash64("_id")).orderBy("h", "_id", "y").limit(sample)
    # Some thousand rows at most, by `limit`: the one side that goes to every task.
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select("_id", "y", "h", text)

    def batch(b):
        got = [passages(t.as_py()) for t in b.column("_text")]
        return {"_id": b.column("_id"), "y": b.column("y"), "h": b.column("h"), "n": [len(x) for x in got], "x": [x.astype(np.float32).tobytes() if len(x) <= 2000 else b"" for x in got]}

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    got = written(map_batches(text_bytes(rows, "_id", "y", "h", text=text), batch, f"_id {kind}, y int, h long, n int, x binary"), "classifier-sample")
    bags, ys, n = [], [], 0
    for r in got.where("n <= 2000").orderBy("h", "_id", "y", "x").toLocalIterator():
        n += r["n"]
        if n > SAMPLE_PASSAGES or len(ys) >= sample:
            break
        bags.append(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, FEATURES))
        ys.append(r["y"])
    return fit(bags, np.array(ys, float))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: key, score (0 to 1), predicted (1 if score >= threshold). Null and empty texts are one
    passage of nothing. Rows with equal keys give a row each; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(key).schema[key].dataType.simpleString()

    def batch(b):
        score = []
        for t in b.column("_text"):
            x = passages(t.as_py())
            score.append(float(shared.value.scores(x, np.zeros(len(x), np.int64), 1)[0]))
        return {key: b.column(key), "score": score, "predicted": [int(s >= threshold) for s in score]}

    return map_batches(text_bytes(docs, key, text=text), batch, f"{key} {kind}, score double, predicted int")


def kept(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more. No shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            score = []
            for t in b.column(text):
                x = passages((t.as_py() or "").encode("utf-8", "replace"))
                score.append(shared.value.scores(x, np.zeros(len(x), np.int64), 1)[0] >= threshold)
            yield b.filter(pa.array(score, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", "predicted")
