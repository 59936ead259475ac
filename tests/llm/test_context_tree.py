from collections import Counter
from math import exp, lgamma, log, log10, pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import context_tree as ct


class Slow:
    """The same trees by recursion over dictionaries."""

    def __init__(self, texts):
        self.seen, self.children = Counter(), {}
        for t in texts:
            t = ct.START + t + ct.END
            for i in range(ct.DEPTH, len(t)):
                for k in range(8):
                    node, bit = (256 | t[i]) >> (8 - k), t[i] >> (7 - k) & 1
                    for d in range(ct.DEPTH + 1):
                        c = t[i - d : i]
                        self.seen[node, c, bit] += 1
                        if d:
                            self.children.setdefault((node, c[1:]), set()).add(c)
        self.p = {}

    def kt(self, node, c):
        a, b = self.seen[node, c, 0], self.seen[node, c, 1]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)

    def weighted(self, node, c):
        if (node, c) not in self.p:
            kt = self.kt(node, c)
            if len(c) == ct.DEPTH:
                self.p[node, c] = kt
            else:
                below = sum(self.weighted(node, x) for x in self.children.get((node, c), ()))
                self.p[node, c] = float(np.logaddexp(kt, below)) - log(2)
        return self.p[node, c]

    def chance(self, node, bit, before, d=0):
        c = before[len(before) - d :]
        a = [self.seen[node, c, 0], self.seen[node, c, 1]]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == ct.DEPTH:
            return own
        w = exp(self.kt(node, c) - log(2) - self.weighted(node, c))
        return w * own + (1 - w) * self.chance(node, bit, before, d + 1)

    def score(self, t):
        t = ct.START + t + ct.END
        return sum(log10(self.chance((256 | t[i]) >> (8 - k), t[i] >> (7 - k) & 1, t[i - ct.DEPTH : i])) for i in range(ct.DEPTH, len(t)) for k in range(8))


def test_against_recursion(spark):
    texts = ["abracadabra abracadabra", "Banana band", "", None, "quite other \né", "banana bandana", "banana bandana"]
    rows = [(i % 6, t, i not in (4, 5), 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, inside boolean, run int")
    got = ct.lm_scores(docs, F.col("inside"), ["doc_id"]).collect()
    assert len(got) == 7
    low = [(t or "").lower().encode() for t in texts]
    slow = Slow([t for t, r in zip(low, rows) if r[2]])
    words = Counter(w for t, r in zip(low, rows) if r[2] for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    want = {}
    for t, r in zip(low, rows):
        own = [*t.split(), b"\n"]
        want.setdefault(r[0], []).append((len(own), sum(words[w] > 0 for w in own), sum(log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), slow.score(t)))
    for r in got:
        assert r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3]) for w in want[r.doc_id])
    lower = docs.where("doc_id > 0")
    assert ct.lm_scores(lower, F.lit(False), ["doc_id"]).agg(F.sum("train_tokens")).first()[0] == 0
    assert ct.lm_scores(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0


def test_common_and_rare_runs_add_up(spark):
    docs = spark.createDataFrame([(i, "some words " * i + chr(97 + i)) for i in range(9)], "doc_id long, text string")
    texts = ct.lowered(docs.select("doc_id", F.lit(True).alias("_train"), F.col("text").cast("binary").alias("_text")), ["doc_id"])
    model = ct.train(texts)
    one = {r.doc_id: r.score for r in ct.scored(texts, model, ["doc_id"]).collect()}
    many = {r.doc_id: r.score for r in ct.scored(texts, model, ["doc_id"], 20).collect()}
    assert one == pytest.approx(many) and len(one) == 9
