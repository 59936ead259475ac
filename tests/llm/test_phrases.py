"""Phrases against counts of all runs; the summaries against their guarantee."""

import random
import re
from collections import Counter

import numpy as np

from rankloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + s])) for s in range(1, 5) for i in range(len(w) - s + 1))
    total = Counter()
    for (lang, p), a in f.items():
        total[lang] += a * (len(p) == 1)
    own = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    out = []
    for (lang, p), a in own.items():
        if any(len(q) > len(p) and x == lang and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in own.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, score, a, " ".join(p), left, right, total[lang]))
    ranked = []
    for x in sorted({o[0] for o in out}):
        best = sorted((o for o in out if o[0] == x), key=lambda o: (-o[1], -o[2], o[3].encode()))[:first]
        ranked += [(x, i, o[3], o[2], o[4], o[5], o[6], o[1]) for i, o in enumerate(best, 1)]
    return ranked


def found(spark, rows, least, first):
    d = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n int, phrase string")
    out = phrases.phrases(d, least, first).collect()
    assert all(isinstance(r["rank"], int) for r in out)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out)


def test_equals_counts_of_all_runs(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SENT_RUNS", 3000)
    monkeypatch.setattr(phrases, "SENT_KNOWN", 1500)
    monkeypatch.setattr(phrases, "TEXTS", 16)
    rng = random.Random(5)
    words = ["New", "York", "city", "hall", "of", "é", "the", "x\x1cy", "\xa0"] + [f"w{i}" for i in range(30)]
    def text():
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice([words[min(int(rng.expovariate(0.2)), len(words) - 1)], "new york city hall", "new york", "of the", "a b a b"]))
            out.append(rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]))
        return "".join(out)
    rows = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(400)]
    rows += [("fr", None), ("fr", ""), (None, None), ("long", "one two " * 20_000)] + [("en", "same words again and again")] * 60
    assert found(spark, rows, 12, 2000) == brute(rows, 12, 2000)
    assert found(spark, rows, 12, 5) == brute(rows, 12, 5)


def test_empty_and_nothing_frequent(spark):
    assert found(spark, [], 30, 10) == []
    assert found(spark, [("en", "a b c"), (None, None)], 30, 10) == []


def test_summary_keeps_all_that_is_frequent():
    rng = np.random.default_rng(1)
    keys = np.concatenate((np.repeat(np.arange(50), 40), rng.integers(100, 200_000, 60_000))).astype(np.uint32)
    rng.shuffle(keys)
    least = 30
    whole = phrases.Summary(len(keys) // least + 1)
    for part in np.array_split(keys, 37):
        own = phrases.Summary(whole.room)
        own.merge(*phrases.distinct(np.sort(part)))
        whole.merge(own.keys, own.counts)
        assert len(whole.keys) <= whole.room
    true = Counter(keys.tolist())
    kept = dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))
    assert whole.lost < least and all(k in kept and kept[k] + whole.lost >= n for k, n in true.items() if n >= least)
    assert all(n <= true[k] for k, n in kept.items())


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 2**32 - 1], np.int64)
    assert (phrases.from_planes(phrases.planes(x)) == x).all() and len(phrases.from_planes(phrases.planes(x[:0]))) == 0


def test_products_beyond_64_bits(spark):
    a = 9_000_000_000_000
    got = spark.range(1).selectExpr(f"cast({a}L as decimal(19,0)) * {phrases.SCALE} div (cast({a}L as decimal(20,0)) + {a}L) as s").first()
    assert got.s == phrases.SCALE * a // (2 * a)
