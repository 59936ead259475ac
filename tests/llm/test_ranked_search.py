"""Ranked search against scores worked out document by document."""

import math
import random
import re
from collections import Counter

from rankloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in TERM.findall(text or "")]


def brute(docs, items, k):
    held = [(d, Counter(t), len(t)) for d, x in docs if (t := terms(x))]
    n_all, length, df = len(held), sum(n for *_, n in held), Counter(w for _, c, _ in held for w in c)
    asked = {}
    for item, x in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(x))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c, n in held:
            m = 50 + 50 * n * n_all // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in own if c[w])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, k, **options):
    rows = ranked_search.search(docs, items, k, **options).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def test_equals_brute_force_over_many_slices_and_bundles(spark):
    rng = random.Random(3)
    words = ["The", "the", "a", "Éa", "x1", "zz", "of-it", "rare", "öl"] + [f"w{i}" for i in range(40)]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(n))
    docs = [(i, pick(rng.randint(0, 30))) for i in range(300)]
    docs += [(1000 + i, "a the copy rare w3 w5") for i in range(90)] + [(2000, None), (2001, ""), (2002, "--- !"), (7, "rare rare w3"), (7, "rare rare w3"), (None, "rare w3"), (3000, "w7 " * 50_000)]
    items = [(f"q{i}", pick(rng.randint(1, 12))) for i in range(25)] + [("q1", "rare w3"), ("q1", "rare w3"), (None, "rare"), ("none", None), ("empty", ""), ("off", "nowhere")]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, doc_id int")
    for options in ({"slice_docs": 64, "bundle_items": 5}, {"slice_docs": 40, "bundle_items": 100, "owners": 3}, {}):
        assert found(d, q, 10, **options) == brute(docs, items, 10), options


def test_all_rows_where_fewer_than_k_and_other_keys(spark):
    docs, items = [("b", "x y"), ("a", "x y"), ("c", "z")], [(1, "X"), (2, "z q")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert found(d, q, 50) == brute(docs, items, 50)
    assert [r[2] for r in found(d, q, 50) if r[0] == 1] == ["a", "b"]


def test_empty_tables(spark):
    none_d, none_q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(none_d, q, 5) == [] and found(d, none_q, 5) == [] and found(none_d, none_q, 5) == []
