import random

import numpy as np
import xxhash

from rankloom.llm import simhash as sh


def slow_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", " ".join(words))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_components(fps):
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_fingerprints():
    rng = random.Random(1)
    for t in ["", "  ", "One", "one two", "A b C", "é É Ü", " ".join(rng.choices("abc def ghi jkl É".split(), k=70000))]:
        assert sh.fingerprint(t.encode())[0] == slow_fp(t) and sh.fingerprint(t.encode(), 3, 5)[0] == slow_fp(t)


def test_groups_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)] + [0]
    fps = set(base)
    for b in base[:30]:
        for _ in range(20):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            b = x if rng.random() < 0.5 else b
    fps = sorted(fps)
    want = slow_components(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "node long").selectExpr("node", "array(node) as fps")
    for block, parts in ((8000, None), (100, None), (8000, 3), (8000, 2)):
        label = {r.node: r.label for r in sh.components(sh.links(df, block=block, parts=parts)).collect()}
        got = [label.get(f := int(np.uint64(x).astype(np.int64)), f) for x in fps]
        pairs = {}
        for g, w in zip(got, want):
            assert pairs.setdefault(g, w) == w
        assert len(set(got)) == len(set(want))


def test_rows(spark):
    texts = [None, "", "same text here again", "Same  TEXT here\nagain", "other words entirely in this one", "long " * 5000, "long " * 5001]
    docs = spark.createDataFrame([(10 - i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fp, r.component_id) for r in sh.near_duplicates(docs).collect()}
    assert len(got) == 7 and got[10][0] == 0 and got[10][1] == got[9][1] == 9
    assert got[8][1] == got[7][1] == 7 and got[6][1] == 6 and got[5][1] == got[4][1] == 4
    assert all(got[10 - i][0] == np.uint64(slow_fp(t)).astype(np.int64) for i, t in enumerate(texts))
    assert sh.near_duplicates(docs.limit(0)).count() == 0
