import hashlib
import random
from collections import defaultdict

from rankloom.llm import contamination as cn


def brute(docs, benchmark, window=cn.WINDOW):
    """The same by comparing every window with every place."""
    held = defaultdict(set)
    for item, t in benchmark:
        w = cn.words_of((t or "").encode())
        for i in range(max(1, len(w) - window + 1)) if w else ():
            held[tuple(w[i : i + window])].add(str(item))
    out = []
    for d, t in docs:
        w = cn.words_of((t or "").encode())
        hit, items = set(), set()
        for n in {len(x) for x in held}:
            for i in range(len(w) - n + 1):
                if own := held.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= own
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    bench = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 7, 10, 11, 25])))) for i in range(40)] + [(40, None), (41, "..."), (2, "w1 W2")]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 2, 9, 10, 40, 300])))) for i in range(60)]
    docs += [(100 + i, "pre, " + (t or "") + "! post") for i, t in bench] + [(7, None), (7, "É w1-W2"), (300, "w3 " * 20000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as items")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert rows(cn.contamination(d, b)) == want
    assert rows(cn.contamination(d, b, block_windows=60)) == want
    assert all(r[2:4] == (0, 0) for r in rows(cn.contamination(d, b.limit(0))))
    assert cn.contamination(d.limit(0), b).count() == 0


def test_rows_of_one_key_over_several_blocks(spark):
    words = [[f"a{k}w{i}" for i in range(10)] for k in range(3)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "item_id long, text string")
    texts = [" ".join([*words[0], "x y z", *words[1]]), " ".join([*words[1], "x y z p q r s t u v w", *words[2]]), "nothing of it", None]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    want = brute([(7, t) for t in texts], [(k, " ".join(w)) for k, w in enumerate(words)])
    for block in (1, 2, 100):
        assert rows(cn.contamination(docs, bench, block_windows=block)) == want
