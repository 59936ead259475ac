import random

import corpus_pipeline as cp
from rankloom.llm import shingle_sets as ss
from rankloom.llm import simhash as sh


def grams(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow(texts):
    sets, comp = [grams(t) for t in texts], list(range(len(texts)))
    close = []
    for i in range(len(texts)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * all_:
                close.append(both / all_ if all_ else 1.0)
                if comp[i] != comp[j]:
                    a, b = comp[i], comp[j]
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp, close


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "One  TWO", "very long " * 500]
    for _ in range(30):
        base = rng.choices(words, k=rng.randint(60, 400))
        texts.append(" ".join(base))
        for rate in (0.004, 0.012, 0.02, 0.023, 0.03):
            texts.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
    return texts + ["a shared opening of quite a few common words " + " ".join(rng.choices(words, k=30)) for _ in range(40)]


def test_stage_finds_all_near_copies_from_four_fifths(spark):
    texts = corpus()
    want, close = slow(texts)
    assert sum(0.8 <= x < 0.85 for x in close) > 5 and sum(0.85 <= x < 0.95 for x in close) > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in sh.similar(docs).collect()}
    assert got == dict(enumerate(want))
    assert {r.doc_id for r in cp.near_duplicate_stage(spark, docs, "").collect()} == set(want)
    assert sh.similar(docs.limit(0)).count() == 0


def test_rows_without_a_key_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (3, "A b c d e f g"), (3, "other")], "doc_id long, text string").selectExpr("*", "'' as lang", "'' as source", "cast(0 as long) as n_chars")
    assert sorted(str(r.doc_id) for r in cp.near_duplicate_stage(spark, docs, "").collect()) == ["3", "3", "None"]


def test_blocks_of_sets_lose_no_link(spark):
    texts = corpus()
    want, _ = slow(texts)
    sets = [(i, 0, ss.shingles((t or "").encode(), 5).tobytes()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(sets, "node long, label long, tokens binary")
    for block in (2000, 30):
        label = {r.node: r.label for r in sh.components(ss.linked(ss.blocked(df, block))).collect()}
        assert [label.get(i, i) for i in range(len(texts))] == want
