"""Nearest rows: exact search against numpy over several blocks, and hash tables against exact search."""

import numpy as np
import pytest

from rankloom.operators import transfer, vectors

SF = "/root/testdata/sf0.01"


def frame(spark, x, groups=None):
    rows = [(i, [float(v) for v in r], int(g)) for i, (r, g) in enumerate(zip(x, groups if groups is not None else [0] * len(x)))]
    return spark.createDataFrame(rows, "id long, vector array<double>, g int")


def brute(x, ids, k, groups=None):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for i in ids:
        s = np.round(u @ u[i], vectors.PLACES)
        own = [j for j in range(len(x)) if j != i and (groups is None or groups[j] == groups[i])]
        for r, j in enumerate(sorted(own, key=lambda j: (-s[j], j))[:k], 1):
            out[i, r] = j
    return out


def found(rows):
    return {(r.query_id, r["rank"]): r.vec_id for r in rows.collect()}


def test_exact_search_over_blocks_and_groups(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[50:90] = x[7]  # ties and copies
    x[3] = 0
    groups = rng.integers(0, 3, 300)
    groups[100:250] = 1
    df = frame(spark, x, groups)
    q, v = df.where("id % 3 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "vec_id")
    ids = range(0, 300, 3)
    for blocks in ({}, {"row_block": 37, "query_block": 20}):
        assert found(vectors.nearest(q, v, 4, **blocks)) == brute(x, ids, 4)
        assert found(vectors.nearest(q, v, 4, ["g"], **blocks)) == brute(x, ids, 4, groups)


def test_rows_without_vectors_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [1.0, 0.1]), (4, [1.0, 0.1]), (5, [0.0, 0.0]), (6, None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    q, v = df.where("id in (0, 1)").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "vec_id")
    assert found(vectors.nearest(q, v, 3)) == {(0, 1): 3, (0, 2): 4, (0, 3): 2, (1, 1): 2, (1, 2): 3, (1, 3): 4}
    assert found(vectors.nearest(q.where("false"), v, 3)) == {} and found(vectors.nearest(q, v.where("false"), 3)) == {}
    assert found(vectors.approximate(q, v, 1, 2))[0, 1] == 3


def test_edges_have_every_nearest_product_of_the_category(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 8))), f"c{i % 2 if i < 40 else 0}") for i in range(150)] + [(900, "alone", "c9"), (901, None, "c0"), (902, "", "c0"), (903, "w1", None)]
    products = spark.createDataFrame(rows, "product_id long, title string, category string")
    sets = {i: set((t or "").split()) for i, t, c in rows if t is not None}
    kind = {i: c for i, _, c in rows}
    want = {}
    for i in sets:
        if kind[i] is None:
            continue
        cos = lambda j: round(len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])) if sets[i] and sets[j] else 0.0, 9)  # noqa: E731, B023
        for j in sorted((j for j in sets if j != i and kind[j] == kind[i]), key=lambda j: (-cos(j), j))[:5]:
            want[i, j] = cos(j)
    got = {(r.product_id, r.neighbor_product_id): r.similarity for r in transfer.edges(products, 5, ["category"]).collect()}
    assert got == want


def test_edges_compare_sets_of_words_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    titles = ["red ring", "ring red red", "Ring RED", "blue ring", "blue bolt", "", "x"]
    rows = [(i, titles[rng.integers(0, len(titles))], f"c{i % 2}") for i in range(200)] + [(900, None, "c0"), (901, "red ring", None)]
    products = spark.createDataFrame(rows, "product_id long, title string, category string")
    sets = {i: set(t.lower().split()) for i, t, c in rows if t is not None and c is not None}
    kind = {i: c for i, _, c in rows}
    cos = lambda i, j: round(len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])) if sets[i] and sets[j] else 0.0, 9)
    want = {(i, j): cos(i, j) for i in sets for j in sorted((j for j in sets if j != i and kind[j] == kind[i]), key=lambda j: (-cos(i, j), j))[:4]}
    compared, plain = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda q, v, *a, **k: compared.append((q.count(), v.count())) or plain(q, v, *a, **k))
    of = lambda df: {(r.product_id, r.neighbor_product_id): r.similarity for r in df.collect()}
    assert of(transfer.edges(products, 4, ["category"])) == want
    # Five sets of words in each of two categories, whatever the number of products.
    assert compared == [(10, 10)]
    some = products.where("product_id % 7 = 0").select("product_id")
    assert of(transfer.edges(products, 4, ["category"], some)) == {k: v for k, v in want.items() if k[0] % 7 == 0}


@pytest.mark.parametrize(("bits", "cosine"), [(4, 0.3), (6, 0.3)])
def test_hash_tables_find_nine_of_ten(spark, bits, cosine):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    q, v = vectors.as_vectors(df.where("vec_id % 50 = 0"), "vec_id", "query_id"), vectors.as_vectors(df, "vec_id", "vec_id")
    got = vectors.recall_at(vectors.approximate(q, v, 5, 64, bits, cosine), vectors.nearest(q, v, 5)).first()
    assert got.n == 50 and got.recall >= 0.9


def test_near_copies_take_few_tables(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((200, 32))
    x = np.concatenate((base, base + 0.05 * rng.standard_normal((200, 32))))
    df = frame(spark, x)
    q, v = df.where("id < 200").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "vec_id")
    assert vectors.tables_for(12, 0.99, 0.97) < 10
    got = found(vectors.approximate(q, v, 1, 32, bits=12, cosine=0.99))
    assert sum(got.get((i, 1)) == i + 200 for i in range(200)) >= 190
