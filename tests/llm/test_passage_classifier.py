import numpy as np
import pytest

from rankloom.llm import passage_classifier as pc


def test_gradients():
    rng = np.random.default_rng(0)
    n, x = 4, rng.normal(size=(9, pc.FEATURES))
    of, y = np.array([0, 0, 1, 2, 2, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    p = {"W": rng.normal(0, 0.1, (pc.FEATURES, 5)), "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.array(0.1)}
    loss = lambda: -np.mean(y * np.log(s := pc.forward(p, x, of, n)["score"]) + (1 - y) * np.log(1 - s))
    g = pc.gradients(p, x, of, y)
    for k in p:
        at = tuple(0 for _ in p[k].shape)
        was = p[k][at].copy()
        p[k][at] = was + 1e-5
        up = loss()
        p[k][at] = was - 1e-5
        down = loss()
        p[k][at] = was
        assert (up - down) / 2e-5 == pytest.approx(float(g[k][at]), abs=1e-6)


def test_passages():
    assert pc.passages(b"").shape == pc.passages(b" \n").shape == (1, pc.FEATURES)
    assert len(pc.passages(b"a " * 97)) == 2
    x = pc.passages(b"same same same and on and on")
    assert x[0, pc.CLASSES + pc.CLASSES**2 + 2] == pytest.approx(2 / 7)


def test_rows(spark):
    rows = [(i, ("plain words in a row " * 9 if i % 3 else "LOUD!! $$$ | | ") * (1 + i % 4), 0) for i in range(240)] + [(500, None, 0), (501, "", 0), (5, "word " * 30000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (500, None, 0)], "doc_id long, quality int, toxic int")
    model = pc.train(docs, labels)
    got = pc.scored(docs, model).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id < 240 and r.doc_id != 5)
    assert pc.scored(docs.limit(0), model).count() == 0
    assert pc.scored(docs, pc.train(docs, labels.limit(0))).count() == 243


def test_forward_document_by_document():
    """The gated attention written out for one document at a time."""
    rng = np.random.default_rng(5)
    n, of = 5, np.array([0, 1, 1, 1, 2, 3, 3, 4])
    x = rng.normal(size=(len(of), pc.FEATURES))
    p = {"W": rng.normal(0, 0.2, (pc.FEATURES, 6)), "b": rng.normal(size=6), "V": rng.normal(size=(6, 4)), "U": rng.normal(size=(6, 4)), "w": rng.normal(0, 3, 4), "c": rng.normal(size=6), "d": np.array(-0.3)}
    got = pc.forward(p, x, of, n)
    for doc in range(n):
        hidden = [np.tanh(sum(row[i] * p["W"][i] for i in range(pc.FEATURES)) + p["b"]) for row in x[of == doc]]
        energy = [sum(np.tanh(h @ p["V"][:, j]) / (1 + np.exp(-(h @ p["U"][:, j]))) * p["w"][j] for j in range(4)) for h in hidden]
        weight = np.exp(energy) / np.exp(energy).sum()
        bag = sum(a * h for a, h in zip(weight, hidden, strict=True))
        assert got["a"][of == doc] == pytest.approx(weight) and weight.sum() == pytest.approx(1)
        assert got["score"][doc] == pytest.approx(1 / (1 + np.exp(-(bag @ p["c"] + p["d"]))))


def test_passages_word_by_word():
    """The word measures of each passage, counted by hand."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "bb", "Éa", "x1"], rng.integers(1, 260))).replace("x1 a", "x1\na") for _ in range(20)]
    size = pc.PASSAGE
    for t in texts:
        raw = t.encode()
        got, words = pc.passages(raw), raw.split()
        assert len(got) == -(-len(words) // size)
        for i, row in enumerate(got):
            own = words[i * size : (i + 1) * size]
            length = [len(w) for w in own]
            before = words[i * size - 1] if i else None
            rest = row[pc.CLASSES + pc.CLASSES**2 :]
            assert rest[0] == pytest.approx(np.mean(length) / 10, rel=1e-5) and rest[1] == pytest.approx(np.std(length) / 10, abs=1e-5)
            assert rest[2] == pytest.approx(sum(a == b for a, b in zip(own, [before, *own[:-1]], strict=True)) / len(own), abs=1e-6)
            assert rest[3] == pytest.approx(sum(w in own[:k] for k, w in enumerate(own)) / len(own), abs=1e-6)
            assert row[: pc.CLASSES].sum() == pytest.approx(1, abs=1e-5)
