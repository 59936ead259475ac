import random

import corpus_pipeline as cp
from rankloom.llm import passage_classifier as pc
from rankloom.llm.token_ids import TextDigests, default_vocabulary
from tests.llm.test_contamination import brute
from tests.llm.test_line_index import li
from tests.llm.test_similar import slow


def slow_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(li.SPACES))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    gone = lambda d, x: len(h := holders.get(key(x), ())) >= 2 and d > min(h)
    return [(d, "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [f"wo{i}rd" for i in range(800)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared, bench = line(12), line(14)
    texts = [f"{line(30)}\n{line(40)}" for _ in range(60)] + [f"{line(20)}\n{shared}\n{line(9)}" for _ in range(8)]
    texts += [f"{line(10)} {bench} {line(5)}", bench, None, "", "x\ny", "X\ny", "LOUD!! $$$ " * 40] + ["SHOUT!! AND $$$ | | " * 30] * 30
    long = line(900).split(" ")
    texts += [" ".join(long), " ".join([*long[:400], "changed", *long[401:]]), "very long " * 20000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, bench), (1, None), (2, "!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    model = pc.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [(d, t) for d, t, *_ in rows if float(model.scores(x := pc.passages((t or "").encode()), [0] * len(x), 1)[0]) >= pc.THRESHOLD]
    assert len(left) < len(rows) - 25
    left = slow_lines(left)
    comp, _ = slow([t for _, t in left])
    left = [r for i, r in enumerate(left) if comp[i] == i]
    left = [r for r, hit in zip(left, (x[2] for x in brute(left, items))) if not hit]
    coder = TextDigests(default_vocabulary())
    got = {r.doc_id: r["ids"] for r in cp.run(spark, folder).collect()}
    assert got == {d: coder.encoder.encode(t) for d, t in left}
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == cp.COLUMNS
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_rows_that_share_or_lack_a_doc_id(spark, tmp_path):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    bench, near, other = line(12), line(60), line(60)
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, f"{line(5)} {bench}"), (1, line(30)), (None, f"{bench} {line(3)}"), (None, line(30)), (2, near), (2, other), (None, near), (7, near + " more"), (None, other), (2, other), (None, "lone twin words here"), (None, "lone twin words here")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert left(cp.decontamination_stage) == sorted((x for i, x in enumerate(texts) if i not in (0, 2)), key=str)
    assert left(cp.near_duplicate_stage) == sorted((x for i, x in enumerate(texts) if i not in (6, 7, 8, 9, 11)), key=str)
