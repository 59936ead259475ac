import random
import re

from pyspark.sql import functions as F

from rankloom.llm import quality_rules as qr


def slow(text):
    text = text or ""
    w = re.findall(qr.WORD, text)
    seen, rep = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            rep |= {i + k for i in at for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(qr.WORD, line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_base_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a b\na b\n\n\na b", "x " * 8, "x " * 9, "é| " * 40, "long " * 20000]
    texts += [" ".join(rng.choices(["a", "b", "c\n", "d$"], k=rng.choice([7, 9, 30, 200]))) for _ in range(60)]
    rows = [(i % 50, t, None if i == 3 else "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = sorted(tuple(r)[:7] for r in qr.quality(docs).collect())
    assert got == sorted((i % 50, *slow(t)) for i, t in enumerate(texts))
    assert qr.quality(docs.limit(0)).count() == 0


def test_fences(spark):
    clean = " ".join(f"word{i} other{i * 7}" for i in range(40))
    rows = [(i, clean.replace("word", "w" * (1 + i % 3)), "en", "a") for i in range(300)]
    rows += [(1000, clean.replace("word", "$$$"), "en", "a"), (1001, clean.upper(), "en", "b")]
    got = {r.doc_id: r for r in qr.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(300))
    assert got[1000].refused[0] == "symbol_rate" and "capital_rate" in got[1001].refused


def test_fences_follow_each_cell(spark):
    rng = random.Random(6)
    value = {s: [round(rng.random() * scale, 6) for _ in range(900)] for s, scale in (("plain", 0.1), ("forum", 2.0))}
    same = {"repeat_rate": 0.0, "dup_line_rate": 0.0, "capital_rate": 0.1}
    rows = [("en", s, v, *same.values(), 4 + v) for s, own in value.items() for v in own] + [("en", "tiny", 0.9, 0.0, 0.5, 0.1, 4.0), (None, None, 0.5, 0.0, 0.0, 0.1, 4.0)]
    df = spark.createDataFrame(rows, "lang string, source string, symbol_rate double, repeat_rate double, dup_line_rate double, capital_rate double, word_length double").withColumns({c: F.lit(0.0) for c in qr.STEPS.values()})
    got = {r.source: r for r in qr.fences(df).collect()}
    rank = lambda own, q: sorted(own)[max(0, -(-int(q * 1000) * len(own) // 1000) - 1)]
    for s, own in value.items():
        near = lambda q, own=own: {rank(own, q + d) for d in (-0.002, 0, 0.002)}
        top, mid = near(0.9), near(0.5)
        assert min(t + qr.REACH * (t - m) for t in top for m in mid) - 1e-9 <= got[s].high_symbol_rate <= max(t + qr.REACH * (t - m) for t in top for m in mid) + 1e-9
        assert got[s].level == "cell" and got[s].high_capital_rate == 0.1 and got[s].low_word_length < 4
    assert got["forum"].high_symbol_rate > 10 * got["plain"].high_symbol_rate
    assert got["tiny"].level == "language" and got[None].level == "all"


def test_rates_of_zero_take_their_scale_from_one_occurrence(spark):
    rows = [("en", s, 0.0, 0.0, 0.0, 0.1 + i / 1e4, 5 + i / 100, 1 / n, 1 / 4, 1 / (5 * n)) for s, n in (("long", 1000), ("short", 40)) for i in range(300)]
    names = ["lang", "source", *qr.MEASURES, *(qr.STEPS[c] for c in ("n_words", "n_lines", "word_chars"))]
    got = {r.source: r for r in qr.fences(spark.createDataFrame(rows, names)).collect()}
    for s, n in (("long", 1000), ("short", 40)):
        assert abs(got[s].high_symbol_rate - qr.REACH / n) < 1e-9 and abs(got[s].high_repeat_rate - qr.REACH * qr.WINDOW / n) < 1e-9 and abs(got[s].high_dup_line_rate - qr.REACH / 4) < 1e-9


def test_kept_against_exact_quantiles(spark):
    """Cells of fewer values than a sketch holds: the verdict from sorted values."""
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdeA", k=rng.randint(2, 9))) + ("#" if rng.random() < junk else "") for _ in range(rng.randint(15, 90))).replace("e ", "e\n")
    rows = []
    for i in range(900):
        junk = rng.choice([0, 0, 0, 0, 0, 0.01, 0.6])
        rows.append((i, text(), "en", rng.choice(["a", "b"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    held = [r.asDict() for r in qr.measured(docs).collect()]
    rank = lambda own, q: sorted(own)[max(0, -(-int(round(q * 1000)) * len(own) // 1000) - 1)]
    want = {}
    for r in held:
        cell = [x for x in held if x["source"] == r["source"]]
        bad = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        for m, (share_of, times, both) in qr.MEASURES.items():
            own = [x[m] for x in cell if x[m] is not None]
            mid, step = rank(own, 0.5), times * rank([x[qr.STEPS[share_of]] for x in cell if x[qr.STEPS[share_of]] is not None], 0.5)
            high = rank(own, 0.9) + qr.REACH * (abs(rank(own, 0.9) - mid) or step)
            low = rank(own, 0.1) - qr.REACH * (abs(rank(own, 0.1) - mid) or step) if both else -1
            bad = bad or r[m] > high or r[m] < low
        want[r["doc_id"]] = not bad
    got = {r.doc_id: r.kept for r in qr.quality(docs).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
