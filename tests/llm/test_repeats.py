import random
import re

from rankloom.llm import repeats as rp


def slow(rows, least=51):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for d, t in rows if d is not None]
    held = {}
    for d, w in docs:
        for i in range(len(w) - least + 1):
            held.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = []
    for d, w in docs:
        hit = set()
        for i in range(len(w) - least + 1):
            if len(held[tuple(w[i : i + least])]) > 1:
                hit |= set(range(i, i + least))
        if hit:
            out.append((d, len(w), len(hit)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    a, b, c = make(52), make(70), make(300)
    rows = [(i, make(rng.choice([0, 5, 50, 51, 52, 200]))) for i in range(40)]
    rows += [(100, make(80) + " " + a + " " + make(60)), (101, a), (102, make(3) + "\n" + a.upper() + " " + make(9)), (103, c), (104, c), (105, c[: len(c) // 2] + " x " + c[len(c) // 2 :])]
    rows += [(110, b + " " + make(30)), (111, make(20) + " " + b), (112, b[20:] + " " + make(50)), (113, a + " " + b), (114, a + " " + make(10) + " " + a)]
    rows += [(120, (d := make(60)) + " y " + d), (130, None), (131, ""), (None, c), (132, "same " * 400), (133, "same " * 300), (103, make(80)), (134, c + " " + " ".join(["t u v"] * 5000))]
    left, mid, right = make(30), make(20), make(30)
    rows += [(140, f"{left} {mid} {right}"), (141, f"{make(30)} {mid} {right}"), (142, f"{left} {mid} {make(30)}"), (143, f"q {' '.join(left.split()[4:])} {mid} {' '.join(right.split()[:6])} r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as core", "2 as n_words")
    got = rp.repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_repeated) for r in got) == slow(rows)
    assert all(r.other_doc_id != r.doc_id for r in got)
    assert {r.doc_id: r.other_doc_id for r in got}[104] == 103
    assert rp.repeats(docs.limit(0)).count() == 0


def test_many_edited_copies_over_many_partitions(spark):
    rng = random.Random(9)
    base, spare = [f"w{i}" for i in range(260)], [f"v{i}" for i in range(4)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(spare)
        first = rng.randrange(120)
        rows.append((i, " ".join(words[first : first + rng.choice([55, 90, 140])])))
    rows += [(200, "z" * 5000 + " " + " ".join(base[:70])), (201, "z" * 5000 + " " + " ".join(base[:70]) + " q")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rp.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.doc_id, r.n_words, r.n_repeated) for r in got) == slow(rows)
    assert all(r.other_doc_id != r.doc_id for r in got)


def test_neighbours_leave_windows_open(spark):
    """In both orders the neighbours of the first row share too few words on one side, its partner is further off."""
    side = lambda own, n, shared: "".join(f"{x} " for x in [*(f"s{i}" for i in range(shared)), *(f"{own}{i}" for i in range(n - shared))]).encode()
    rows = [(1, 1, 1, 1, side("k", 16, 16), side("k", 16, 16)), (1, 2, 2, 2, side("x", 16, 10), side("y", 16, 10)), (1, 3, 3, 3, side("x", 16, 2), side("s", 16, 15)), (1, 4, 4, 4, side("s", 16, 15), side("x", 16, 2))]
    df = spark.createDataFrame(rows, "core long, around long, low long, high long, before binary, after binary")

    def shared(a, b, i):
        return a[4].split()[:i] == b[4].split()[:i] and a[5].split()[: 16 - i] == b[5].split()[: 16 - i]

    want = {r[1]: m for r in rows if (m := sum(1 << i for i in range(17) if any(shared(r, t, i) for t in rows if t is not r)))}
    assert {r.around: r.mask for r in rp.shared_windows(df, 16).collect()} == want


def test_ids_of_another_type(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(n))
    shared = line(60)
    rows = [("b", f"{line(5)} {shared}"), ("a10", f"{shared} {line(4)}"), ("a9", line(80)), (None, shared), ("c", None), ("zz", f"{line(3)} {shared} {line(70)}")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id string, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_repeated, r.other_doc_id, [tuple(s) for s in r.spans]) for r in rp.repeats(docs).collect()}
    assert {d: x[:2] for d, x in got.items()} == {"b": (65, 60), "a10": (64, 60), "zz": (133, 60)}
    assert got["b"][2] == "a10" and got["a10"][2] in ("b", "zz") and got["zz"][3] == [(3, 60)]
