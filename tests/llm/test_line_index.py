import hashlib

import numpy as np

from rankloom.llm import line_index as li

LONG = "a line that is long enough"
ROWS = [
    (3, f"{LONG}\nshort\nonly here and not there"), (1, f"  {LONG.upper()}\t\nanother line of some length"), (7, None), (8, ""),
    (9, f"{LONG}\n{LONG}\nshort\nanother line of some length"), (9, "another line of some length"), (10, "x" * 50000 + "\n" + LONG), (11, "only twice in here\nonly twice in here"),
]


def brute(rows):
    key = lambda l: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in l.strip(li.SPACES))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= 2 and d > min(h))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as h", "3 as n_chars")
    out = li.dedup_lines(docs)
    assert result(out) == brute(ROWS)
    assert {"pos", "h", "n_chars"} <= set(out.columns)
    assert li.dedup_lines(docs.limit(0)).count() == 0


def test_deletion_undoes_insertion(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = li.insert(li.empty_index(spark, 3), docs.where("doc_id > 5"))
    index = li.insert(index, docs.where("doc_id <= 5"))
    assert result(li.cleaned(index, docs)) == brute(ROWS)
    index = li.delete(index, spark.createDataFrame([(1,)], "doc_id long"))
    rest = [r for r in ROWS if r[0] != 1]
    assert result(li.cleaned(index, docs.where("doc_id <> 1"))) == brute(rest)
    index = li.delete(index, docs.where("doc_id <> 3").select("doc_id"))
    assert index.counts.where("first_doc < last_doc").count() == 0
    for r in index.filters.collect():
        assert not np.frombuffer(r.slots, np.uint16).any()


def test_filter_never_misses():
    keys = np.random.default_rng(5).integers(-(2**62), 2**62, 20000)
    made = li.changed_filter(None, keys[:0], keys, keys)
    assert made.contains(keys).all()
    assert made.contains(keys + 1).mean() < 0.01
    made.delete(keys[:10000])
    assert made.contains(keys[10000:]).all()
    assert made.contains(keys[:10000]).mean() < 0.01
