"""The base kinds against plain patterns over whole texts; checksums and words nearby on small texts."""

import random
import re

from rankloom.llm import personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, s: str) -> bool:
    own = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(own[::-1])]
        return 14 <= len(own) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(own) <= 15


def brute(t: str) -> list[tuple[int, int, str]]:
    found = [(*m.span(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
    return sorted(found, key=lambda x: (x[0], list(PATTERNS).index(x[2])))


def base(t: str) -> list[tuple[int, int, str]]:
    return [(s, e, k) for s, e, k, _ in personal_data.spans(t.encode()) if k in personal_data.BASE]


def test_base_kinds_equal_plain_patterns():
    rng = random.Random(7)
    pieces = ["a@b.c", "x.y%z@q-r.st.u", "@", ".", "-", "+", " ", "1", "12", "255", "256.", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", "é", "ß", "_e@f.g", "\n", "(", "0000", "4111111111111111", "+49", "79927398713"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base(t) == brute(t), t


def test_checksums_and_words_nearby():
    kinds = lambda t: [(k, t[s:e]) for s, e, k, _ in personal_data.spans(t.encode())]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 here") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("DE89370400440532013000, paid") == [("iban", "DE89370400440532013000")]
    assert kinds("her SSN is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("lot 123-45-6789.") == [] and kinds("SSN 666-45-6789") == []
    assert kinds("téléphone 01 23 45 67 89") == [("local_phone", "01 23 45 67 89")]
    assert kinds("in 01 23 45 67 89 steps") == []
    score = lambda t: personal_data.spans(t.encode())[0][3]
    assert score("server at 10.1.2.3") > score("we saw 10.1.2.3") > score("version 10.1.2.3")
    assert kinds("version 10.1.2.3") == [("ip", "10.1.2.3")]


def test_long_texts_take_one_pass():
    for t in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1" + "(" * 400_000, "a@" * 200_000, "1 " * 200_000, "A" * 300_000, "12-" * 100_000):
        personal_data.spans(t.encode())


def test_query_and_edges(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é a@b.c", "x"), (3, "é a@b.c", "x"), (None, "1.2.3.4", "x"), (4, "ß" * 100_000 + " +1 (017) 555-7713", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    out = personal_data.op12_personal_data(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out) == [
        (0, 0, 1, 0, 0, "ip:0:7"), (1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 1, 0, 0, 0, "email:2:7"), (3, 1, 0, 0, 0, "email:2:7"), (4, 0, 0, 0, 1, "phone:100001:100018")]
    assert personal_data.personal_data(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    clean = personal_data.masked(spark.createDataFrame(rows, "doc_id long, text string, spans string")).where("doc_id = 3").first()
    assert clean.text == "é <email>" and clean.spans == "x"


def test_whole_table_against_plain_patterns(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in personal_data.op12_personal_data(spark, sf).collect():
        want = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
