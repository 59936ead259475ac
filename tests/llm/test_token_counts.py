import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import token_counts as tc
from rankloom.llm import word_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = open(PATH, encoding="utf-8").read()
LIB = Tokenizer.from_file(PATH)
PRETOKENS = tc.splitter(JSON)


def count(text):
    return sum(1 if w in tc.specials(JSON) else len(LIB.model.tokenize(w.decode())) for w in PRETOKENS(text.encode()))


def test_each_word_is_cut_as_the_library_cuts_it():
    assert PRETOKENS("Don't stop, word. word! 12é".encode()) == b"don 't stop , word . word !".split() + [b"1", b"2", "Ã©".encode()]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "don't", " ", "\n", "é", "é", "́", "ΑΣ", "a\x1cb", " ", "\x85", "\xa0", "　", "汉", "5.0", "!?", "İ", "\x0b"]), st.text(max_size=6)), max_size=12).map("".join))
def test_as_the_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert count(text) == len(LIB.encode(text, add_special_tokens=False))


def test_query_rows(spark, monkeypatch):
    texts = [None, "", "Hello, world <|endoftext|>x", "word " * 3000, "rare-one x y", "rare-one x y", "z" * 20000, "a b c d e f g"]
    docs = spark.createDataFrame([(i % 7, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_all int")
    want = sorted((i % 7, len((t or "").encode()), n := len(LIB.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in enumerate(texts))
    assert sorted(map(tuple, tc.token_counts(docs, JSON).collect())) == want
    monkeypatch.setattr(word_counts.summed_over_words, "__defaults__", (3,))
    assert sorted(map(tuple, tc.token_counts(docs, JSON).collect())) == want
    assert tc.token_counts(docs.limit(0), JSON).count() == 0
