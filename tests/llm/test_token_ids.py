import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.token_ids import Encoder, TextDigests, decode_ids, default_vocabulary, encode_ids, encode_texts

V = default_vocabulary()
CODER = TextDigests(V)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in enumerate(V.entries)}, special_tokens={})


def ids_of(text):
    got = CODER.parts(text)
    joined = b",".join(x[0] for x in got)
    return [int(x) for x in joined.split(b",")] if joined else [], b"".join(x[2] for x in got)


@pytest.mark.parametrize("text", ["", " ", "   a", "a  b", " \n x", "it's  we'll", "x" * 5000, "ab" * 3000, "<|endoftext|> ünïcödé 汉字 \U0001f600", "a\x1cb \x1d c", "\t\t x  y", "123 4567\n\n8"])
def test_cases(text):
    ids, decoded = ids_of(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert decoded == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab eT'sn\n.é1 ")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random(text):
    ids, decoded = ids_of(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert decoded == text.encode()


def test_letters_alone():
    coder = Encoder(V)
    for word in ("theaningtionandness", "aaaaaaaaaaab", "ionionionio", "zxqzxqzxq"):
        assert list(coder.encode_piece(word.encode())) == THEIRS.encode_ordinary(word)


def test_rows(spark):
    texts = [None, "", "Some text,  twice", "Some text,  twice", "é" * 30000, "word and " * 9000]
    docs = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    ids = encode_ids(docs, V)
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == sorted((i % 5, THEIRS.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted(map(tuple, decode_ids(ids, V).collect())) == sorted((i % 5, t or "") for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_tokens) for r in encode_texts(docs, V).collect()) == sorted((r.doc_id, r.n_tokens) for r in ids.collect())
    assert encode_ids(docs.limit(0), V).count() == 0
