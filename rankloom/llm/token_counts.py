"""Token counts from distinct pre-tokens: each is counted once, and documents add up what their pre-tokens need.

The pre-tokens are those of the tokeniser file's own normaliser and pre-tokeniser (here letters, single digits,
contractions, and other signs), with special strings cut out first as the library cuts them. Its model sees one pre-token
at a time, so a text has as many tokens as its pre-tokens have. Ids are never kept: one number for each distinct
pre-token is all that comes from the model.

Texts are cut at white space before they are normalised, which changes no pre-token (none holds white space), and lets a
worker remember the pre-tokens of runs that come again.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import map_batches, table, text_bytes, written
from rankloom.llm.word_counts import corpus_words, summed_over_words

LIMIT = 2048
#: Runs whose pre-tokens a worker remembers.
REMEMBERED = 200_000
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Fixed value: the pattern of word_bpe_49k.json; and the same for lower-cased ASCII bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Bytes that the library writes otherwise or takes for white space.
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
_kept: list = [None, None]


def specials(tokenizer_json: str) -> list[bytes]:
    return [t["content"].encode() for t in json.loads(tokenizer_json).get("added_tokens", [])]


def run_splitter(special: list[bytes]) -> Callable[[bytes], list[tuple[bool, list]]]:
    """The function from a text to its runs between white space; special strings are apart (True)."""
    cut = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + b")") if special else None

    def runs(text: bytes) -> list[tuple[bool, list]]:
        if cut and any(s in text for s in special):
            return [(bool(i % 2), [part] if i % 2 else _WIDE_SPACE.sub(b" ", part).split()) for i, part in enumerate(cut.split(text))]
        return [(False, (text if text.isascii() else _WIDE_SPACE.sub(b" ", text)).split())]

    return runs


def plain(tokenizer_json: str) -> bool:
    """Whether the file's rules are those that `_ASCII` writes down for ASCII: lower case, this pattern, bytes as letters."""
    rules = json.loads(tokenizer_json)
    steps = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    return cuts[0]["pattern"] == {"Regex": PATTERN} and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]


def splitter(tokenizer_json: str) -> Callable[[bytes], list]:
    """The function from a text to its pre-tokens in any order (as the model takes them, in UTF-8); special strings are
    their own. Runs of printable ASCII are cut by the file's pattern as bytes, all others by the library."""
    runs, quick = run_splitter(specials(tokenizer_json)), plain(tokenizer_json)

    def pretokens(text: bytes) -> list:
        tokenizer, known = tokenizer_for(tokenizer_json)
        out: list = []
        for special, own in runs(text):
            if special:
                out += own
                continue
            if quick and not _CONTROL.search(text):
                out += _ASCII.findall(b" ".join([r for r in own if r.isascii()]).lower())
                own = [r for r in own if not r.isascii()]
            for run in own:
                found = known.get(run)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    whole = run.decode("utf-8", "replace")
                    if tokenizer.normalizer:
                        whole = tokenizer.normalizer.normalize_str(whole)
                    found = known[run] = [p.encode() for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(whole)] if tokenizer.pre_tokenizer else [whole.encode()]
                out += found
        return out

    return pretokens


def tokenizer_for(tokenizer_json: str):
    """One tokeniser for each Python worker, kept over tasks, and the pre-tokens of runs seen before."""
    if _kept[0] != hash(tokenizer_json):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _kept[:] = hash(tokenizer_json), (Tokenizer.from_str(tokenizer_json), {})
    return _kept[1]


def pieces_per_word(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """`words` (word, n_all) with `pieces`, the number of tokens the model makes of each."""
    special = set(specials(tokenizer_json))

    def batch(b):
        model = tokenizer_for(tokenizer_json)[0].model
        own = [w.as_py() for w in b.column("word")]
        return {"word": b.column("word"), "n_all": b.column("n_all"), "pieces": [1 if w in special else len(model.tokenize(w.decode())) for w in own]}

    return map_batches(words.select("word", "n_all"), batch, "word binary, n_all long, pieces long")


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, n_bytes, n_tokens of the whole text, over_limit (more than `limit` tokens).

    Null and empty texts have no bytes and no tokens. Rows with equal keys give a row each.
    """
    texts = text_bytes(docs, key, text=text).withColumn("_bytes", F.octet_length("_text").cast("long"))
    pretokens = splitter(tokenizer_json)
    found = written(pieces_per_word(corpus_words(texts, pretokens), tokenizer_json), "pretoken-pieces")
    out = summed_over_words(texts, pretokens, found, [key, "_bytes"], {"n_tokens": ("long", F.col("pieces"))})
    return out.select(key, F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_counts(table(spark, sf_dir, "documents"), f.read())
