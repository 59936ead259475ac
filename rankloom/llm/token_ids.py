"""Byte-level BPE: text to ids and back, by backtracking over longest matches.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over `str` finds every vocabulary entry in a
piece. The encoder takes the longest entry at each place; where the entry can't follow the last one (merging by
rank would have joined across the border), it tries the next shorter prefix, and where none is left it steps
back and never returns to that place. Whether two entries can stand side by side depends on those two alone and
is remembered, so the work is linear in the piece, and the result equals merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import map_batches, table, text_bytes

#: Remembered pieces in a Python worker; the table is emptied when full, which changes no result.
MEMO = 400_000


@dataclass
class Vocabulary:
    """What a worker needs: the entries by rank, the last merge of each, and the pattern that cuts the text."""

    entries: list[bytes]
    left: list[int]
    right: list[int]
    pattern: str


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file (base64 entry, rank), and for each entry the two entries that its last merge joins."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    entries = [e for e, _ in sorted(ranks.items(), key=lambda x: x[1])]
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    left, right = list(range(len(entries))), list(range(len(entries)))
    for rank, entry in enumerate(entries):
        if len(entry) > 1:
            parts = [entry[i : i + 1] for i in range(len(entry))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
                if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                    raise ValueError(f"no merges lead to entry {rank}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return Vocabulary(entries, left, right, pattern)


class Encoder:
    """Encodes and decodes with one vocabulary; holds the automaton and what it remembers."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.ranks = {e: i for i, e in enumerate(vocabulary.entries)}
        self.automaton = ahocorasick.Automaton()
        for i, e in enumerate(vocabulary.entries):
            self.automaton.add_word(e.decode("latin-1"), (i, len(e)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(vocabulary.pattern).findall

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of this one, -1 if none."""
        if (found := self.shorter.get(token)) is None:
            e = self.v.entries[token]
            found = self.shorter[token] = next((r for n in range(len(e) - 1, 0, -1) if (r := self.ranks.get(e[:n])) is not None), -1)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves `a` and `b` side by side: undo the merges of both, the latest first,
        and see that at no time an earlier merge than those still to come would have joined over the border."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        x, y, limit = a, b, len(self.v.entries)
        entries, left, right = self.v.entries, self.v.left, self.v.right
        while True:
            joined = self.ranks.get(entries[x] + entries[y])
            if joined is not None and joined < limit:
                fits = False
                break
            whole_x, whole_y = left[x] == x, left[y] == y
            if whole_x and whole_y:
                fits = True
                break
            # On equal ranks the left one merged first, so the right one is undone first and may tie.
            if whole_y or (not whole_x and x > y):
                limit, x = x, right[x]
            else:
                limit, y = y + 1, left[y]
        if len(self.fits) >= 4 * MEMO:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        longest, size = [-1] * (n + 1), [0] * n
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        entries = self.v.entries
        closed = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(entries[token])
                if not closed[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at += len(entries[token])
                token = longest[at]
            else:
                closed[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                last = out.pop()
                at -= len(entries[last])
                token = self.next_shorter(last)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.find(text):
            if (ids := self.pieces.get(p)) is None:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                ids = self.encode_piece(p.encode())
                if len(p) <= 64:
                    self.pieces[p] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        entries = self.v.entries
        return b"".join([entries[i] for i in ids])


#: A blank before another blank; where a text has none, each place before " x" begins a new piece.
_ODD_SPACE = re.compile(r" \s")


class TextDigests:
    """Counts and digests of whole texts. A blank and what follows it up to the next blank are encoded once and
    remembered as (ids written out, their number, the bytes they decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder = Encoder(vocabulary)
        self.memo: dict[str, tuple[bytes, int, bytes]] = {}

    def part(self, p: str) -> tuple[bytes, int, bytes]:
        ids = self.encoder.encode(p)
        got = (",".join(map(str, ids)).encode(), len(ids), self.encoder.decode(ids))
        if len(p) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[p] = got
        return got

    def parts(self, text: str) -> list[tuple[bytes, int, bytes]]:
        if not text:
            return []
        if _ODD_SPACE.search(text):
            return [self.part(text)]
        first, *rest = text.split(" ")
        get, part = self.memo.get, self.part
        out = [get(first) or part(first)] if first else []
        for w in rest:
            w = " " + w
            out.append(get(w) or part(w))
        return out


_kept: list = [None, None]


def coder_for(shared) -> TextDigests:
    """One coder for each Python worker, kept over tasks with the broadcast it was made from."""
    if _kept[0] is not shared:
        _kept[:] = shared, TextDigests(shared.value)
    return _kept[1]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, n_tokens, ids_sha256, decoded_sha256 and n_bytes of the whole text.

    Null and empty texts have no tokens and the digests of nothing. Rows with equal keys give a row each; other
    columns are left out. No shuffle: rows are encoded where they are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batch(b):
        coder = coder_for(shared)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_bytes": []}
        for t in b.column("_text"):
            raw = t.as_py()
            got = coder.parts(raw.decode("utf-8", "replace"))
            decoded = b"".join([x[2] for x in got])
            out["n_tokens"].append(sum([x[1] for x in got]))
            out["ids_sha256"].append(hashlib.sha256(b",".join([x[0] for x in got])).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            out["n_bytes"].append(len(raw))
        return out | {key: b.column(key)}

    kind = docs.select(key).schema[key].dataType.simpleString()
    return map_batches(text_bytes(docs, key, text=text), batch, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def encode_ids(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, n_tokens, ids (array of int). Null and empty texts have none. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batch(b):
        encode = coder_for(shared).encoder.encode
        ids = [encode(t.as_py().decode("utf-8", "replace")) for t in b.column("_text")]
        return {key: b.column(key), "n_tokens": [len(x) for x in ids], "ids": ids}

    kind = docs.select(key).schema[key].dataType.simpleString()
    return map_batches(text_bytes(docs, key, text=text), batch, f"{key} {kind}, n_tokens long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """Per row of `encoded` (key, ids): key, text; bytes that are no UTF-8 become the replacement character."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.entries)

    def batch(b):
        entries = shared.value
        return {key: b.column(key), "text": [b"".join([entries[i] for i in x or ()]).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]}

    kind = encoded.select(key).schema[key].dataType.simpleString()
    return map_batches(encoded.select(key, "ids"), batch, f"{key} {kind}, text string")


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"), default_vocabulary())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
