"""Phrases whose words occur together oftener than apart: Misra-Gries summaries first, exact counts after.

Texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`, A-Z lower-cased. All runs of one to
`LONGEST` words are hashed together with their language, and the hash deals them to partitions. Each task sends each
partition its hashes with their counts; a partition merges them into a Misra-Gries summary. Its capacity exceeds
the partition's mass divided by the threshold, so what the summary ever takes off a counter stays below the threshold and
every run that is frequent in all texts survives. The survivors become a bitmap of fixed size; a second pass over
the texts counts the words themselves of all runs that the bitmap knows. A run too many in the bitmap costs a row and
is dropped by its exact count; none is missing.

Every part of a frequent run is frequent, so scores come from the second pass's table by joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import LOWER, UPPER, batch_rows, join_rows, table, written

LEAST, LONGEST, FIRST, SCALE = 30, 4, 2000, 2_000_000
#: A candidate goes if a longer one around it has this share of its occurrences (4 of 5).
COVER = (4, 5)
UNKNOWN = "und"
#: Runs that a partition of the first pass should hold; all its tasks' hashes, 2 to 3 bytes each, meet in one group.
PART_MASS, LEAST_PARTS = 16_000_000, 64
#: Runs that a task gathers before it sends them, in the first and in the second pass; they bound its memory.
SENT_RUNS, SENT_KNOWN = 2_000_000, 500_000
#: Bits of the bitmap, as a power of two: 8 MB whatever the input.
BITS = 26
TEXT_ROWS, TEXTS = 500, 128  # texts in an Arrow batch, and in a slice of it whose words are numbered at a time
_BREAK = b"\xff"  # in no UTF-8
_BYTES = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + _BREAK * 10 + b" ")
_STEP, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def marked_words(text: bytes) -> list[bytes]:
    """The words of all pieces in order, with a mark wherever a piece ends."""
    return text.translate(_BYTES).replace(_BREAK, b" \xff ").split()


class Numbered:
    """Texts as numbers of their words; 0 is the end of a piece. `words` has what the numbers mean."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_BREAK]
        self.hashes = np.zeros(1, np.uint64)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        get, out = self.number.__getitem__, []
        for t in texts:
            own = marked_words(t)
            out.append(np.fromiter(map(get, own), np.int32, len(own)))
        if (new := len(self.number) - len(self.hashes)) > 0:
            words = list(self.number)[-new:]
            self.hashes = np.concatenate((self.hashes, np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, new)))
        return out

    def words(self) -> list[bytes]:
        return list(self.number)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def runs(ids: np.ndarray, hashes: np.ndarray, lang: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: where runs of so many words of one piece begin, and their hashes; `lang` is a hash for each place."""
    own, ok, h = hashes[ids], ids > 0, lang
    for size in range(1, LONGEST + 1):
        if size > 1:
            ok, h = ok[:-1] & (ids[size - 1 :] > 0), h[:-1]
        h = mixed((h * _STEP) + own[size - 1 :])
        at = np.flatnonzero(ok)
        yield size, at, h[at]


def dealt(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition (upper half) and key within it (lower half)."""
    return (((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(32)) | (h & _LOW)


def place_of(key: np.ndarray) -> np.ndarray:
    return (mixed(key * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes: the upper ones are nearly all 0, which the shuffle's codec takes away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of sorted keys, and how often they are there."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Summary:
    """A Misra-Gries summary of `room` counters; `lost` is the most that any counter, or a key without one, falls short."""

    def __init__(self, room: int):
        self.room, self.lost = room, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = summed(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        if len(self.keys) > self.room:
            cut = int(np.partition(self.counts, -self.room - 1)[-self.room - 1])
            left = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[left], self.counts[left] - cut, self.lost + cut


def of_language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(UNKNOWN))


def read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(of_language(docs[lang]).alias("lang"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("_text"))


def slices(batches: Iterator[pa.RecordBatch], numbered: list[Numbered]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, int], list[str], np.ndarray]]:
    """Word numbers of a few texts each (ends of texts are ends of pieces), the hash of each place's language, words by
    language, and the languages with each place's own; numbers are those of `numbered[0]`, which may be put anew."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            langs = b.column("lang").to_pylist()
            texts = numbered[0].ids([t.as_py() for t in b.column("_text")])
            names = sorted(set(langs))
            which = {x: i for i, x in enumerate(names)}
            hashed = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], np.uint64)
            each = np.repeat(np.array([which[x] for x in langs], np.int64), [len(t) + 1 for t in texts])
            ids = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int32))])
            n = np.bincount(each[ids > 0], minlength=len(names))
            yield ids, hashed[each], dict(zip(names, n.tolist(), strict=True)), names, each


def survivors(texts: DataFrame, least: int, parts: int) -> DataFrame:
    """place (long): where the bitmap has a bit for each run that may occur `least` times or oftener."""

    def run(batches):
        numbered, held, n = [Numbered()], [], 0

        def sent():
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            keys, counts = distinct(keys)
            part = (keys >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            edge = np.append(first, len(keys))
            low = (keys & _LOW).astype(np.int64)
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[first], pa.int64()), pa.array([int(counts[a:z].sum()) for a, z in spans], pa.int64()),
                 pa.array([planes(np.diff(low[a:z], prepend=0)) for a, z in spans], pa.binary()), pa.array([planes(counts[a:z]) for a, z in spans], pa.binary())],
                names=["part", "mass", "keys", "counts"])

        for ids, lang, *_ in slices(batches, numbered):
            for _, _, h in runs(ids, numbered[0].hashes, lang):
                held.append(dealt(h, parts))
                n += len(h)
            if n >= SENT_RUNS:
                yield sent()
                numbered[0], held, n = Numbered(), [], 0
        if n:
            yield sent()

    def frequent(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        summary = Summary(sum(rows.column("mass").to_pylist()) // least + 1)
        keys, counts, n = [], [], 0
        for k, c in zip(rows.column("keys"), rows.column("counts"), strict=True):
            keys.append(np.cumsum(from_planes(k.as_py()), dtype=np.uint64).astype(np.uint32))
            counts.append(from_planes(c.as_py()).astype(np.int64))
            n += len(keys[-1])
            if n > max(1 << 20, summary.room):
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, n = [], [], 0
        if n:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
        found = summary.keys[summary.counts + summary.lost >= least].astype(np.uint64)
        return pa.table({"place": np.unique(place_of((np.uint64(part) << np.uint64(32)) | found))})

    sent = texts.mapInArrow(run, "part long, mass long, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(frequent, "place long")


def bitmap(places: DataFrame) -> np.ndarray:
    """2^BITS bits; at most a 64th as many rows come back, whatever the input."""
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def exact_counts(texts: DataFrame, known: np.ndarray, parts: int) -> DataFrame:
    """lang, phrase, size, a: the occurrences of each run that the bitmap knows, and per language a row of size 0 with its words."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        bits, numbered, held, n = shared.value, [Numbered()], [], 0
        total: dict[str, int] = defaultdict(int)

        def sent():
            words, names = numbered[0].words(), sorted({x for *_, own in held for x in own})
            which = {x: i for i, x in enumerate(names)}
            h = np.concatenate([x[0] for x in held])
            rows = np.concatenate([x[1] for x in held])
            lang = np.concatenate([np.array([which[y] for y in x[3]], np.int64)[x[2]] for x in held])
            held.clear()
            _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # Equal hashes of other words are told apart: such occurrences get a row each.
            other = np.flatnonzero((rows[first][inverse] != rows).any(1) | (lang[first][inverse] != lang))
            times = times - np.bincount(inverse[other], minlength=len(first))
            at = np.concatenate((first, other))
            phrase = [b" ".join([words[j] for j in r if j]) for r in rows[at].tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in lang[at].tolist()], pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()),
                 pa.array((rows[at] > 0).sum(1).astype(np.int32)), pa.array(np.concatenate((times, np.ones(len(other), np.int64))), pa.int64())],
                names=["lang", "phrase", "size", "a"])

        for ids, lang, count, names, each in slices(batches, numbered):
            for x, c in count.items():
                total[x] += c
            padded = np.concatenate((ids, np.zeros(LONGEST, np.int32)))
            for size, at, h in runs(ids, numbered[0].hashes, lang):
                place = place_of(dealt(h, parts))
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                at, h = at[hit], h[hit]
                rows = np.zeros((len(at), LONGEST), np.int32)
                for j in range(size):
                    rows[:, j] = padded[at + j]
                held.append((h, rows, each[at], names))
                n += len(at)
            if n >= SENT_KNOWN:
                yield sent()
                numbered[0], held, n = Numbered(), [], 0
        if n:
            yield sent()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([""] * len(total), pa.string()), pa.array([0] * len(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "size", "a"])

    return texts.mapInArrow(run, "lang string, phrase string, size int, a long").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))


def parts_of(texts: DataFrame) -> int:
    """As many partitions as the bytes of the texts ask for: a word takes some six, and begins LONGEST runs."""
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(LEAST_PARTS, int(size) * LONGEST // 6 // PART_MASS)


def joined(words: str, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """`rows` with the count of the phrase in column `part` as `name`. Common parts, as single words are, meet no single task."""
    keyed = rows.withColumn("_key", F.struct("lang", F.col(part).alias("phrase")))
    asked = keyed.groupBy("_key").agg(F.count("*").alias("n"))
    found = asked.join(counts.select(F.struct("lang", "phrase").alias("_key"), F.col("a").alias(name)), "_key")
    return join_rows(keyed, written(found, "phrase-parts"), "_key").drop("_key")


def phrases(docs: DataFrame, least: int = LEAST, first: int = FIRST, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language the `first` best phrases of two to four words: lang, rank, phrase, a (occurrences), l and r (those of
    both sides of the worst cut), n (words of the language), score floor(2000000 a / (l + r)); a >= `least`.

    Null languages are `und`; null and empty texts have no words; repeated rows count as often as they are there; ties
    go by score, occurrences and then the bytes of the phrase. An empty table, or one without frequent phrases, gives no rows.
    """
    texts = read(docs, text, lang)
    parts = parts_of(texts)
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        known = bitmap(survivors(texts, least, parts))
        counts = written(exact_counts(texts, known, parts).where(f"a >= {least} or size = 0"), "phrase-counts")
    found = counts.where("size > 1").withColumn("w", F.split("phrase", " ", -1))
    cut = found.select("lang", "phrase", "size", "w", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"left": joined("w", F.lit(1), F.col("k")), "right": joined("w", F.col("k") + 1, F.col("size") - F.col("k"))}).drop("w")
    known_parts = counts.where(f"size between 1 and {LONGEST - 1}")
    sides = looked_up(looked_up(cut, known_parts, "left", "l"), known_parts, "right", "r")
    scored = sides.withColumn("score", F.expr(f"cast(a as decimal(19,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)"))
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inside = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = found.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    share, whole = COVER
    own = worst.join(longer, ["lang", "phrase"], "left").where(f"_around is null or cast(_around as decimal(20,0)) * {whole} < cast(a as decimal(20,0)) * {share}")
    own = written(own.select("lang", "phrase", "a", "x.l", "x.r", "x.score"), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each slice of a language first, so that no task sorts all phrases of one.
    sliced = own.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(own.count() // 50_000 + 1)))
    best = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(f"_at <= {first}")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {first}")
    total = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
with pieces as (select coalesce(lang,'und') as lang, unnest(string_split_regex(translate(coalesce(text,''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
listed as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
runs as (select lang, s, array_to_string(list_slice(w,i,i+s-1),' ') as phrase
 from (select lang, w, s, unnest(range(1,len(w)-s+2)) as i from listed, (values (1),(2),(3),(4)) z(s) where len(w)>=s) x),
f as (select lang, s, phrase, count(*) as a from runs group by lang, s, phrase),
n as (select lang, cast(sum(a) as bigint) as n from f where s=1 group by lang),
c as (select lang, s, phrase, a, string_split(phrase,' ') as w from f where s>1 and a>={LEAST}),
cuts as (select lang, s, phrase, a, k, array_to_string(list_slice(w,1,k),' ') as x, array_to_string(list_slice(w,k+1,s),' ') as y from (select *, unnest(range(1,s)) as k from c) z),
sides as (select c.lang, c.phrase, c.a, c.k, p.a as l, q.a as r, cast((cast({SCALE} as hugeint)*c.a)//(p.a+q.a) as bigint) as score
 from cuts c join f p on p.lang=c.lang and p.phrase=c.x and p.s=c.k join f q on q.lang=c.lang and q.phrase=c.y and q.s=c.s-c.k),
worst as (select * from sides qualify row_number() over (partition by lang, phrase order by score, k)=1),
subs as (select lang, s, a, m, w, unnest(range(1,s-m+2)) as i from c, (values (2),(3)) z(m) where m<s),
around as (select lang, array_to_string(list_slice(w,i,i+m-1),' ') as phrase, max(a) as b from subs group by 1, 2),
kept as (select w.* from worst w left join around o on o.lang=w.lang and o.phrase=w.phrase where o.b is null or cast(o.b as hugeint)*100 < cast(w.a as hugeint)*80)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n.n, score
from kept k join n on n.lang=k.lang qualify row_number() over (partition by k.lang order by score desc, a desc, phrase) <= {FIRST}
"""
