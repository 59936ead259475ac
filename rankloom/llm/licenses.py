"""Licences of files: sparse TF-IDF cosine of headers, licence files, paragraphs and lines to licence templates, then
inheritance from directories.

A text is cut at lines without a letter or digit into paragraphs; the comment lines that open it are its header.
Compared are each line and each paragraph (notices, so that a wrapped notice is met whole), the header (notices and
whole texts) and, in a file named as a licence, the whole file and each of its paragraphs (whole texts, titles). The
closest template, if close enough, is the licence of such a unit; ties go to the first name. A unit stands for all
units inside it if its similarity is at least WHOLE, or at least that of each of them; else they stand for themselves.

A file is a licence file if it has a licence and is named as one, or has at least half its words in such units; it
licenses its directory and all below. A file without a licence inherits from its nearest ancestor directory that has
one. DataFrame functions only.

Weights are (1 + ln tf) * idf, idf = ln((1 + lines) / (1 + lines with the term)) + 1, over all lines of all files. By
Cauchy-Schwarz a line or paragraph can reach the least similarity to a notice only if it has one of the notice's
heaviest terms (the fewest that leave too little weight without them), so only those with such a term are weighed.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import join_rows, table, written
from rankloom.llm.licence_templates import NOTICES, TEXTS, TITLES

LEAST = 0.7
#: From this similarity on a unit is its template, whatever parts of it look like.
WHOLE = 0.9
TERM = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)"
#: A line end with a wordless line behind it; no repeated group, so long texts need no deep recursion.
GAP = r"\n[^\p{L}\p{N}\n]*+(?=\n)"
#: Which templates each kind of unit meets.
KINDS = {"line": [NOTICES], "paragraph": [NOTICES], "licence paragraph": [NOTICES, TITLES], "header": [NOTICES, TEXTS], "file": [TEXTS]}
UNIT = ["_file", "block", "line", "in_head", "kind"]


def terms_of(notice: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in re.findall(r"[^\W_]+(?:\.[0-9]+)*", notice.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def templates(*sets: dict[str, list[str]]) -> list[tuple[str, dict[str, int]]]:
    return [(name, terms_of(t)) for own in sets for name, texts in own.items() for t in texts]


def text_blocks(files: DataFrame, path: str, text: str) -> DataFrame:
    """A row for each paragraph with terms, and one at least for each file: _file (the row's key), path, named (as a
    licence file), block (its number), in_head, lines (the terms of each line that has any)."""
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False))
    rows = files.select(F.monotonically_increasing_id().alias("_file"), F.col(path).alias("path"), named.alias("named"), whole.alias("_text"))
    lines = F.split("_text", "\n", -1)
    code = F.array_position(F.transform(lines, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(COMMENT)), F.lit(True))
    rows = rows.withColumn("code", F.when(F.col("_text").rlike(COMMENT), code).otherwise(1).cast("int"))
    joined = lambda start, n: F.array_join(F.slice(lines, start, n), "\n")
    head = F.when(F.col("code") == 0, F.col("_text")).when(F.col("code") > 1, joined(F.lit(1), F.col("code") - 1))
    body = F.when(F.col("code") == 1, F.col("_text")).when(F.col("code") > 1, joined(F.col("code"), F.size(lines)))
    cut = lambda c, inside: F.transform(F.split(c, GAP, -1), lambda x: F.struct(F.lit(inside).alias("in_head"), x.alias("words")))
    none = F.array().cast("array<struct<in_head:boolean,words:string>>")
    parts = F.concat(F.coalesce(cut(head, True), none), F.coalesce(cut(body, False), none))
    rows = rows.select("_file", "path", "named", F.posexplode(F.when(F.col("code") == 1, cut(F.col("_text"), False)).otherwise(parts)).alias("block", "p"))
    found = F.transform(F.split("p.words", "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(TERM), F.lit(0)))
    rows = rows.select("_file", "path", "named", "block", F.col("p.in_head").alias("in_head"), F.filter(found, lambda x: F.size(x) > 0).alias("lines"))
    return rows.where((F.size("lines") > 0) | (F.col("block") == 0))


def needed_terms(weighted: dict[str, float], least: float) -> list[str]:
    """The heaviest terms of a notice, as few as leave less than `least` of its length to the rest."""
    whole = sum(w * w for w in weighted.values())
    rest, out = whole, []
    for t, w in sorted(weighted.items(), key=lambda x: (-x[1], x[0])):
        if rest < least * least * whole:
            break
        out.append(t)
        rest -= w * w
    return out


def lines_with_terms(blocks: DataFrame) -> DataFrame:
    """term, df (lines that hold it), over all lines; the term "" has how many lines there are."""
    lines = blocks.select(F.explode("lines").alias("terms"))
    return lines.select(F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weighted_templates(df: DataFrame) -> tuple[dict[str, list[tuple[str, dict[str, float]]]], int]:
    """The templates that each kind of unit meets, with the weights of their terms, and the number of lines; of `df` come back
    the rows of these terms alone."""
    own = {kind: templates(*sets) for kind, sets in KINDS.items()}
    vocabulary = sorted({t for kind in own.values() for _, terms in kind for t in terms})
    asked = F.broadcast(df.sparkSession.createDataFrame([(t,) for t in [*vocabulary, ""]], "term string"))
    count = {r["term"]: r["df"] for r in df.join(asked, "term").collect()}
    n_lines = count.get("", 0)
    idf = {t: log((1 + n_lines) / (1 + count.get(t, 0))) + 1 for t in vocabulary}
    return {kind: [(name, {t: (1 + log(n)) * idf[t] for t, n in terms.items()}) for name, terms in rows] for kind, rows in own.items()}, n_lines


def candidates(blocks: DataFrame, weighted: dict, least: float) -> DataFrame:
    """The rows of `blocks` with n_words and, in place of all lines, what may be like a template: `some` (line and terms of
    lines with a needed term) and `whole` (all terms of a block that is compared as a whole; else null)."""
    needed = F.array(*[F.lit(t) for t in sorted({t for _, w in weighted["line"] for t in needed_terms(w, least)})])
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("terms")))
    rows = blocks.withColumns({"n_words": F.size(F.flatten("lines")), "several": F.size("lines") > 1, "some": F.filter(numbered, lambda x: F.arrays_overlap(x["terms"], needed))})
    whole = F.col("named") | F.col("in_head") | (F.col("several") & (F.size("some") > 0))
    return rows.withColumn("whole", F.when(whole, F.flatten("lines"))).drop("lines")


def units_like_templates(blocks: DataFrame, df: DataFrame, weighted: dict, n_lines: int, least: float) -> DataFrame:
    """_file, block, line, in_head, kind, words, licence, similarity of the units that are like a template. `blocks` is the
    written table of `candidates`; a header has block -1, a whole file -2, and all but lines have line -1."""
    spark = blocks.sparkSession
    units = blocks.select("_file", "block", "in_head", F.inline("some")).withColumn("kind", F.lit("line"))
    paragraph = F.when(F.col("named"), "licence paragraph").otherwise("paragraph")
    whole = blocks.where("whole is not null").select("_file", "block", F.lit(-1).alias("line"), "in_head", "named", F.col("whole").alias("terms"), (F.col("several") & (F.size("some") > 0)).alias("near"))
    for some, kind, block in [
        (whole.where("named or near"), paragraph, F.col("block")),
        (whole.where("in_head"), F.lit("header"), F.lit(-1)),
        (whole.where("named").withColumn("in_head", F.lit(False)), F.lit("file"), F.lit(-2)),
    ]:
        units = units.unionByName(some.select("_file", block.alias("block"), "line", "in_head", "terms", kind.alias("kind")))
    spread = written(units.select(*UNIT, F.explode("terms").alias("term")).groupBy(*UNIT, "term").agg(F.count("*").alias("tf")), "licence-units")
    df = written(df.join(spread.groupBy("term").agg(F.count("*").alias("n")), "term"), "licence-df")
    weight = (1 + F.log(F.col("tf"))) * (F.log(F.lit(1.0 + n_lines) / (1 + F.col("df"))) + 1)
    unit = join_rows(spread, df, "term").withColumn("w", weight).groupBy(*UNIT).agg(
        F.sum("tf").alias("words"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.collect_list(F.struct("term", "w")).alias("all"))
    rows = [(kind, i, name, t, w, sum(x * x for x in terms.values()) ** 0.5) for kind, all_of in weighted.items() for i, (name, terms) in enumerate(all_of) for t, w in terms.items()]
    template = F.broadcast(spark.createDataFrame(rows, "kind string, template int, licence string, term string, nw double, length double"))
    terms = unit.select(*UNIT, "words", "len", F.inline("all"))
    near = terms.join(template, ["kind", "term"]).groupBy(*UNIT, "words", "len", "template", "licence", "length").agg(F.sum(F.col("w") * F.col("nw")).alias("dot"))
    near = near.withColumn("similarity", F.col("dot") / (F.col("len") * F.col("length"))).where(F.col("similarity") >= least - 1e-12)
    best = near.groupBy(*UNIT, "words").agg(F.min(F.struct((-F.round("similarity", 12)).alias("minus"), "licence")).alias("b"))
    return best.select(*UNIT, "words", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("similarity"))


def stands(wide: Column, parts: Column) -> Column:
    """Whether a unit of similarity `wide` (null: none) stands for its parts, the closest of which has `parts`."""
    return F.coalesce((wide >= WHOLE) | (wide >= F.coalesce(parts, F.lit(0.0))), F.lit(False))


def licences_of_files(units: DataFrame) -> DataFrame:
    """_file, own (sorted licences), n_lines (lines like a notice), n_blocks (wider units like a template), licence_words."""
    line, wide = F.col("kind") == "line", F.col("kind") != "line"
    names = lambda c: F.collect_set(F.when(c, F.col("licence")))
    by = units.groupBy("_file", "block", "in_head").agg(
        F.max(F.when(wide, F.col("similarity"))).alias("wide"), F.max(F.when(line, F.col("similarity"))).alias("narrow"), names(wide).alias("wide_names"), names(line).alias("line_names"),
        F.sum(F.when(wide, F.col("words"))).alias("wide_words"), F.sum(F.when(line, F.col("words"))).alias("line_words"), F.count_if(line).alias("n_lines"), F.count_if(wide).alias("n_blocks"))
    wins = stands(F.col("wide"), F.col("narrow"))
    pick = lambda a, b: F.when(wins, F.col(a)).otherwise(F.col(b))
    by = by.select("_file", "block", "in_head", "n_lines", "n_blocks", pick("wide", "narrow").alias("sim"), pick("wide_names", "line_names").alias("names"), pick("wide_words", "line_words").alias("words"))
    where = {"file": F.col("block") == -2, "head": F.col("block") == -1, "hp": (F.col("block") >= 0) & F.col("in_head"), "bp": (F.col("block") >= 0) & ~F.col("in_head")}
    aggs = [F.sum("n_lines").alias("n_lines"), F.sum("n_blocks").alias("n_blocks")]
    for k, c in where.items():
        aggs += [F.max(F.when(c, F.col("sim"))).alias(f"{k}_sim"), F.flatten(F.collect_set(F.when(c, F.col("names")))).alias(f"{k}_names"), F.coalesce(F.sum(F.when(c, F.col("words"))), F.lit(0)).alias(f"{k}_words")]
    out = by.groupBy("_file").agg(*aggs)
    header = stands(F.col("head_sim"), F.col("hp_sim"))
    of = lambda c, a, b: F.when(c, F.col(a)).otherwise(F.col(b))
    out = out.withColumns({f"top_{x}": of(header, f"head_{x}", f"hp_{x}") for x in ("sim", "names", "words")})
    file = stands(F.col("file_sim"), F.greatest("top_sim", "bp_sim"))
    own = F.when(file, F.col("file_names")).otherwise(F.concat("top_names", "bp_names"))
    words = F.when(file, F.col("file_words")).otherwise(F.col("top_words") + F.col("bp_words"))
    return out.select("_file", F.array_sort(F.array_distinct(own)).alias("own"), "n_lines", "n_blocks", words.alias("licence_words"))


def ancestors(path: Column) -> Column:
    """(depth, directory) of all directories above a path, the root "" at depth 0."""
    parts = F.split(F.regexp_replace(path, "^/+|/[^/]*$", ""), "/+")
    parts = F.when(F.contains(F.regexp_replace(path, "^/+", ""), F.lit("/")), parts).otherwise(F.array().cast("array<string>"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.named_struct(F.lit("depth"), i, F.lit("dir"), F.array_join(F.slice(parts, 1, i), "/")))


def licences(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """Per row of `files`: path, own (sorted array of its licences), n_lines (lines like a notice), n_blocks (paragraphs,
    header and whole file like a template), is_licence_file, inherited (array, null if it has its own or no ancestor
    directory has any), inherited_from (directory).

    Null and empty texts have no lines; a null path is a file in no directory. Rows may share a path.
    """
    # Texts are read twice, for the lines of each term and for the units, rather than all their terms written. Numbers of
    # files are given in the second reading alone.
    every = text_blocks(files, path, text)
    df = written(lines_with_terms(every), "licence-terms", "zstd")
    weighted, n_lines = weighted_templates(df)
    blocks = written(candidates(every, weighted, least), "licence-blocks", "zstd")
    units = written(units_like_templates(blocks, df, weighted, n_lines, least), "licence-found")
    own = licences_of_files(units)
    words = blocks.groupBy("_file").agg(F.first("path").alias("path"), F.first("named").alias("named"), F.sum("n_words").alias("n_words"))
    licensed = F.col("own").isNotNull() & (F.col("named") | (2 * F.col("licence_words") >= F.col("n_words")))
    found = words.join(own, "_file", "left")
    found = written(found.select("_file", "path", "own", "n_lines", "n_blocks", F.coalesce(licensed, F.lit(False)).alias("is_licence_file")), "licences-own")
    above = ancestors(F.col("path"))
    directories = found.where("is_licence_file and path is not null").select(F.element_at(above, -1)["dir"].alias("dir"), F.explode("own").alias("licence"))
    directories = directories.groupBy("dir").agg(F.array_sort(F.collect_set("licence")).alias("licences"))
    # Directories, not files, look for their ancestors, so a directory of many files asks once.
    bare = found.where("own is null and path is not null").withColumn("above", above).withColumn("home", F.element_at("above", -1)["dir"])
    homes = written(bare.groupBy("home").agg(F.first("above").alias("above"), F.count("*").alias("n")), "licence-homes")
    asking = homes.select("home", F.explode("above").alias("a")).select("home", F.col("a.depth").alias("depth"), F.col("a.dir").alias("dir"))
    nearest = asking.join(directories, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "licences")).alias("near"))
    nearest = nearest.select("home", F.col("near.dir").alias("inherited_from"), F.col("near.licences").alias("inherited"))
    nearest = written(homes.select("home", "n").join(nearest, "home", "left"), "licence-inherited")
    others = found.where("own is not null or path is null").withColumn("inherited_from", F.lit(None).cast("string")).withColumn("inherited", F.lit(None).cast("array<string>"))
    out = join_rows(bare.drop("above"), nearest, "home").drop("home").unionByName(others)
    return out.select("path", F.coalesce("own", F.array().cast("array<string>")).alias("own"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), "is_licence_file", "inherited", "inherited_from")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/language/doc_id."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("path"), "text")
    out = licences(files)
    return out.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), F.array_join("own", ",").alias("own"), "n_lines", "n_blocks", "is_licence_file", F.array_join("inherited", ",").alias("inherited"), "inherited_from")
