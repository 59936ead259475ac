"""A corpus from documents: quality, lines, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last give the columns
of documents. `run` writes each stage as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import contamination, line_index, passage_classifier, simhash, token_ids
from rankloom.llm.common import batch_rows, join_rows, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of the near-duplicate stage, and texts in an Arrow batch of the decontamination.
SHINGLE, TEXT_ROWS = 5, 2000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents' labels, doesn't reject."""
    model = passage_classifier.train(docs, table(spark, sf_dir, "labels"))
    return passage_classifier.kept(docs.select(*COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are gone; n_chars follows the text. No document goes."""
    out = line_index.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, a number of each row, written: rows are told apart by it where doc_ids repeat or lack."""
    return written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingle similarity >= 4/5, chained) the row of the smallest doc_id; of rows that share
    it one, and rows without a doc_id only in groups of no other."""
    rows = numbered(docs)
    groups = simhash.similar(rows.select(F.col("_row").alias("doc_id"), "text"), SHINGLE)
    placed = rows.select("_row", "doc_id").join(groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("x")
    several = placed.groupBy("component_id").agg(F.count("*").alias("n"), first).where("n > 1").select("component_id", "n", F.col("x._row").alias("stays"))
    others = join_rows(placed.select("_row", "component_id"), written(several, "near-duplicate-groups"), "component_id").where("_row <> stays").select("_row")
    return rows.join(others, "_row", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; another row of the same doc_id, or a lacking one, changes nothing."""
    rows = numbered(docs)
    with batch_rows(spark, TEXT_ROWS):
        found = contamination.contamination(rows, table(spark, sf_dir, "benchmark"), key="_row")
        hit = written(found.where("n_hit > 0").select("_row"), "contaminated-rows")
    return rows.join(hit, "_row", "left_anti").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of the texts that are left."""
    return token_ids.encode_ids(docs, token_ids.default_vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: The classifier can't be written as SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
