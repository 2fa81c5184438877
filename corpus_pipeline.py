"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and reads only what the stage before it kept.
All but the last return the columns of documents. ``run`` writes each stage's result
as Parquet in the shared folder and rereads it, so a lost executor costs one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import common, line_dedup, packing, quality, simhash

#: Name of the row key in the near-duplicate stage.
ROW = "__row"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks shared with earlier documents; a document that loses all its words goes, n_chars follows the text."""
    common.bounded_batches(spark)
    kept = line_dedup.dedup_lines(docs).where((F.col("removed") == 0) | F.col("text").rlike(r"\S"))
    of = {"text": F.col("text"), "n_chars": F.when(F.col("removed") == 0, F.col("d")["n_chars"]).otherwise(F.char_length("text")).cast("long")}
    return kept.select(*[of.get(c, F.col("d")[c]).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the one with the smallest (doc_id, text hash), rows without a doc_id last.

    Rows that share a doc_id but hold texts of different groups all stay; of equal rows one does.
    """
    common.bounded_batches(spark)
    # a key of 25 bytes in the order of (doc_id, text hash): a flag, the id with its sign bit turned, half the hash
    place = F.coalesce(F.concat(F.lit("00"), F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lit("01" + "0" * 16))
    digest = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)
    rows = docs.withColumn(ROW, F.unhex(F.concat(place, digest)))
    first = rows.groupBy(F.substring(ROW, 10, 16).alias("digest")).agg(F.min(ROW).alias(ROW)).select(ROW)
    kinds = common.written(rows.join(first, ROW, "left_semi").dropDuplicates([ROW]), "kinds")
    groups = simhash.components(simhash.near_duplicates(kinds.select(F.col(ROW).alias("node"), "text")))
    return kinds.join(groups.where("node <> root").select(F.col("node").alias(ROW)), ROW, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 4096 tokens."""
    common.bounded_batches(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL expresses the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
