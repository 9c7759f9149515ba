"""A corpus from raw documents to shards, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame. Rows are
told apart by their file and place, or, if docs doesn't come from Parquet files, by a number of their own: repeated rows
count each for itself, and null and repeated ids do no harm. Extra columns, whatever their names, are handed on. Texts are
read whole, however long. An empty table gives an empty result. What stages do with null and empty texts they say below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import decontaminate, language_id, mixing, near_dedup, sharding
from framesift.llm.common import bounded, fresh, frozen, read_table, stored, with_row_id

#: Documents that are less probably than this of a language learned, against writing in none of them, are rejected, as are those without letters.
LEAST_SCORE = 0.5
SHARDS = 40


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null and empty ones too, and those of no language that the labelled ones show; without labelled ones all go."""
    row = fresh(docs, "_row")
    numbered = with_row_id(docs, row)
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # only numbers and texts go to Python, and only numbers come back
    found = language_id.predict(numbered.select(F.col(row).alias("row"), "text"), model, keep=("row",))
    rejected = found.filter((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("learned") < LEAST_SCORE)).select(F.col("row").alias(row))
    return numbered.join(bounded(frozen(rejected)), row, "left_anti").select(*_columns(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the first: five words, similarity 0.8. Texts without words, null ones too, are no duplicates and stay."""
    row = fresh(docs, "_row")
    numbered = with_row_id(docs, row)
    dropped = near_dedup.near_duplicates(numbered, near_dedup.Rule(words=5, percent=80), id_col=row).filter("NOT kept").select(F.col("doc_id").alias(row))
    return numbered.join(bounded(frozen(dropped)), row, "left_anti").select(*_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go. Null and empty texts hold nothing and stay; without items all stay."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Texts without words, null ones too, are not taken; null sources are one."""
    row, copies, copy = fresh(docs, "_row"), fresh(docs, "_copies"), fresh(docs, "_copy")
    numbered = with_row_id(docs, row)
    taken = mixing.mixed(numbered, row_col=row).filter("copies > 0").select(row, F.col("copies").alias(copies))
    return numbered.join(bounded(frozen(taken)), row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*_columns(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row, with size and checksum of its text (null: empty) instead of the columns of documents."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Model fits and Newton steps have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
