"""The verdict ledger: a keyed table of what reviewers said of captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.text import trimmed

VERDICTS = ["correct", "generic", "wrong"]
DEFAULT = "correct"
ENTRY = ["verdict", "caption", "resolved", "seq"]


def flagged(verdict: Column, resolved: Column) -> Column:
    return verdict.isin("generic", "wrong") & ~F.coalesce(resolved, F.lit(False))


def upsert(ledger: DataFrame, records: DataFrame, key: str = "path") -> DataFrame:
    """The latest entry of each key; records with an unknown verdict change nothing. Aggregated by key, so that a hot key is merged before it is dealt out."""
    rows = ledger.select(key, *ENTRY).unionByName(records.filter(F.col("verdict").isin(VERDICTS)).select(key, *ENTRY))
    last = F.max(F.struct("seq", "verdict", "caption", "resolved")).alias("e")
    return rows.groupBy(key).agg(last).select(key, "e.verdict", "e.caption", "e.resolved", "e.seq")


def mark_resolved(ledger: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """ledger with the entries of keys resolved; changed tells which were open before. Inserts nothing."""
    hits = ledger.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changed = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("resolved")
    return hits.withColumn("changed", changed).withColumn("resolved", F.col("resolved") | F.col("changed")).drop("_hit")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def match(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """items with verdict, caption_at_verdict, resolved, matched_by: the entry of the same path, else the only one of the same file name."""
    entries = ledger.select(F.col("path").alias("_path"), F.col("verdict"), F.col("caption").alias("caption_at_verdict"), "resolved")
    by_name = entries.groupBy(basename(F.col("_path")).alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("verdict", "caption_at_verdict", "resolved")).alias("_alone")).filter("_n = 1")
    exact = entries.select("_path", F.struct("verdict", "caption_at_verdict", "resolved").alias("_exact"))
    rows = items.join(exact, F.col("path") == F.col("_path"), "left").join(by_name, basename(F.col("path")) == F.col("_name"), "left")
    entry = F.coalesce("_exact", "_alone")
    how = F.when(F.col("_exact").isNotNull(), "path").when(F.col("_alone").isNotNull(), "name")
    return rows.withColumn("_e", entry).withColumn("matched_by", how).select(*items.columns, "_e.verdict", "_e.caption_at_verdict", "_e.resolved", "matched_by")


def seed_verdicts(matched: DataFrame) -> DataFrame:
    """Adds initial_verdict: what was said of the caption as it is now and still stands, else the default."""
    stale = F.col("verdict").isNull() | F.coalesce(F.col("resolved"), F.lit(False)) | (trimmed(F.coalesce("caption_at_verdict", F.lit(""))) != trimmed(F.coalesce("caption", F.lit(""))))
    return matched.withColumn("initial_verdict", F.when(stale, DEFAULT).otherwise(F.col("verdict")))


def record_results(items: DataFrame, results: DataFrame, applied: DataFrame) -> DataFrame:
    """path, verdict, caption, resolved of judged items: one edited in the same review is resolved, with the new caption."""
    judged = items.join(results.filter(F.col("verdict").isin(VERDICTS)).select("path", "verdict"), "path").join(applied.select("path", "after"), "path", "left")
    return judged.select("path", "verdict", F.coalesce("after", "caption", F.lit("")).alias("caption"), F.col("after").isNotNull().alias("resolved"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    """One row: images, verified, unverified and each verdict's number."""
    v = F.col("verdict")
    return rows.agg(F.count(F.lit(1)).alias("images"), F.count(v).alias("verified"), F.count_if(v.isNull()).alias("unverified"), *[F.count_if(v == x).alias(x) for x in VERDICTS])
