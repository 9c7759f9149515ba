"""Export: what a copy to a target would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """rel, size, digest of each file."""
    raw = F.col(content).cast("binary")
    return files.select("rel", F.octet_length(raw).alias("size"), F.sha1(raw).alias("digest"))


def file_status(source: DataFrame, target: DataFrame) -> DataFrame:
    """rel, status of each file of either side: added, modified, unchanged or orphaned, by size and digest."""
    s = source.select("rel", F.col("size").alias("s_size"), F.col("digest").alias("s_digest"))
    t = target.select("rel", F.col("size").alias("t_size"), F.col("digest").alias("t_digest"))
    same = (F.col("s_size") == F.col("t_size")) & (F.col("s_digest") == F.col("t_digest"))
    status = F.when(F.col("t_digest").isNull(), "added").when(F.col("s_digest").isNull(), "orphaned").when(same, "unchanged").otherwise("modified")
    return s.join(t, "rel", "full_outer").select("rel", status.alias("status"))


def export_diff(images: DataFrame, captions: DataFrame, target_images: DataFrame, target_captions: DataFrame) -> DataFrame:
    """stem, image_status, caption_status, status of images with a caption, and of orphaned target images.

    All four have (stem, digest). An added image is added whatever its caption is; else either change is one.
    """
    source = images.select("stem", F.col("digest").alias("si")).join(captions.select("stem", F.col("digest").alias("sc")), "stem")
    target = target_images.select("stem", F.col("digest").alias("ti")).join(target_captions.select("stem", F.col("digest").alias("tc")), "stem", "left")
    kind = lambda s, t: F.when(F.col(s).isNull(), "orphaned").when(F.col(t).isNull(), "added").when(F.col(s) == F.col(t), "unchanged").otherwise("modified")
    rows = source.join(target, "stem", "full_outer").select("stem", kind("si", "ti").alias("image_status"), kind("sc", "tc").alias("caption_status"))
    status = F.when(F.col("image_status").isin("added", "orphaned"), F.col("image_status")).when((F.col("image_status") == "unchanged") & (F.col("caption_status") == "unchanged"), "unchanged").otherwise("modified")
    return rows.withColumn("status", status)


def export_counts(diff: DataFrame) -> DataFrame:
    """One row: added, modified, unchanged, orphaned."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "unchanged", "orphaned")])


def to_copy(diff: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Changed entries that aren't excluded, added ones first."""
    changed = diff.filter(F.col("status").isin("added", "modified"))
    if excluded is not None:
        changed = changed.join(excluded.select("stem"), "stem", "left_anti")
    return changed.withColumn("rank", F.when(F.col("status") == "added", 0).otherwise(1))
