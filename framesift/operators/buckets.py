"""Aspect-ratio buckets: assignment, counts, thin buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.geometry import BUCKETS, crop_suggestion, nearest_bucket

Bucket = tuple[int, int]


def assign_buckets(images: DataFrame, buckets: Sequence[Bucket] = BUCKETS, digits: int | None = None) -> DataFrame:
    """Adds ord, bw, bh, dist of the nearest bucket; rows without a size are left out. The buckets are constants of the expression: nothing is joined."""
    found = images.withColumn("_b", nearest_bucket(F.col("w"), F.col("h"), buckets, digits)).filter(F.col("_b").isNotNull())
    return found.select(*[c for c in images.columns], "_b.ord", "_b.bw", "_b.bh", "_b.dist")


def bucket_table(spark, buckets: Sequence[Bucket] = BUCKETS) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(buckets)], "ord int, bw int, bh int")


def bucket_counts(assigned: DataFrame, buckets: Sequence[Bucket] = BUCKETS) -> DataFrame:
    """bw, bh, n of every bucket, empty ones too."""
    counts = assigned.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bucket_table(assigned.sparkSession, buckets)).join(counts, "ord", "left").select("bw", "bh", F.coalesce("n", F.lit(0)).alias("n"))


def thin_buckets(assigned: DataFrame, threshold: int = 2) -> DataFrame:
    """bw, bh, n, paths, suggestion of buckets with 1 to threshold images. Thin ones are found by their counts first, so only few paths are gathered."""
    thin = assigned.groupBy("bw", "bh").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= threshold)
    few = assigned.join(F.broadcast(thin), ["bw", "bh"]).withColumn("crop", crop_suggestion(F.col("w"), F.col("h"), F.col("bw"), F.col("bh")))
    rows = few.groupBy("bw", "bh", "n").agg(F.array_sort(F.collect_list(F.struct("path", "crop"))).alias("rows"))
    return rows.select("bw", "bh", "n", F.transform("rows", lambda r: r["path"]).alias("paths"), F.array_join(F.array_distinct(F.transform("rows", lambda r: r["crop"])), "; ").alias("suggestion"))


def bucket_status(counts: DataFrame, threshold: int = 2) -> DataFrame:
    """Adds status: empty, thin or healthy."""
    return counts.withColumn("status", F.when(F.col("n") == 0, "empty").when(F.col("n") <= threshold, "thin").otherwise("healthy"))


def bucket_summary(counts: DataFrame, threshold: int = 2) -> DataFrame:
    """One row: total, populated, thin, images."""
    n = F.col("n")
    return counts.agg(F.count(F.lit(1)).alias("total"), F.count_if(n > 0).alias("populated"), F.count_if((n > 0) & (n <= threshold)).alias("thin"), F.sum(n).alias("images"))


def cache_info(counts: DataFrame) -> DataFrame:
    """One row of JSON, `WxH` to count, of the buckets in use."""
    used = counts.filter("n > 0").select(F.format_string("%dx%d", "bw", "bh").alias("bucket"), "n")
    return used.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n"))))).alias("cache_info"))
