"""Upscale planning: actions, name collisions, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.geometry import downscale_divisor

#: Target and highlight sizes, and the least similarity of an upscaled image.
TARGET, HIGHLIGHT, LEAST_SSIM = 3072, 1536, 0.60


def is_jpeg(path: Column) -> Column:
    return F.lower(path).rlike(r"\.jpe?g$")


def planned_dest(path: Column, action: Column) -> Column:
    """A JPEG that is worked on becomes a PNG; what passes through keeps its name."""
    return F.when((action != "pass_through") & is_jpeg(path), F.regexp_replace(path, r"\.[^./]*$", ".png")).otherwise(path)


def scratch_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)$", ".upscaling.tmp$1")


def upscale_plan(images: DataFrame, target: int = TARGET, highlight: int = HIGHLIGHT, generative: bool = True) -> DataFrame:
    """Adds min_side, is_jpeg, needs_pre_downscale, planned_action, flagged to (path, w, h). Without a size nothing is planned or flagged."""
    side = F.least("w", "h")
    jpeg = is_jpeg(F.col("path"))
    pre = F.coalesce(jpeg & (side >= highlight) & F.lit(generative), F.lit(False))
    action = F.when(side < target, "upscale").when(pre, "jpeg_cleanup").otherwise("pass_through")
    return (
        images.withColumn("min_side", side)
        .withColumn("is_jpeg", jpeg)
        .withColumn("needs_pre_downscale", pre)
        .withColumn("planned_action", action)
        .withColumn("flagged", F.coalesce(side <= highlight, F.lit(False)) | pre)
    )


def guard_collisions(plan: DataFrame) -> DataFrame:
    """JPEGs whose new name another image has too pass through instead, unflagged; adds dest and collides."""
    with_dest = plan.withColumn("dest", planned_dest(F.col("path"), F.col("planned_action")))
    clash = (F.count(F.lit(1)).over(Window.partitionBy("dest")) > 1) & F.col("is_jpeg") & (F.col("planned_action") != "pass_through")
    out = with_dest.withColumn("collides", clash)
    return (
        out.withColumn("planned_action", F.when(F.col("collides"), "pass_through").otherwise(F.col("planned_action")))
        .withColumn("flagged", F.col("flagged") & ~F.col("collides"))
        .withColumn("dest", planned_dest(F.col("path"), F.col("planned_action")))
    )


def review(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """A reviewer's `skip` lets an image pass through. A column `decision` of the plan, an earlier gate's, stays as it is."""
    said = plan.join(decisions.select("path", F.col("decision").alias("_said")), "path", "left")
    skip = F.coalesce(F.col("_said") == "skip", F.lit(False))
    return said.withColumn("planned_action", F.when(skip, "pass_through").otherwise(F.col("planned_action"))).drop("_said")


def outcomes(candidates: DataFrame, least_ssim: float = LEAST_SSIM) -> DataFrame:
    """Adds outcome to (path, ssim, error): upscaled, rejected_post, or skipped; failures keep the original."""
    return candidates.withColumn("outcome", F.when(F.col("error").isNotNull() | F.col("ssim").isNull(), "skipped").when(F.col("ssim") < least_ssim, "rejected_post").otherwise("upscaled"))


def cleanup_groups(plan: DataFrame, target: int = TARGET) -> DataFrame:
    """Images to clean up by the size they go back to: target_side, n, divisor counts."""
    jobs = plan.filter("planned_action = 'jpeg_cleanup' OR (planned_action = 'upscale' AND needs_pre_downscale)")
    return jobs.groupBy(F.greatest(F.lit(target), F.col("min_side")).alias("target_side")).agg(F.count(F.lit(1)).alias("n"), F.count_if(downscale_divisor(F.col("min_side")) == 2).alias("by_two"))


#: A model for one size: gives the PNG and its likeness to the original for an image (a row as a dict).
SizedModel = Callable[[dict[str, Any]], tuple[bytes, float]]


def upscaled_by_target(rows: DataFrame, build: Callable[[int], SizedModel], target: int = TARGET) -> DataFrame:
    """path, content, ssim, error of planned images, with a model built once for each size that they go to, in each task that has some of that size.

    An image goes to the target, or to its own short side if that is larger. Rows are dealt out and sorted by that size, then path, so
    that a size with most of the images is spread over tasks, and a task has a few sizes one after the other. An image that
    fails, or whose model can't be built, has an error.
    """
    columns = [c for c in rows.columns if c != "target_side"]
    sized = rows.select(F.greatest(F.lit(target), F.col("min_side")).cast("long").alias("target_side"), *[F.col(f"`{c}`") for c in columns])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "path string, content binary, ssim double, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, why = None, None, ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["target_side"] != now:
                    now, model, why = row["target_side"], None, ""
                    try:
                        model = build(now)
                    except Exception as e:  # each of its images says so
                        why = f"no model: {e}"[:200]
                try:
                    out.append((row["path"], None, None, why) if model is None else (row["path"], *model(row), None))
                except Exception as e:  # a row with an error, not a failed job
                    out.append((row["path"], None, None, str(e)[:200]))
            kinds = (pa.string(), pa.binary(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "content", "ssim", "error"])

    return sized.repartitionByRange(parts, "target_side", "path").sortWithinPartitions("target_side", "path").mapInArrow(run, schema)


def attention(images: DataFrame, threshold: int = HIGHLIGHT, cap: int = 5000) -> DataFrame:
    """One row over the first cap images by path: scanned, undersized, jpeg, recommended."""
    first = images.orderBy("path").limit(cap)
    small, jpeg = F.count_if(F.least("w", "h") <= threshold), F.count_if(is_jpeg(F.col("path")))
    return first.agg(F.count(F.lit(1)).alias("scanned"), small.alias("undersized"), jpeg.alias("jpeg")).withColumn("recommended", (F.col("undersized") > 0) | (F.col("jpeg") > 0))
