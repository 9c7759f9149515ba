"""Caption work lists, edits and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.text import length_ok, token_present, trimmed

ARTIFACT_PREFIX = "region__"
#: A spot check counts rows by so many bits of their hash, on the driver.
SLOT_BITS = 14


def is_artifact(path: Column, prefix: str = ARTIFACT_PREFIX) -> Column:
    return F.startswith(F.substring_index(path, "/", -1), F.lit(prefix))


def artifact_stem(stem: Column, number: Column, prefix: str = ARTIFACT_PREFIX) -> Column:
    return F.concat(F.lit(prefix), stem, F.format_string("__%02d", number))


def verifiable(images: DataFrame, captions: DataFrame, most: int | None = None, prefix: str = ARTIFACT_PREFIX) -> DataFrame:
    """Images with a caption that aren't region crops, the first by path."""
    rows = images.filter(~is_artifact(F.col("path"), prefix)).join(captions.select("stem", "text"), "stem")
    return rows if most is None else rows.orderBy("path").limit(most)


def pending(rows: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows of (path, caption, flagged) to be captioned: all, or those without a caption or with a flagged one."""
    return rows if overwrite else rows.filter(F.col("caption").isNull() | F.coalesce(F.col("flagged"), F.lit(False)))


def caption_action(has_caption: Column, skipped: Column, labels: Column, overwrite: Column) -> Column:
    """keep, caption_plain or caption_regions: what to do with an image once its regions are decided."""
    skip = F.coalesce(skipped, F.lit(True))
    return F.when(skip & has_caption & ~overwrite, "keep").when(skip | (F.coalesce(F.size(labels), F.lit(0)) <= 0), "caption_plain").otherwise("caption_regions")


def resolved_path(path: Column) -> Column:
    """A path without empty parts, `.` and `..`, as the file system would follow it."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(walked, "/"))


def classify_edits(edits: DataFrame, current: DataFrame, root: str, prefix: str = ARTIFACT_PREFIX) -> DataFrame:
    """path, place, outcome, reason, before, after of edits (path, text): rejected with a reason, unchanged, or applied.

    place is the path resolved; it decides what is inside of root and which image is meant. current has (path, caption),
    a null caption for an image without.
    """
    known = current.select(F.col("path").alias("place"), F.coalesce("caption", F.lit("")).alias("before"))
    rows = edits.withColumn("place", resolved_path(F.col("path"))).join(known, "place", "left")
    after = trimmed(F.coalesce("text", F.lit("")))
    reason = (
        F.when(~F.startswith(F.col("place"), F.lit(root.rstrip("/") + "/")), "outside_root")
        .when(is_artifact(F.col("place"), prefix), "region_artifact")
        .when(F.col("before").isNull(), "missing")
        .when(F.length(after) == 0, "empty")
    )
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("after") == trimmed(F.col("before")), "unchanged").otherwise("applied")
    return rows.withColumn("after", after).withColumn("reason", reason).withColumn("outcome", outcome).select("path", "place", "outcome", "reason", "before", "after")


def caption_checks(captions: DataFrame, token: str | None, style_mode: bool = False) -> DataFrame:
    """Adds missing_token, out_of_bounds to (path, caption)."""
    missing = F.lit(False) if style_mode or not token else ~token_present(F.col("caption"), F.lit(token))
    return captions.withColumn("missing_token", missing).withColumn("out_of_bounds", ~length_ok(F.col("caption")))


def spot_check(rows: DataFrame, share: float, seed: int = 0, key: str = "path") -> DataFrame:
    """A sample of max(1, int(n * share)) rows, the same for the same seed: those of the least hashes.

    Hashes fall into slots; whole slots are taken or not by a filter, and only the slot at the border is sorted.
    """
    placed = rows.withColumn("_slot", F.shiftright(F.xxhash64(key, F.lit(seed)), 64 - SLOT_BITS))
    sizes = sorted((r["_slot"], r["count"]) for r in placed.groupBy("_slot").count().collect())
    left = max(1, int(sum(n for _, n in sizes) * share))
    for slot, n in sizes:
        if n > left:
            border = placed.filter(F.col("_slot") == slot).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(left)
            return placed.filter(F.col("_slot") < slot).unionByName(border).drop("_slot")
        left -= n
    return rows


def pass_tally(images: DataFrame) -> DataFrame:
    """stage, n: how often each stage ran, over images with an array of the stages that each took (passes)."""
    return images.select(F.explode("passes").alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def last_n(rows: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def parse_boxes(sidecars: DataFrame, column: str = "json") -> DataFrame:
    """Replaces a JSON list of boxes by boxes: an array of those with four numeric corners, empty for broken JSON."""
    schema = "array<struct<x1:string,y1:string,x2:string,y2:string,label:string,crop_name:string>>"
    number = lambda b, k: b[k].try_cast("double")
    parsed = F.transform(F.coalesce(F.from_json(column, schema, {"mode": "PERMISSIVE"}), F.array().cast(schema)), lambda b: F.struct(*[number(b, k).alias(k) for k in ("x1", "y1", "x2", "y2")], F.coalesce(b["label"], F.lit("")).alias("label"), b["crop_name"].alias("crop_name")))
    whole = F.filter(parsed, lambda b: b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull())
    return sidecars.withColumn("boxes", whole).drop(column)


def boxes_json(boxes: Column) -> Column:
    """Boxes as a JSON list; null for none, whose sidecar is deleted."""
    return F.when(F.size(boxes) > 0, F.to_json(boxes))
