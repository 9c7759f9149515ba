"""Regions of images: their numbers, names, captions and sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.text import normalize_region_caption, trimmed
from framesift.operators.captions import ARTIFACT_PREFIX, artifact_stem, boxes_json


def _beside(stem: Column, name: Column) -> Column:
    """A file name in the folder of stem."""
    return F.concat(F.regexp_extract(stem, "^(.*/)?", 0), name)


def numbered_regions(regions: DataFrame, crops: DataFrame, prefix: str = ARTIFACT_PREFIX) -> DataFrame:
    """Adds number and crop (the stem of its files) to (stem, seq): numbers go on from the crops (stem) that an image has already."""
    there = crops.groupBy("stem").agg(F.count(F.lit(1)).alias("_there"))
    place = F.row_number().over(Window.partitionBy("stem").orderBy("seq"))
    rows = regions.withColumn("_place", place).join(there, "stem", "left")
    number = (F.coalesce("_there", F.lit(0)) + F.col("_place")).cast("int")
    name = artifact_stem(F.substring_index("stem", "/", -1), F.col("number"), prefix)
    return rows.withColumn("number", number).withColumn("crop", _beside(F.col("stem"), name)).drop("_there", "_place")


def region_captions(edits: DataFrame, token: str | None) -> DataFrame:
    """rel, text of the caption files that edits (crop, label) write anew: those of a captioned region with a label, cleaned."""
    label = trimmed(F.coalesce("label", F.lit("")))
    rows = edits.filter(F.col("crop").isNotNull() & (F.length(label) > 0))
    return rows.select(F.concat("crop", F.lit(".txt")).alias("rel"), normalize_region_caption(F.col("label"), F.lit(token)).alias("text"))


def sidecars(boxes: DataFrame, prefix: str = ARTIFACT_PREFIX) -> DataFrame:
    """rel, text of the sidecar of each image of (stem, boxes); text is null where there is no box, and the file goes."""
    name = F.concat(F.lit(prefix), F.substring_index("stem", "/", -1), F.lit("__boxes.json"))
    return boxes.select(_beside(F.col("stem"), name).alias("rel"), boxes_json(F.col("boxes")).alias("text"))
