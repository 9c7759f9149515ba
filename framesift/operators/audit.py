"""Audit of image and caption pairs."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.text import trimmed

#: Characters of a short and a long caption.
SHORT, LONG = 5, 600


def rel_stem(rel: Column) -> Column:
    """A relative path without its suffix: what pairs an image with its caption."""
    return F.regexp_replace(rel, r"\.[^./]*$", "")


def last_by_stem(files: DataFrame) -> DataFrame:
    """stem, rel: of files with one stem, the last by path."""
    return files.groupBy(rel_stem(F.col("rel")).alias("stem")).agg(F.max("rel").alias("rel"))


def pairing(images: DataFrame, captions: DataFrame, key: str = "stem") -> DataFrame:
    """key, status of each: paired, orphan_image or orphan_caption. One full outer join finds all three."""
    left, right = images.select(key).distinct().withColumn("_i", F.lit(1)), captions.select(key).distinct().withColumn("_c", F.lit(1))
    status = F.when(F.col("_c").isNull(), "orphan_image").when(F.col("_i").isNull(), "orphan_caption").otherwise("paired")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def caption_class(text: Column) -> Column:
    """empty, short, long or ok."""
    n = F.length(trimmed(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty").when(n < SHORT, "short").when(n > LONG, "long").otherwise("ok")


def undersized(images: DataFrame, required: int | None) -> DataFrame:
    """Readable images whose short side is below what is required; none if nothing is."""
    if not required:
        return images.limit(0)
    return images.filter(~F.coalesce(F.col("corrupt"), F.lit(False)) & (F.least("w", "h") < required))


def audit_summary(pairs: DataFrame, captions: DataFrame, images: DataFrame, required: int | None = None, off: Collection[str] = ()) -> DataFrame:
    """One row: counts of each issue, the total and whether the audit passes. Short and long captions don't count against it; issues that are off are null and don't either."""
    a = pairs.agg(F.count_if(F.col("status") == "orphan_image").alias("orphan_images"), F.count_if(F.col("status") == "orphan_caption").alias("orphan_captions"), F.count_if(F.col("status") == "paired").alias("paired"))
    kind = caption_class(F.col("text"))
    b = captions.agg(F.count_if(kind == "empty").alias("empty"), F.count_if(kind == "short").alias("short"), F.count_if(kind == "long").alias("long"))
    bad, small = F.coalesce(F.col("corrupt"), F.lit(False)), F.least("w", "h") < (required or 0)
    c = images.agg(F.count_if(bad).alias("corrupt"), F.count_if(~bad & small).alias("undersized"))
    counts = a.join(F.broadcast(b)).join(F.broadcast(c)).withColumns({name: F.lit(None).cast("long") for name in off})
    against = ("orphan_images", "orphan_captions", "corrupt", "empty", "undersized")
    total = reduce(Column.__add__, [F.coalesce(F.col(name), F.lit(0)) for name in against])
    return counts.withColumn("issues", total).withColumn("passed", total == 0)
