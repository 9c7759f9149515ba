"""A data set that steps change, as layers over the files that were there first.

A layer says of an image (was: its relative path so far) what stands in its place: a new relative path, the file that has
its content, and its size. Nothing is copied or changed but what a layer made anew; taking a layer away brings back what was before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.order import counted

#: What a layer has besides `was`; path is null for an image that is taken away.
CHANGED = ("rel", "path", "size", "w", "h")


def overlaid(images: DataFrame, layers: Sequence[DataFrame]) -> DataFrame:
    """images (rel and path at least) after all layers, first to last. Images that no layer names stay; columns that images is without aren't added."""
    for layer in layers:
        new = counted(layer.select(F.col("was").alias("_was"), *[F.col(c).alias(f"_{c}") for c in CHANGED]))
        both = images.join(new, images["rel"] == new["_was"], "left").filter("_was IS NULL OR _path IS NOT NULL")
        changed = [F.when(F.col("_was").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in CHANGED else F.col(c) for c in images.columns]
        images = both.select(*changed)
    return images


def united(folders: Sequence[DataFrame]) -> DataFrame:
    """Files of several folders, each with its path; which of them count, a join with the current images says."""
    return reduce(DataFrame.unionByName, folders)
