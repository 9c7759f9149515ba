"""Outlier gate on high-frequency loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.order import counted


def hf_stats(scores: DataFrame, sigma: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """successful, failed, mean, std (of the population), threshold; null threshold without scores. by: group columns."""
    v = F.col("hf_loss")
    stats = scores.groupBy(*(by or [])).agg(F.count(v).alias("successful"), F.count_if(v.isNull()).alias("failed"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return stats.withColumn("threshold", F.col("mean") + sigma * F.col("std"))


def hf_outliers(scores: DataFrame, sigma: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Adds threshold and outlier (above it, not equal); rows without a score aren't outliers. The statistics are one row for each group."""
    stats = hf_stats(scores, sigma, by).select(*(by or []), "threshold")
    joined = scores.join(counted(stats), by) if by else scores.join(F.broadcast(stats))
    return joined.withColumn("outlier", F.coalesce(F.col("hf_loss") > F.col("threshold"), F.lit(False)))


def apply_drops(rows: DataFrame, decisions: DataFrame, key: str = "path") -> DataFrame:
    """Rows but those with the decision `drop`; any other decision keeps."""
    return rows.join(decisions.filter("decision = 'drop'").select(key), key, "left_anti")
