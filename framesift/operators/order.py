"""Row numbers over a whole table, without a task that sees all of it; and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> str:
    """The folder that the cluster names, in tests a temporary one."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='framesift-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Computed once, in the folder that checkpoints() gives."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As kept(), as a table of its own. For loops: a checkpoint hands the constraints of its plan on, and over rounds these multiply."""
    spark = df.sparkSession
    path = f"{checkpoints(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are sent to all tasks at most, about 16 MB of numbers.
BROADCAST_ROWS = 500_000


def counted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if its rows, counted, are few enough (BROADCAST_ROWS); else a join with it is a shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def scan_order(rows: DataFrame, keys: Sequence[Column], name: str = "ord") -> DataFrame:
    """Adds the place of each row (from 0) in the order of keys: sorted by range, then numbered within each range from where the one before ends."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy(F.shiftright("_at", 33)).count().collect())
    starts = [(part, sum(n for _, n in sizes[:i])) for i, (part, _) in enumerate(sizes)]
    table = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    numbered = placed.join(table, F.shiftright("_at", 33) == F.col("_part")).withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_at", "_part", "_start")
