"""Files and verdicts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from framesift.operators.ledger import ENTRY, upsert
from framesift.sources.files import is_image, plain_path, relative


def image_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """path, rel, size, modified, content of images below root as they arrive, some files at a time."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    path = plain_path(F.col("path"))
    return rows.select(path.alias("path"), relative(path, root).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").filter(is_image(F.col("path")))


def maintain_ledger(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest verdict of each path in folder, a new version for each batch; a batch that runs again writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/version={number - 1}") if number else spark.createDataFrame([], batch.select("path", *ENTRY).schema)
        upsert(before, batch).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict_rates(records: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Verdicts by window of event time `ts`; what is later than `late` is left out."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", window), "verdict").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "verdict", "n")
