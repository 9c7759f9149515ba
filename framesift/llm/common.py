"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='framesift-')}")
    return context.getCheckpointDir().rstrip("/")


def frozen(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """As frozen(), as a compressed table of its own in the shared folder; options are those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed within goes to Python in batches of so many rows at most, so that memory doesn't follow the length of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: Sequence[Column], name: str = "row_number") -> DataFrame:
    """df with 0-based gapless row numbers in the order of keys, and no task that sees all rows.

    Rows are dealt out by range and sorted within each range; the frozen result keeps its partitions, so that
    a row's number is its place in its partition plus the sizes of the partitions before it. One number per
    partition is all that is gathered. Rows equal in all keys get their numbers in any order.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = frozen(dealt.withColumn("_place", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in sizes):
        starts.append((part, total))
        total += n
    table = spark.createDataFrame(starts, "_part long, _start long")
    return (
        placed.withColumn("_part", F.shiftright("_place", 33))
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_place")
    )


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A row's number within its file takes the low bits of its number in the table.
FILE_ROW_BITS = 36


def with_row_id(table: DataFrame, name: str) -> DataFrame:
    """table with a number of its own for each row, the same however often and in whatever splits it is read.

    Splits depend on the cores that are there, so numbers by partition would change when an executor is lost between
    two reads. Here the files, by path, and the rows within them count. A table that doesn't come straight from Parquet
    files is frozen first, and its rows count by partition.
    """
    try:
        if "_metadata" in map(str.lower, table.columns):
            raise AnalysisException("a column of this name hides the file's")
        table.select("_metadata.row_index")
    except AnalysisException:
        return frozen(table).withColumn(name, F.monotonically_increasing_id())
    file, at, number = fresh(table, "_file"), fresh(table, "_at"), fresh(table, "_number")
    paths = table.select(F.col("_metadata.file_path").alias(file)).distinct()
    files = frozen(numbered(paths, [F.col(file)], number))
    placed = table.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    return placed.join(bounded(files), file).withColumn(name, F.shiftleft(number, FILE_ROW_BITS) + F.col(at)).drop(file, at, number)


#: Up to so many rows of numbers (about 16 MB) are sent to all tasks; more are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if its rows, counted, are few enough: BROADCAST_ROWS if not said. df should be frozen, or cheap to count."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df
