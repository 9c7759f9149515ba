"""The small files of a run (state, reports) and of captions, on whatever file system Spark reads."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def uri(path: str) -> str:
    """A path as pyarrow's file systems name it."""
    return path if "://" in path else f"file://{Path(path).absolute()}"


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    store, place = _place(spark, path)
    store.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text, null if it isn't there. A file that was being replaced when its writer died is found under its new name."""
    for name in (path, f"{path}.new"):
        store, place = _place(spark, name)
        if store.exists(place):
            stream = store.open(place)
            try:
                return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file, then moves into place."""
    store, fresh = _place(spark, f"{path}.new")
    out = store.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, place = _place(spark, path)
    store.delete(place, False)
    if not store.rename(fresh, place):
        raise OSError(f"{path} can't be written")


def write_lines(spark: SparkSession, path: str, head: str, lines: Iterable[str], tail: str) -> None:
    """head, the lines with commas between them, and tail, as they come; beside the file first, then moved into place."""
    store, fresh = _place(spark, f"{path}.new")
    out = store.create(fresh, True)
    out.write(bytearray(head.encode()))
    for i, line in enumerate(lines):
        out.write(bytearray(f"{',' if i else ''}\n{line}".encode()))
    out.write(bytearray(f"\n{tail}".encode()))
    out.close()
    _, place = _place(spark, path)
    store.delete(place, False)
    if not store.rename(fresh, place):
        raise OSError(f"{path} can't be written")
