"""Image folders, caption files and their JSON records as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions.text import trimmed
from framesift.operators import audit, captions
from framesift.operators.order import kept
from framesift.sources import store
from framesift.sources.store import uri

#: Suffixes of images.
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif"]
PNG_MAGIC = "89504E470D0A1A0A"


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def is_image(path: Column) -> Column:
    return F.lower(suffix(path)).isin(EXTENSIONS)


def plain_path(uri: Column) -> Column:
    """A path without the scheme, decoded."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B")))


def relative(path: Column, root: str) -> Column:
    """The part of a path below root; null outside of it."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1)))


def path_order(rel: Column) -> Column:
    """Sorts by path parts, as path objects compare."""
    return F.split(rel, "/")


def _files(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = plain_path(F.col("path"))
    return rows.select(path.alias("path"), relative(path, root).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def scan_images(spark: SparkSession, root: str, case_sensitive: bool = False) -> DataFrame:
    """path, rel, ext, size, modified, content of all images below root; suffixes in any case, or as an import sees them in lower case only."""
    ext = suffix(F.col("path"))
    return _files(spark, root).withColumn("ext", ext).filter((ext if case_sensitive else F.lower(ext)).isin(EXTENSIONS))


def png_size(content: Column) -> Column:
    """(w, h) of a PNG from its header; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == PNG_MAGIC, F.struct(number(17).alias("w"), number(21).alias("h")))


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, w, h, channels, data (rows of BGR bytes), corrupt; what can't be read is corrupt and has no size."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")
    path = plain_path(F.col("origin"))
    bad = F.col("width") < 0
    out = rows.select(path.alias("path"), relative(path, root).alias("rel"), F.when(~bad, F.col("width")).alias("w"), F.when(~bad, F.col("height")).alias("h"), F.when(~bad, F.col("nChannels")).alias("channels"), F.when(~bad, F.col("data")).alias("data"), bad.alias("corrupt"))
    return out.filter(is_image(F.col("path")))


def read_captions(spark: SparkSession, root: str) -> DataFrame:
    """rel, stem, text of all .txt files below root, trimmed."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("uri"))
    rel = relative(plain_path(F.col("uri")), root)
    return rows.select(rel.alias("rel"), F.regexp_replace(rel, r"\.[^./]*$", "").alias("stem"), trimmed(F.col("value")).alias("text"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """path, verdict, caption, resolved, updated_at from a ledger in JSON, wrapped or flat; broken files and unknown verdicts give no rows."""
    entry = "map<string,struct<verdict:string,caption_at_verdict:string,updated_at:string,resolved:boolean>>"
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<version:int,entries:{entry}>")["entries"]
    entries = F.coalesce(wrapped, F.from_json("value", entry))
    rows = raw.select(F.explode(entries).alias("path", "e"))
    return rows.filter(F.col("e.verdict").isin("correct", "generic", "wrong")).select("path", "e.verdict", F.col("e.caption_at_verdict").alias("caption"), F.coalesce("e.resolved", F.lit(False)).alias("resolved"), "e.updated_at")


def read_run_state(spark: SparkSession, path: str) -> DataFrame:
    """step, status, completed_at, reason, outcome of a run-state file."""
    fields = "map<string,struct<status:string,completed_at:string,reason:string,outcome:string>>"
    steps = F.from_json("value", f"struct<steps:{fields}>")["steps"]
    return spark.read.text(path, wholetext=True).select(F.explode(steps).alias("step", "s")).select("step", "s.*")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_captions(captions: DataFrame, folder: str) -> None:
    """(rel, text) as a table of JSON lines, in one atomic step."""
    captions.select("rel", "text").write.mode("overwrite").json(folder)


def write_caption_files(captions: DataFrame, target: str) -> DataFrame:
    """A .txt file for each of (rel, text), in place of what is there, each moved into place when whole; rel, copied."""
    return copy_files(captions.select("rel", F.col("text").cast("binary").alias("content")), target, overwrite=True)


def apply_caption_edits(spark: SparkSession, edits: DataFrame, root: str, backup: str | None = None) -> DataFrame:
    """Writes applied edits (path, text) to the caption files of root; path, outcome, reason, before, after of each, as classify_edits() gives them.

    The texts stay as typed, but for white space at the ends. A caption is kept in backup before its first change.
    """
    images = scan_images(spark, root).filter(F.col("rel").isNotNull()).select("path", audit.rel_stem(F.col("rel")).alias("stem"))
    before = images.join(read_captions(spark, root).select("stem", F.col("text").alias("caption")), "stem", "left")
    # nothing is read again once files change
    judged = kept(captions.classify_edits(edits, before.select("path", "caption"), root))
    changed = kept(judged.filter("outcome = 'applied'").join(before.select(F.col("path").alias("place"), "stem", "caption"), "place").select(F.concat("stem", F.lit(".txt")).alias("rel"), "after", "caption"))
    if backup is not None:
        old = changed.filter(F.col("caption").isNotNull()).select("rel", F.col("caption").cast("binary").alias("content"))
        copy_files(old, uri(backup)).count()
    write_caption_files(changed.select("rel", F.col("after").alias("text")), uri(root)).count()
    return judged.drop("place")


def write_sidecars(sidecars: DataFrame, target: str) -> DataFrame:
    """Writes (rel, text) below target; a null text deletes the file. rel, copied."""
    return copy_files(sidecars.select("rel", F.col("text").cast("binary").alias("content")), target, overwrite=True)


def write_report(report: DataFrame, folder: str) -> None:
    """A report of one row as JSON."""
    report.coalesce(1).write.mode("overwrite").json(folder)


#: Suffixes of weight files, the better kind first, and the index of a model's components.
WEIGHTS, MODEL_INDEX = (".safetensors", ".bin"), "model_index.json"


def weight_components(spark: SparkSession, root: str, skip: Collection[str] = ()) -> DataFrame:
    """ord, component, size, so_far: bytes of each component of a model below root, in the order that its index names them, and of all up to it.

    A component has one kind of weight file that counts, and of each shard one variant, the plain one if it is there; names that begin
    with `_` and those to skip don't count. Without an index that can be read, or without any weights, there is no row. No file's content is read.
    """
    try:
        index = json.loads(store.read_text(spark, f"{root}/{MODEL_INDEX}") or "")
    except ValueError:
        index = None
    names = [n for n in index if not n.startswith("_") and n not in skip] if isinstance(index, dict) else []
    table = spark.createDataFrame(list(enumerate(names)), "ord int, component string")
    path = plain_path(F.col("path"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(relative(path, plain_root(root)).alias("rel"), F.col("length").alias("size"))
    parts = F.split("rel", "/")
    kind = F.when(F.endswith("rel", F.lit(WEIGHTS[0])), 0).when(F.endswith("rel", F.lit(WEIGHTS[1])), 1)
    files = found.filter(F.size(parts) == 2).select(parts[0].alias("component"), parts[1].alias("name"), kind.alias("kind"), "size").filter("kind IS NOT NULL")
    best = files.groupBy("component").agg(F.min("kind").alias("kind"))
    bare = F.regexp_replace("name", r"\.[^.]*$", "")
    shard, variant = F.substring_index(bare, ".", 1), F.contains(bare, F.lit("."))
    one = files.join(best, ["component", "kind"]).groupBy("component", shard.alias("shard")).agg(F.min(F.struct(variant.alias("variant"), "name", "size"))["size"].alias("size"))
    sizes = table.join(one.groupBy("component").agg(F.sum("size").alias("size")), "component", "left").select("ord", "component", F.coalesce("size", F.lit(0)).alias("size"))
    # a row for each component: few
    all_of = sizes.withColumn("so_far", F.sum("size").over(Window.orderBy("ord"))).withColumn("total", F.sum("size").over(Window.partitionBy()))
    return all_of.filter("total > 0").drop("total")


def plain_root(root: str) -> str:
    """A folder without its scheme, as plain_path() gives those of files."""
    return re.sub("^[a-z0-9]+:/+", "/", root)


def copy_files(rows: DataFrame, target: str, overwrite: bool = False) -> DataFrame:
    """Writes content of (rel, content) below target, whatever file system that is on; rel, copied.

    A file that is there stays unless overwrite is set; then null content deletes it. A rel that leads out of target, or
    nowhere, is refused: nothing is written, and copied is false. Lazy, as all of Spark: the files are written when the
    result is counted or stored. A task that runs again writes the same files, each attempt under a name of its own until the file is whole.
    """
    import posixpath

    import pyarrow as pa
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches):  # noqa: ANN001, ANN202
        store, root = fs.FileSystem.from_uri(target)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            done = []
            for rel, content in zip(batch.column("rel"), batch.column("content"), strict=True):
                inside = posixpath.normpath(rel.as_py() or ".")
                if inside.startswith(("/", "../")) or inside in (".", ".."):
                    done.append(False)
                    continue
                at = f"{root}/{inside}"
                fresh = overwrite or store.get_file_info(at).type == fs.FileType.NotFound
                if fresh and content.as_py() is None:
                    if store.get_file_info(at).type != fs.FileType.NotFound:
                        store.delete_file(at)
                elif fresh:
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    part = f"{at}.{attempt}.part"
                    with store.open_output_stream(part, compression=None) as out:
                        out.write(content.as_py())
                    store.move(part, at)
                done.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column("rel"), pa.array(done)], names=["rel", "copied"])

    return rows.select("rel", "content").mapInArrow(run, "rel string, copied boolean")
