"""The verdict ledger as a log-structured table: delta files, a manifest that names them, compaction.

A batch of records is written as one delta, and then a manifest that names it beside those before is moved into place. So a
batch costs what the batch is, readers see all of it or nothing, and a batch that runs again finds its number in the manifest and
changes nothing. Reading takes the latest sequence number of each path over all deltas. When there are many deltas they are merged, those of
one size at a time, so that each record is rewritten about as often as the logarithm of the number of batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from framesift.operators.ledger import ENTRY, VERDICTS, upsert
from framesift.sources import store

SCHEMA = "path string, verdict string, caption string, resolved boolean, seq long"
#: Deltas of one level that are merged into one of the next.
FANOUT = 8
#: Files of a merged delta at most, for each level.
FILES = 8


class LedgerLog:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout

    def manifest(self) -> dict:
        """deltas: [name, level] each, oldest first; batches: the greatest batch number of each stream that is in."""
        text = store.read_text(self.spark, f"{self.folder}/manifest.json")
        return json.loads(text) if text else {"deltas": [], "batches": {}}

    def _swap(self, manifest: dict) -> None:
        store.write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(manifest))

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"delta-{level}-{uuid.uuid4().hex}"
        rows.coalesce(FILES * (level + 1)).write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in names])

    def append(self, records: DataFrame, stream: str = "", number: int | None = None) -> bool:
        """Adds records (path, verdict, caption, resolved, seq); whether anything was added. A batch of a stream that is in already, by its number, isn't.

        Records with an unknown verdict change nothing; of a path's records the one with the greatest seq counts.
        """
        manifest = self.manifest()
        if number is not None and number <= manifest["batches"].get(stream, -1):
            return False
        none = self.spark.createDataFrame([], SCHEMA)
        delta = self._write(upsert(none, records), 0)
        manifest["deltas"].append([delta, 0])
        if number is not None:
            manifest["batches"][stream] = number
        self._swap(manifest)
        self.compact(manifest)
        return True

    def compact(self, manifest: dict | None = None) -> None:
        """Merges deltas of a level once there are fanout of them. Old files go after the manifest is without them."""
        manifest = manifest or self.manifest()
        level = 0
        while (full := [n for n, k in manifest["deltas"] if k == level]) and len(full) >= self.fanout:
            none = self.spark.createDataFrame([], SCHEMA)
            merged = self._write(upsert(none, self._read(full)), level + 1)
            manifest["deltas"] = [d for d in manifest["deltas"] if d[0] not in full] + [[merged, level + 1]]
            self._swap(manifest)
            for name in full:
                store.delete(self.spark, f"{self.folder}/{name}")
            level += 1

    def entries(self) -> DataFrame:
        """path, verdict, caption, resolved, seq: the latest of each path."""
        return upsert(self.spark.createDataFrame([], SCHEMA), self._read([n for n, _ in self.manifest()["deltas"]]))

    def resolve(self, paths: DataFrame, seq: int) -> None:
        """Marks the entries of paths as resolved, as records of their own with the sequence number given."""
        open_ = self.entries().join(paths.select("path").distinct(), "path", "left_semi").filter("NOT coalesce(resolved, false)")
        self.append(open_.withColumn("resolved", F.lit(True)).withColumn("seq", F.lit(seq).cast("long")))

    def to_json(self, path: str) -> None:
        """The ledger as one JSON document, {version, entries: {path: ...}}, moved into place when whole.

        Entries are rendered and sorted as rows, and stream through the driver one partition at a time.
        """
        entry = F.to_json(F.struct(F.col("verdict"), F.coalesce("caption", F.lit("")).alias("caption_at_verdict"), F.coalesce("resolved", F.lit(False)).alias("resolved"), F.col("seq").cast("string").alias("updated_at")))
        key = F.to_json(F.struct(F.col("path").alias("k")))
        lines = self.entries().filter(F.col("path").isNotNull() & F.col("verdict").isin(VERDICTS)).orderBy("path").select(F.concat(F.substr(key, F.lit(6), F.length(key) - 6), F.lit(": "), entry).alias("line"))
        store.write_lines(self.spark, path, '{"version": 1, "entries": {', (r["line"] for r in lines.toLocalIterator()), "}}")


def maintain_ledger_log(records: DataFrame, folder: str, checkpoint: str, stream: str = "verdicts", fanout: int = FANOUT) -> StreamingQuery:
    """Keeps a ledger log up to date from streamed records: a delta for each batch. A batch that runs again after a failure changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        LedgerLog(batch.sparkSession, folder, fanout).append(batch.select("path", *ENTRY), stream, number)

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
