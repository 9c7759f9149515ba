"""Line deduplication on levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash. Each new batch of documents is aggregated to its own hashes,
merge-anti-joined with all runs there are, which tells new lines from known ones, and added as a run of its own. When a
level has `fanout` runs, they are merged into one run of the next level, so that n batches leave about log n runs and each
hash is rewritten about log n times. All runs are bucketed alike: neither a merge nor an anti-join moves a run over the
network; only the hashes of the new batch are shuffled, once, summed up before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import BROADCAST_ROWS, bounded, fresh, frozen, shuffle_partitions, with_row_id

#: White space that is stripped from lines, and the letters that are folded.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Parts of a table that are taken as batches one after the other, and runs of a level that make one of the next.
BATCHES, FANOUT = 4, 2
#: A line with more than one in HEAVY_SHARE of all entries is broadcast whatever the number of lines; there are HEAVY_SHARE such lines at most.
HEAVY_SHARE = 5_000
HASH = ["h", "g"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty ones have one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The key of each line of a text: stripped, A-Z in lower case."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.transform(F.split(folded, "\n", -1), lambda line: F.btrim(line, F.lit(STRIPPED)))


def hashes(key: Column) -> list[Column]:
    """128 bits of a key in two columns."""
    return [F.xxhash64(F.lit(1), key).alias("h"), F.xxhash64(F.lit(2), key).alias("g")]


def entries(batch: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h, g, n, keeper of each long key of batch (doc, text): how many rows hold it, and the largest doc that does. Summed up before it is shuffled."""
    each = batch.select("doc", F.explode(F.array_distinct(keys_of(F.col("text")))).alias("key")).filter(F.length("key") >= least_chars)
    return each.select("doc", *hashes(F.col("key"))).groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))


class LineRuns:
    """Levelled runs of (h, g, n, keeper): the line's hash, how many documents of the run's batches hold it, and the document that it stays in.

    The keeper is the one of the first batch that has the line, so batches should come by falling document. A run is a
    bucketed table in the warehouse; close() drops all of them. Runs are never changed: a compaction writes a new run, then drops the old ones.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.buckets = shuffle_partitions(spark)

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: Sequence[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh_entries(self, new: DataFrame) -> DataFrame:
        """new, with the keeper of those hashes alone that no run knows: one anti-join a run, bucket by bucket."""
        unknown = new
        for name in self.runs():
            unknown = unknown.join(self.spark.table(name).select(*HASH), HASH, "left_anti")
        return unknown

    def add(self, batch: DataFrame, least_chars: int = LEAST_CHARS) -> None:
        """Takes the lines of batch (doc, text) in. A batch without long lines adds an empty run."""
        own = self._write(entries(batch, least_chars))
        if self.runs():
            new = self.spark.table(own)
            unknown = self.fresh_entries(new)
            rest = new.join(unknown.select(*HASH, F.lit(True).alias("first")), HASH, "left")
            marked = self._write(rest.select(*HASH, "n", F.when(F.col("first"), F.col("keeper")).alias("keeper")))
            self._drop([own])
            own = marked
        self._place(own, 0)

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(self._merged(full), level + 1)

    def _merged(self, names: Sequence[str]) -> str:
        """One run of several, two by two: a merge join of runs that are bucketed alike."""
        first, *rest = names
        for name in rest:
            merged = self._write(_merge(self.spark.table(first), self.spark.table(name)))
            self._drop([first, name])
            first = merged
        return first

    def compact(self) -> None:
        """Leaves one run on the last level."""
        runs = self.runs()
        if runs:
            self.levels = [*[[] for _ in self.levels[:-1]], [self._merged(runs)]]

    def common(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """h, g, n, keeper of each line that least_docs documents or more hold; compacts the runs."""
        self.compact()
        if not self.runs():
            return self.spark.createDataFrame([], "h long, g long, n long, keeper long")
        return self.spark.table(self.runs()[0]).filter(F.col("n") >= least_docs)

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The entries of both runs; of a hash that both have, the counts add up, and one of them has the keeper."""
    other = b.select(*[F.col(c).alias(f"{c}_") for c in b.columns])
    both = a.join(other, (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_")), "full")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))
    return both.select(*[F.coalesce(c, f"{c}_").alias(c) for c in HASH], n.alias("n"), F.greatest("keeper", "keeper_").alias("keeper"))


@contextmanager
def line_runs(spark: SparkSession, fanout: int = FANOUT) -> Iterator[LineRuns]:
    """Runs that are dropped at the end."""
    runs = LineRuns(spark, fanout)
    try:
        yield runs
    finally:
        runs.close()


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs (doc, text) in n parts of about equal size by falling doc, null last; rows of one doc are in one part. Files sorted by id are read once, row group by row group."""
    cuts = docs.agg(F.percentile_approx("doc", [i / n for i in range(n - 1, 0, -1)], 1000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts), reverse=True)
    doc = F.col("doc")
    if not cuts:
        return [docs]
    parts = [doc > cuts[0], *[(doc <= a) & (doc > b) for a, b in zip(cuts, cuts[1:], strict=False)], doc.isNull() | (doc <= cuts[-1])]
    return [docs.filter(p) for p in parts]


def _dropped(rows: DataFrame, common: DataFrame, least_chars: int) -> DataFrame:
    """row, drops (places of lines, array<int>) of the rows (row, doc, text) that lose lines. A line in a large share of all rows is broadcast, so no task gets all of them."""
    places = rows.select("row", "doc", F.posexplode(keys_of(F.col("text"))).alias("at", "key")).filter(F.length("key") >= least_chars).select("row", "doc", "at", *hashes(F.col("key")))
    total = common.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY_SHARE > total
    small = bounded(common)
    if small is common:
        hot, rest = F.broadcast(common.filter(heavy)), common.filter(~heavy)
        found = places.join(hot, HASH).unionByName(places.join(F.broadcast(common.filter(heavy).select(*HASH)), HASH, "left_anti").join(rest, HASH))
    else:
        found = places.join(small, HASH)
    lost = found.filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("row").agg(F.collect_list("at").alias("drops"))


def _without(text: Column, drops: Column) -> Column:
    """A text without the lines at these places. The lines are bound once, and each is looked at once."""

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.transform(F.array(lines_of(text)), kept)[0]


def deduplicated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines (before dropping), n_dropped, kept_text.

    A key is a line stripped of ASCII white space, with A-Z in lower case. Keys of least_chars code points that
    least_docs rows hold lose all their lines but those of the largest doc_id that holds them, where they stay however often they come.
    Ids are whole numbers. A null or empty text is one empty line. Rows that repeat an id are documents of their own and
    keep or lose a line together; null ids are below all others and equal to each other. Whole texts are read, twice, and
    moved only for the rows that lose lines, and then only if there are more of them than may be broadcast. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    row = fresh(docs, "_row")
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with line_runs(spark, fanout) as runs:
        for batch in _batches(lines, batches):
            runs.add(batch, least_chars)
        common = frozen(runs.common(least_docs))
    rows = with_row_id(docs, row).select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    drops = frozen(_dropped(rows, common, least_chars))
    # the places count as well as the rows: both are bounded
    places = drops.agg(F.sum(F.size("drops"))).first()[0] or 0
    side = bounded(drops) if places <= 4 * BROADCAST_ROWS else drops
    text = F.coalesce("text", F.lit(""))
    return rows.join(side, "row", "left").select(
        F.col("doc").alias("doc_id"),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), text).otherwise(_without(text, F.col("drops"))).alias("kept_text"),
    )
