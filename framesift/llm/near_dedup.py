"""Near duplicates by one-permutation MinHash with optimal densification.

A text's distinct word shingles are hashed once; the hash's first bits choose a bin, the rest compete to be the
bin's least. A bin without a hash borrows from the first one with a hash in an order of its own. Bands of bins make
buckets. Texts of the same words are merged first; then each bucket proposes a star of edges from its smallest member,
not all pairs, and every edge is confirmed on the full sets. All members of the buckets of one centre make a group:
where a group still lies in several components, its members are compared across these in blocks, by counts of common
shingles, so that no star hides a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_batches, bounded, frozen, stored

#: 128 bins in bands of 4: a pair at the threshold 0.85 is missed with probability 6e-11, at 0.80 with 5e-8.
BIN_BITS, BAND_ROWS = 7, 4
BINS = 1 << BIN_BITS
BANDS = BINS // BAND_ROWS
#: Members of a star that one task compares with its centre; members, and shingles of members, of a block.
STAR_TASK, BLOCK, BLOCK_SHINGLES = 256, 256, 200_000
#: Shingles whose occurrences are multiplied at a time, and texts that Python gets at a time.
COLUMNS, BATCH = 4096, 1000
KEPT = 200_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Rule:
    """Texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of word shingles."""

    words: int = 5
    percent: int = 80


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8 in lower case (A-Z only)."""
    return text.encode().translate(LOWER).split()


def numbered_words(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, and the words by their numbers."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array(list(map(numbers.__getitem__, words)), np.int64), list(numbers)


def shingle_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def borrow_orders() -> np.ndarray:
    """For each bin the order in which it looks at all bins for a hash."""
    cells = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.argsort(cells.reshape(BINS, BINS), axis=1)


class Sketcher:
    def __init__(self, width: int) -> None:
        self.width, self.known, self.orders = width, {}, borrow_orders()
        self.edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
        self.band_keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        return self.hashes_of(*numbered_words(words))

    def hashes_of(self, own: np.ndarray, distinct: list[bytes]) -> np.ndarray:
        """As hashes(), of words by their numbers."""
        import xxhash

        if not distinct:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > KEPT:
            known.clear()
        found = list(map(known.get, distinct))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = known[distinct[i]] = xxhash.xxh3_64_intdigest(distinct[i])
        h = np.array(found, np.uint64)[own]
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, 0x5851F42D4C957F2D, np.uint64)
        for i in range(min(self.width, len(h))):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of each bin, empty bins filled."""
        at = np.searchsorted(hashes, self.edges)
        value = hashes[np.minimum(at, len(hashes) - 1)]
        full = (at < len(hashes)) & ((value ^ self.edges) >> np.uint64(64 - BIN_BITS) == 0)
        if not full.all():
            value = value[np.where(full, np.arange(BINS), self.orders[np.arange(BINS), full[self.orders].argmax(axis=1)])]
        return value

    def bands(self, sketch: np.ndarray) -> np.ndarray:
        rows = sketch.reshape(BANDS, BAND_ROWS)
        out = self.band_keys
        for i in range(BAND_ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return out


def exact_size(own: np.ndarray, n_distinct: int, width: int) -> int:
    """The number of distinct shingles of numbered words, not of hashes: runs of words are named by equal neighbours, step by step."""
    if len(own) <= width:
        return min(1, len(own))
    names = own
    for i in range(1, width):
        names = names[:-1] * n_distinct + own[i:]
        if i + 1 < width and n_distinct ** (i + 2) >= 1 << 62:
            names = np.unique(names, return_inverse=True)[1].astype(np.int64)
    names = np.sort(names)
    return 1 + int(np.count_nonzero(names[1:] != names[:-1]))


SKETCHED = "doc_id long, n_shingles long, words_sha binary, bands array<long>"


def sketched(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size of the shingle set, SHA-256 of the words and the bucket of each band, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(rule.words)
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                own, distinct = numbered_words(words)
                hashes = maker.hashes_of(own, distinct)
                sizes.append(exact_size(own, len(distinct), rule.words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                bands.append(maker.bands(maker.sketch(hashes)).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "words_sha", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCHED)


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text of the documents in ids (id). Other texts aren't moved as long as the ids, counted, are few enough to be sent to all tasks."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(bounded(ids), "id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) whose texts are linked, by their full shingle sets. A hot centre's pairs are dealt over several tasks."""
    # computed on their own, and hot centres alone, so that no task gets all pairs of one
    hot = frozen(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_TASK).alias("parts")).filter("parts > 1"))
    dealt = pairs.join(bounded(hot), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).select("a", "part", "b")
    wanted = dealt.select("a", "part", F.lit(None).cast("long").alias("b")).distinct().unionByName(dealt).withColumn("id", F.coalesce("b", "a"))
    wanted = frozen(wanted)
    texts = _texts(docs, frozen(wanted.select("id").distinct()), id_col, text_col)
    percent, width = rule.percent, rule.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre_sets = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, part, b, text in zip(*(batch.column(x) for x in ("a", "part", "b", "text")), strict=True):
                a, part, b = a.as_py(), part.as_py(), b.as_py()
                own = shingle_set(text.as_py() or "", width)
                if (a, part) != now:
                    now, centre_sets = (a, part), []
                if b is None:
                    centre_sets.append(own)
                    continue
                for other in centre_sets:
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        out.append((a, b))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    together = wanted.join(texts, "id").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return together.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component of each node of links (a, b): the smallest node it can reach. Large-star and small-star steps by turns, until nothing changes."""
    state = frozen(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = frozen(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        state = frozen(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("v").alias("u"), "v").distinct()
    return state.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _sized(rule: Rule):  # noqa: ANN202
    """Sets whose sizes differ too much can't be linked."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * rule.percent


def _profiles(docs: DataFrame, ids: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """id, hashes of all shingles of the documents in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(rule.words)
        for batch in batches:
            found = [maker.hashes(words_of(t.as_py() or "")).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "hashes"])

    return _texts(docs, ids, id_col, text_col).mapInArrow(run, "id long, hashes array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of left shares with each of right: products of occurrence tables, of hashes on both sides only."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for side in (left, right):
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        flat = np.concatenate(side)
        at = np.searchsorted(both, flat)
        held = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        places.append((owner[held][order], at[held][order]))
    for start in range(0, len(both), COLUMNS):
        tables = []
        for side, (owner, at) in zip((left, right), places, strict=True):
            a, b = np.searchsorted(at, [start, start + COLUMNS])
            table = np.zeros((len(side), min(COLUMNS, len(both) - start)), np.float32)
            table[owner[a:b], at[a:b] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _joining(pairs: np.ndarray, parts: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join parts not yet joined."""
    parts, out = parts.copy(), []
    while len(pairs := pairs[parts[pairs[:, 0]] != parts[pairs[:, 1]]]):
        x, y = pairs[0]
        out.append((x, y))
        parts[parts == parts[y]] = parts[x]
    return out


def hidden_links(members: DataFrame, labels: DataFrame, docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between components within groups (centre, rep, n), which the stars can't show.

    The largest component of a group is its core. Members outside of it are compared with the core and with one
    another, in blocks, each pair of blocks by a task. All pairs are compared, however many bands they share; what
    is put out is a few links that join the same components, not candidates.
    """
    held = frozen(members.join(labels, F.col("rep") == F.col("node"), "left").select("centre", "rep", "n", F.coalesce("component", "rep").alias("component")))
    sizes = held.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    cores = sizes.groupBy("centre").agg(F.max(F.struct("c", "component", "s")).alias("core"), F.sum("c").alias("all"), F.sum("s").alias("shingles"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    cores = frozen(cores.select("centre", F.col("core.component").alias("core"), blocks(F.col("core.c"), F.col("core.s")).alias("core_blocks"), blocks(F.col("all") - F.col("core.c"), F.col("shingles") - F.col("core.s")).alias("out_blocks")))
    split = held.join(bounded(cores), "centre").withColumn("inside", F.col("component") == F.col("core"))
    split = split.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("core_blocks")).otherwise(F.col("out_blocks"))).cast("int"))
    each = lambda n, pair: F.transform(F.sequence(F.lit(0), n - 1), pair)
    pair = lambda with_core, i, j: F.struct(F.lit(with_core).alias("with_core"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    meets_core = F.when(F.col("inside"), each(F.col("out_blocks"), lambda j: pair(True, own, j))).otherwise(each(F.col("core_blocks"), lambda i: pair(True, i, own)))
    meets_others = F.when(~F.col("inside"), each(F.col("out_blocks"), lambda o: pair(False, F.least(own, o), F.greatest(own, o))))
    meetings = F.when(F.col("inside"), meets_core).otherwise(F.concat(meets_core, meets_others))
    dealt = frozen(split.withColumn("meeting", F.explode(meetings)).select("centre", "meeting.*", "inside", "own", F.col("rep").alias("id"), "component"))
    with arrow_batches(docs.sparkSession, BATCH):
        known = stored(_profiles(docs, frozen(dealt.select("id").distinct()), rule, id_col, text_col), "profiles")
    percent = rule.percent

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        # sides that meet each other but not their own
        own = (frame["inside"] if frame["with_core"].iloc[0] else frame["own"]).to_numpy()
        across = frame["with_core"].iloc[0] or frame["i"].iloc[0] != frame["j"].iloc[0]
        first = np.flatnonzero(own == own[0]) if across else np.arange(len(frame))
        second = np.flatnonzero(own != own[0]) if across else first
        out: list[tuple[int, int]] = []
        if len(first) and len(second):
            hashes, ids = list(frame["hashes"]), frame["id"].to_numpy()
            n = np.array([len(x) for x in hashes])
            parts = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]
            both = common_counts([hashes[x] for x in first], [hashes[y] for y in second])
            linked = 100 * both.astype(np.int64) >= percent * (n[first][:, None] + n[second][None, :] - both.astype(np.int64))
            linked &= parts[first][:, None] != parts[second][None, :]
            at = np.argwhere(linked)
            out = [(ids[x], ids[y]) for x, y in _joining(np.column_stack([first[at[:, 0]], second[at[:, 1]]]), parts)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.join(known, "id").groupBy("centre", "with_core", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id that links lead to; kept is whether that is the row's own. Null and empty texts
    have no shingle and no link, a text of fewer words than a shingle is one shingle. Rows that repeat an id count as
    one document with the links of all; null ids are linked with nothing and kept. Ids are whole numbers. Other columns
    of docs are ignored; an empty table gives an empty result.
    """
    with arrow_batches(docs.sparkSession, BATCH):
        rows = stored(sketched(docs, rule, id_col, text_col), "sketches")
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # texts of the same words are one from here on, whatever the number of their copies
    reps = frozen(some.groupBy("words_sha").agg(F.min("doc_id").alias("rep")))
    sets = some.join(reps.withColumn("doc_id", F.col("rep")), ["words_sha", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")
    buckets = sets.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    centres = frozen(buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre < last").select("bucket", "centre"))
    # buckets of one centre are one group; the centre is a member
    members = stored(buckets.join(bounded(centres), "bucket").select("centre", "rep", "n").distinct(), "members")
    middle = members.filter("rep = centre").select("centre", F.col("n").alias("m")).distinct()
    stars = frozen(members.filter("rep <> centre").join(bounded(frozen(middle)), "centre").filter(_sized(rule)).select(F.col("centre").alias("a"), F.col("rep").alias("b")))
    links = frozen(confirmed(stars, docs, rule, id_col, text_col))
    labels = frozen(components(links))
    # what the hashes of the shingles show is confirmed on the shingles, as the stars are
    hidden = frozen(hidden_links(members, labels, docs, rule, id_col, text_col))
    if not hidden.isEmpty():
        labels = frozen(components(links.unionByName(confirmed(hidden, docs, rule, id_col, text_col))))
    # rows that repeat an id tie their texts together
    twice = frozen(some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("doc_id"))
    if not twice.isEmpty():
        own = some.join(bounded(twice), "doc_id", "left_semi").select("doc_id", "words_sha").join(reps, "words_sha").select("doc_id", "rep")
        low = own.groupBy("doc_id").agg(F.min("rep").alias("low"))
        ties = own.join(low, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        labels = frozen(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(ties)))
    named = reps.join(labels, F.col("rep") == F.col("node"), "left").select("words_sha", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, "words_sha", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
