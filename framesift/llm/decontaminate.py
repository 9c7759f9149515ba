"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item's sketch is its smallest shingle hashes, a bottom-k MinHash. Items are partitioned by their number of
shingles, as the sketch's length depends on it: a document that holds the share t of n distinct shingles misses n - ceil(t * n) at
most, so of a sketch of twice as many hashes and one more it meets over half, however long the document is. How many
hashes have to be met follows from the sketch and the misses that are allowed; documents that meet as many are compared
with that item exactly, on the shingles themselves. Shingles are five words, words letters and digits in lower case. An
item of one to four words is one shingle of its own width, and documents are probed with the widths that items have; a
text without words has no shingle and meets nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import BROADCAST_ROWS, bounded, fresh, frozen

WORDS = r"[\p{L}\p{N}]+"
SHINGLE, PERCENT = 5, 80


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _over_words(text: Column, each, width: int) -> Column:  # noqa: ANN001
    """each(words, word, place) for the first word of every shingle. The words are bound once, so that no pattern is matched again."""

    def run(ws: Column) -> Column:
        heads = F.slice(ws, F.lit(1), F.greatest(F.lit(0), F.size(ws) - (width - 1)))
        return F.transform(heads, lambda w, i: each(ws, w, i))

    return F.transform(F.array(_words(text)), run)[0]


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    return _over_words(text, lambda ws, w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, width)]), width)


def shingles(text: Column, width: int = SHINGLE) -> Column:
    return F.array_distinct(_over_words(text, lambda ws, w, i: F.concat_ws(" ", w, *[F.get(ws, i + j) for j in range(1, width)]), width))


def _own_width(text: Column, make) -> Column:  # noqa: ANN001
    """make(text, width) by an item's own width: five words, or as many as it has."""
    n = F.size(_words(text))
    out = F.when(n >= SHINGLE, make(text, SHINGLE))
    for width in range(1, SHINGLE):
        out = out.when(n == width, make(text, width))
    return out.otherwise(make(F.lit(""), SHINGLE))


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item, size_class, least_met, hash: the smallest hashes of each item of (item, hashes), and how many of them a document with enough of the item meets."""
    n = F.size("hashes")
    # the longest item of a class, one less than a power of two, sets the sketch's length for the class
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1).cast("int") - 1
    length = (2 * (largest - F.ceil(largest * percent / 100)) + 1).cast("int")
    sketch = F.slice(F.array_sort("hashes"), F.lit(1), length)
    misses = n - F.ceil(n * F.lit(percent) / 100)
    least = F.greatest(F.lit(1), F.size(sketch) - misses).cast("int")
    return items.filter(n > 0).select("item", F.floor(F.log2(n)).cast("int").alias("size_class"), least.alias("least_met"), F.explode(sketch).alias("hash"))


def _key(id_col: str, text_col: str) -> Column:
    """SHA-256 of id and text together."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(F.col(id_col)), F.lit("\x00"), part(F.col(text_col))).cast("binary"), 256))


def candidates(rows: DataFrame, sketches: DataFrame, widths: Sequence[int] = (SHINGLE,)) -> DataFrame:
    """row_key, item, n_met of each text of rows (row_key, text) and item of whose sketch it meets enough: each size class is probed with sketches of its own length.

    Every text that holds enough of an item meets enough of its sketch, so this leaves nothing out; most texts meet none.
    """
    probes = rows.select("row_key", F.explode(F.array_distinct(F.concat(*[shingle_hashes(F.col("text"), w) for w in widths]))).alias("hash"))
    return probes.join(bounded(sketches), "hash").groupBy("row_key", "item", "size_class", "least_met").agg(F.count(F.lit(1)).alias("n_met")).filter("n_met >= least_met")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment, row_key of each document that holds percent of an item's distinct shingles or more.

    Every row and the whole of every text is searched, and every item. Null texts are empty; rows that repeat both id
    and text count once; items of equal text are found alike; an item of fewer than five words is found wherever these come
    in a row. row_key identifies id and text together. Empty tables
    give an empty result, other columns are ignored.
    """
    text = F.col(item_text_col)
    width = F.least(F.lit(SHINGLE), F.size(_words(text))).alias("width")
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), width, _own_width(text, shingles).alias("shingles"), F.array_distinct(_own_width(text, shingle_hashes)).alias("hashes"))
    items = frozen(items)
    # one to five
    widths = sorted(r["width"] for r in items.filter("width > 0").select("width").distinct().collect()) or [SHINGLE]
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    met = frozen(candidates(rows.select("row_key", "text"), frozen(item_sketches(items, percent)), widths).select("row_key", "item").distinct())
    # candidates only are compared in full, and with those items only that they met
    whole = items.select("item", "item_id", F.size("shingles").cast("long").alias("n_item"), F.explode("shingles").alias("shingle"))
    held = rows.join(bounded(met.select("row_key").distinct()), "row_key", "left_semi").select("doc_id", "row_key", F.explode(F.concat(*[shingles(F.col("text"), w) for w in widths])).alias("shingle"))
    return (
        held.join(bounded(whole, BROADCAST_ROWS // 4), "shingle")
        .distinct()
        .join(bounded(met), ["row_key", "item"], "left_semi")
        .groupBy("doc_id", "row_key", "item", "item_id", "n_item")
        .agg(F.count(F.lit(1)).alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"), "row_key")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item.

    Rows that repeat id and text go or stay together. A null or empty text holds nothing and stays; without items all
    rows stay, an empty table gives an empty result. Columns may have any names.
    """
    bad = fresh(docs, "_bad")
    found = frozen(contaminated(docs, benchmark, id_col, text_col, percent=percent).select(F.col("row_key").alias(bad)).distinct())
    return docs.join(bounded(found), _key(id_col, text_col) == F.col(bad), "left_anti")
