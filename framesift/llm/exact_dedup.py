"""Exact duplicates by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of a fixed size. Sorting brings equal blocks together, and each block
gets the number of the first block equal to it as its integer name. Then neighbouring names are paired and the
pairs named in the same way, until each document has a single name. Equal names mean equal bytes: no hash
decides, so nothing can collide. Only the first step moves text, once; all later ones move integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import bounded, frozen

#: Bytes of a block.
BLOCK_BYTES = 4096
#: A block with more than one in HEAVY_SHARE of all blocks is dealt over SALTS tasks; so there are at most HEAVY_SHARE such blocks.
HEAVY_SHARE, SALTS = 200, 32


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), raw.alias("raw"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / BLOCK_BYTES)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.struct(i.alias("pos"), F.substring(F.col("raw"), i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)).alias("block")),
    )
    return (
        rows.withColumn("n_blocks", n)
        .withColumn("sha", F.sha2("raw", 256))
        .select("row", "id", "n_blocks", "sha", F.explode(cut).alias("b"))
        .select("row", "id", "n_blocks", F.when(F.col("b.pos") == 0, F.col("sha")).alias("sha"), "b.pos", "b.block")
    )


def _heavy(blocks: DataFrame) -> DataFrame:
    """Hashes of the blocks that come so often that one task should not have them all: HEAVY_SHARE at most."""
    counts = frozen(blocks.groupBy(F.xxhash64("block").alias("h")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > max(1, total // HEAVY_SHARE)).select("h", F.lit(True).alias("heavy"))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, n_blocks, name, sha of each row of docs; (n_blocks, name) is equal for equal texts only.

    A null text counts as empty; an empty text is one empty block. Repeated rows each keep a row of their own.
    """
    blocks = _blocks(docs, id_col, text_col)
    salted = (
        blocks.withColumn("h", F.xxhash64("block"))
        .join(F.broadcast(_heavy(blocks)), "h", "left")
        .withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS))).otherwise(0))
        .withColumn("number", F.monotonically_increasing_id())
    )
    first = F.min("number").over(Window.partitionBy("block", "salt"))
    named = frozen(
        salted.withColumn("name", first)
        .withColumn("sample", F.when(F.col("heavy") & (F.col("name") == F.col("number")), F.col("block")))
        .select("row", "id", "n_blocks", "sha", "pos", "number", "name", "sample")
    )
    # a heavy block has a name for each salt, HEAVY_SHARE * SALTS in all at most: the smallest counts
    renamed = (
        named.filter(F.col("sample").isNotNull())
        .groupBy("sample")
        .agg(F.min("name").alias("final"), F.collect_set("name").alias("names"))
        .select("final", F.explode("names").alias("name"))
    )
    named = named.join(F.broadcast(renamed), "name", "left").withColumn("name", F.coalesce("final", "name")).drop("final", "sample")

    done = named.filter("n_blocks = 1").select("row", "id", "n_blocks", "name", "sha")
    rest = named.filter("n_blocks > 1").select("row", "n_blocks", "pos", "number", "name")
    most = rest.agg(F.max("n_blocks")).first()[0]
    if not most:
        return done
    for _ in range((most - 1).bit_length()):
        left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
        pairs = frozen(
            rest.groupBy("row", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.min("number").alias("number"),
                F.max(F.when(left, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("r"),
            )
        )
        # pairs that come once are named by their own number; of the others, one row for each is all that is joined
        names = frozen(pairs.groupBy("l", "r").agg(F.min("number").alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        rest = pairs.join(bounded(names), ["l", "r"], "left").select("row", "n_blocks", "pos", "number", F.coalesce("name", "number").alias("name"))
    heads = named.filter("n_blocks > 1 AND pos = 0").select("row", "id", "sha")
    return done.unionByName(rest.select("row", "n_blocks", "name").join(heads, "row").select("row", "id", "n_blocks", "name", "sha"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays;
    of rows that repeat that id, one. An empty table gives an empty result; other columns of docs are ignored.
    """
    names = frozen(name_documents(docs, id_col, text_col))
    # one row for each text that comes more than once, computed before it is joined, so that no task gets all copies of a text
    groups = frozen(names.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    return names.join(bounded(groups), ["n_blocks", "name"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("size").isNull(), True).otherwise(F.col("row") == F.col("last.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
