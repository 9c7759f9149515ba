"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates that meet it, those closest in entropy to one
copy each are an exponential tilt: a document of size s in source k is taken min(cap, exp(t_k * s / mean_k)) times.
The tilts solve a convex dual, one equation for each source. Each Newton iteration is a Spark aggregation: the gap and
the slope of all sources at once, summed over the documents counted by source and size, and a table with a row for each
source carries its tilt and its bracket on to the next. Rates are whole multiples of 1 / UNIT, so sums are exact and
reruns agree. The rates become whole copies by error diffusion along the documents of a source in order of size, which
leaves less than one document's words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import BROADCAST_ROWS, WORD, bounded, frozen, numbered

#: Rates are whole multiples of 1 / UNIT, so that their running sums are exact and reruns agree.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
#: Newton iterations at most, and what a source may be off its target, as a share of it, beside the rounding of its rates.
STEPS, TOLERANCE = 80, 1e-7
#: Single documents of each source that are moved to come nearer to its target.
REPAIRS = 4


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    #: No document is taken more often, and no source gets more than this many times its words.
    cap: int = 3


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds `target` to (key, words): shares of all words by the weights, repeating in order of key, none above cap times its words.

    The common level of the open sources is the root of a piecewise linear function; a turn is a Newton step on it.
    """
    ranked = numbered(sources, [F.col("key")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    ranked = frozen(ranked.withColumn("weight", weight).withColumn("most", F.col("words") * float(mix.cap)))
    total = ranked.agg(F.sum("words")).first()[0] or 0
    level = 0.0
    while True:  # ends: each turn stops at least one more source
        full = F.col("most") < F.col("weight") * level
        capped, open_weight = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        raised = (total - capped) / open_weight if open_weight else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return ranked.select("key", "words", F.least("most", F.col("weight") * level).alias("target"))


def rate_units(mix: Mix) -> Column:
    """The rate of a document of `size` at `tilt`, in whole multiples of 1 / UNIT."""
    # exponents above the cap's logarithm give the cap, so that nothing overflows
    power = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(mix.cap)))
    return F.when(F.col("size") > 0, F.least(F.lit(mix.cap * UNIT), F.rint(F.exp(power) * UNIT))).otherwise(F.lit(0)).cast("long")


def solve_tilts(bins: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """key, mean, tilt of each source: the root of sum(n * size * rate) = target over its bins (key, size, n).

    sources: key, words, documents, target. Newton steps, or halvings where a step would leave the bracket; every iteration takes all sources
    that aren't done, and the number of documents of a source or of sources doesn't matter to it.
    """
    nothing = (F.col("words") == 0) | (F.col("target") >= F.col("words") * float(mix.cap) * (1 - 1e-9))
    mean = F.greatest(F.col("words") / F.col("documents"), F.lit(1e-9))
    low, high = -60.0 * F.col("mean"), math.log(mix.cap) * F.col("mean")
    state = sources.withColumn("mean", mean).withColumn("done", nothing).withColumn("low", low).withColumn("high", high)
    # at `high` a document of one word is taken cap times, at `low` hardly
    start = F.when(F.col("done"), F.col("high")).when(F.col("target") > 0, F.log(F.col("target") / F.col("words"))).otherwise(F.col("low"))
    state = frozen(state.withColumn("tilt", F.least(F.greatest(start, F.col("low")), F.col("high"))))
    sent = F.broadcast if state.count() <= BROADCAST_ROWS else lambda df: df
    exact = lambda x: x.cast("decimal(19,0)")
    for _ in range(STEPS):
        open_ = state.filter("NOT done")
        if open_.isEmpty():
            break
        taken = exact(F.col("n") * F.col("size")) * F.col("unit").cast("decimal(10,0)")
        free = F.when(F.col("unit") < mix.cap * UNIT, taken * F.col("size").cast("decimal(9,0)")).otherwise(F.lit(0))
        sums = (
            bins.join(sent(open_.select("key", "mean", "tilt")), "key")
            .withColumn("unit", rate_units(mix))
            .groupBy("key")
            .agg((F.sum(taken).cast("double") / UNIT).alias("taken"), (F.sum(free).cast("double") / UNIT).alias("slope"))
        )
        gap, slope = F.col("taken") - F.col("target"), F.col("slope") / F.col("mean")
        # rates are rounded by half a unit at most, so the sum by that share of all words
        near = F.abs(gap) <= TOLERANCE * F.col("target") + F.col("words") / UNIT
        narrow = F.col("high") - F.col("low") <= 1e-12 * F.abs(F.col("high"))
        step = F.when(slope > 0, F.col("tilt") - gap / slope).otherwise(F.col("low"))
        state = (
            state.join(sent(sums), "key", "left")
            .withColumn("gap", gap)
            .withColumn("low", F.when(F.col("done") | (gap > 0), F.col("low")).otherwise(F.col("tilt")))
            .withColumn("high", F.when(F.col("done") | (gap <= 0), F.col("high")).otherwise(F.col("tilt")))
            .withColumn("done", F.col("done") | near | narrow)
            .withColumn("step", step)
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise((F.col("low") + F.col("high")) / 2))
        )
        state = frozen(state.drop("gap", "step", "taken", "slope"))
    return state.select("key", "mean", "tilt")


def solve_units(bins: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """key, size, unit, base of bins (key, size, n).

    unit is the rate in whole multiples of 1 / UNIT, base what all larger documents of the source have together. A
    source has as many rows here as it has sizes, however many documents.
    """
    larger = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rated = bins.join(bounded(solve_tilts(bins, sources, mix)), "key").withColumn("unit", rate_units(mix))
    base = F.coalesce(F.sum(F.col("unit") * F.col("n")).over(larger), F.lit(0)) + UNIT // 2
    return rated.select("key", "size", "unit", base.alias("base"))


def repairs(taken: DataFrame, mix: Mix) -> DataFrame:
    """place, move (+1 or -1) of single documents that bring their source nearer to its target, REPAIRS of a source at most.

    One document of each size and number of copies stands for its like, so that a source's share is small.
    """
    kinds = taken.groupBy("key", "size", "copies").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.first("target").alias("target"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        size, copies = frame["size"].to_numpy(), frame["copies"].to_numpy()
        gap = float(frame["target"].iloc[0]) - float((size * copies * frame["n"].to_numpy()).sum())
        free, out = size > 0, []
        for _ in range(REPAIRS):
            up = gap > 0
            fits = free & (size < 2 * abs(gap)) & (copies < mix.cap if up else copies > 0)
            if not fits.any():
                break
            # the nearest size; of equally near ones the first place
            best = min(fits.nonzero()[0], key=lambda i: (abs(size[i] - abs(gap)), frame["place"].iloc[i]))
            free[best] = False
            out.append((int(frame["place"].iloc[best]), 1 if up else -1))
            gap -= size[best] if up else -size[best]
        return pd.DataFrame(out, columns=["place", "move"], dtype="int64")

    return kinds.groupBy("key").applyInPandas(choose, "place long, move long")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix(), row_col: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken, copies, rate (and row_col, if it is given).

    size counts words (null: none); sources by code point, null last, have the weights of mix in turn. A document is
    taken `copies` times, so taken = copies * size, at most cap times. Documents without words are not taken. Rows
    that repeat an id are documents of their own. An empty table gives an empty result.
    """
    own = [F.col(row_col).alias("row")] if row_col else []
    # '0' before a name and '1' for none: null comes last, and keys are never null
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    rows = frozen(docs.select(*own, F.col(id_col).alias("doc_id"), key.alias("key"), word_count(F.col(text_col)).alias("size")))
    bins = frozen(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = frozen(bins.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("documents")))
    sources = frozen(source_targets(totals.select("key", "words"), mix).join(totals.select("key", "documents"), "key"))
    units = solve_units(bins, sources, mix)

    # numbered by source, from the largest document to the smallest, in a shuffled order among equals
    order = [F.col("key"), F.col("falling"), F.col("shuffled"), F.col("doc_id")]
    placed = numbered(rows.withColumn("falling", -F.col("size")).withColumn("shuffled", F.xxhash64("doc_id")), order, "place").drop("falling", "shuffled")
    placed = frozen(placed)
    starts = placed.groupBy("key", "size").agg(F.min("place").alias("start"))
    rated = frozen(units.join(starts, ["key", "size"]).join(sources.drop("documents"), "key"))
    passed = F.col("base") + (F.col("place") - F.col("start")) * F.col("unit")
    copies = F.shiftright(passed + F.col("unit"), UNIT_BITS) - F.shiftright(passed, UNIT_BITS)
    columns = [*(["row"] if row_col else []), "doc_id", "key", "size", "place"]
    taken = frozen(placed.join(bounded(rated), ["key", "size"]).select(*columns, "words", "target", (F.col("unit") / UNIT).alias("rate"), copies.cast("long").alias("copies")))
    copies = F.col("copies") + F.coalesce("move", F.lit(0))
    return taken.join(repairs(taken, mix), "place", "left").select(
        *([F.col("row").alias(row_col)] if row_col else []), "doc_id", "size", F.col("words").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate"
    )
