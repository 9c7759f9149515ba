"""Review sessions and the project library: who is shown what, and what an answer means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.text import trimmed
from framesift.operators.order import counted


def caption_descriptors(images: DataFrame, captions: DataFrame, verdicts: DataFrame, overwrite: bool = False) -> DataFrame:
    """path, done, verdict of each image: done if it has a caption that is neither flagged nor to be overwritten."""
    rows = images.select("path").join(captions.select("path", F.lit(True).alias("_has")), "path", "left").join(verdicts.select("path", "verdict"), "path", "left")
    return rows.select("path", (F.coalesce("_has", F.lit(False)) & F.lit(not overwrite) & F.col("verdict").isNull()).alias("done"), "verdict")


def effective_skip(skipped: Column, dirty: Column, done: Column) -> Column:
    """Whether an image is left alone: a skip counts, else an edit is captioned, else what is done stays."""
    return F.when(skipped, True).when(dirty, False).otherwise(F.coalesce(done, F.lit(False)))


def labelled(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: F.length(trimmed(F.coalesce(b["label"], F.lit("")))) > 0)


def submitted(states: DataFrame, skip_all: bool = False, active: int = 0) -> DataFrame:
    """path, annotations, skipped of (idx, path, boxes, skipped, dirty, done); skip_all captions the active image and edited ones only."""
    own = effective_skip(F.col("skipped"), F.col("dirty"), F.col("done"))
    skip = F.when(F.col("idx") == active, False).when(F.col("dirty"), own).otherwise(True) if skip_all else own
    return states.select("path", labelled(F.col("boxes")).alias("annotations"), skip.alias("skipped"))


def strip_state(skipped: Column, dirty: Column, done: Column, boxes: Column) -> Column:
    return F.when(skipped, "skipped").when(done & ~dirty, "done").when(F.size(boxes) > 0, "has-boxes").otherwise("empty")


def first_unlabelled(states: DataFrame, key: str) -> DataFrame:
    """key, idx: the first image of each session that will be captioned and has a box without a label; null if there is none."""
    open_box = F.size("boxes") > F.size(labelled(F.col("boxes")))
    mine = ~effective_skip(F.col("skipped"), F.col("dirty"), F.col("done")) & open_box
    return states.groupBy(key).agg(F.min(F.when(mine, F.col("idx"))).alias("idx"))


def has_findings(reports: DataFrame) -> Column:
    """Whether a step's report has something to show: it isn't skipped and some bucket has images."""
    return ~F.coalesce(reports["skipped"], F.lit(False)) & F.exists(reports["counts"], lambda n: n > 0)


def library_search(projects: DataFrame, query: str) -> DataFrame:
    """Projects whose name, token or input folder contains the query, in any case."""
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return projects.filter(hit("name") | hit("token") | hit("input_dir"))


def library_sorted(projects: DataFrame, by: str = "recent") -> DataFrame:
    order = [F.lower("name"), F.col("name")] if by == "name" else [F.coalesce("mtime", F.lit(0)).desc(), F.col("name")]
    return projects.orderBy(*order)


def seeded_config(fields: DataFrame, seeds: DataFrame) -> DataFrame:
    """step, field, value: the app's setting where there is one, else the project's own."""
    return fields.join(counted(seeds.filter("seed IS NOT NULL").select("step", "field", "seed")), ["step", "field"], "left").select("step", "field", F.coalesce("seed", "value").alias("value"))


def describe_skip(step: Column, reason: Column) -> Column:
    """One sentence on a step that didn't run."""
    return (
        F.when(reason == "legacy_import", "the data set that is there stands for the import")
        .when(reason == "already_done", F.concat(step, F.lit(" is done; force runs it again")))
        .otherwise(F.concat(step, F.lit(" had nothing to do: "), reason))
    )


def quality_text(quality: Column) -> Column:
    return F.coalesce(F.concat(quality.cast("string"), F.lit("/100")), F.lit("not available"))


def score_text(score: Column) -> Column:
    """Whole numbers as they are, others with three digits."""
    return F.when(score.isNull(), "not available").when(score == F.floor(score), F.floor(score).cast("string")).otherwise(F.format_string("%.3f", score))


def preview_name(seed: Column, index: Column) -> Column:
    return F.concat(F.lit("gen_"), seed.cast("string"), F.format_string("_%03d.png", index.cast("int")))


def next_seed(explicit: Column, previous: Column, derived: Column) -> Column:
    """A given seed, else that of the last preview, else the one derived from the path."""
    return F.coalesce(F.pmod(explicit, F.lit(2**32)), previous, derived)


def prompt_truncated(n_tokens: Column, limit: Column) -> Column:
    return F.coalesce(n_tokens > limit, F.lit(False))


def sole_target(images: DataFrame, wanted: str | None = None) -> str:
    """The image that given boxes are for: the one named, else the only one."""
    names = images.select("rel").filter(F.col("rel") == wanted) if wanted else images.select("rel")
    found = [r["rel"] for r in names.limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"no image {wanted!r}" if wanted else "name an image: there isn't exactly one")
    return found[0]
