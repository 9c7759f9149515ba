"""Captions in passes: observe, compose, fill gaps. Only the images that need a pass go through the model for it.

What a pass costs is a look at the image, so whether one is needed is decided beforehand, by the text there is: labelled
regions can stand for an observation, and a draft that says enough needs no second look. Each pass is a table of its
own, frozen before the next begins: a run that was stopped goes on with the first pass that isn't whole, and how often
the model was asked is counted from these tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions import prompts, text
from framesift.sources import store

#: The passes in order; `compose_fallback` asks again, in one go, where composing gave nothing.
STAGES = ("observe", "compose", "compose_fallback", "gap")
#: A draft of fewer characters is none.
LEAST_DRAFT = 3

#: Gives (path, answer) of rows (path, stage, prompt, max_new_tokens and the columns that the images came with).
Model = Callable[[DataFrame], DataFrame]


class Passes:
    """Passes of one run over images; folder holds a table for each, and has to be another one for other images."""

    def __init__(self, folder: str, model: Model, max_new_tokens: int = 200, begun: Callable[[str], None] = lambda folder: None) -> None:
        self.folder, self.model, self.max_new_tokens, self.begun = folder, model, max_new_tokens, begun

    def ask(self, stage: str, todo: DataFrame, max_new_tokens: int) -> DataFrame:
        """path, answer of rows with a prompt, as this pass or an earlier attempt at it found them. Answers are cleaned of stock phrases."""
        spark, place = todo.sparkSession, f"{self.folder}/{stage}"
        if not store.exists(spark, f"{place}/_SUCCESS"):
            self.begun(place)
            asked = todo.withColumn("stage", F.lit(stage)).withColumn("max_new_tokens", F.lit(max_new_tokens))
            answers = self.model(asked).select("path", text.strip_boilerplate(F.coalesce("answer", F.lit(""))).alias("answer"))
            answers.write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)

    def tally(self, spark) -> dict[str, int]:  # noqa: ANN001
        """How many images went through each pass that has run; passes that no image needed are left out."""
        counts = {s: spark.read.parquet(f"{self.folder}/{s}").count() for s in STAGES if store.exists(spark, f"{self.folder}/{s}/_SUCCESS")}
        return {s: n for s, n in counts.items() if n}


def grounded(images: DataFrame, passes: Passes, token: str | None = None, brief: str | None = None, style_mode: bool = False, template: str | None = None) -> DataFrame:
    """path, caption, passes (names of those the image went through) of images (path, labels, places and what the model wants).

    labels and places are arrays, of the regions that a person has marked; null is none. Paths have to be different. A caption that
    has gaps keeps every word: what the model names is added behind it. An image that no pass gives anything for has an empty caption.
    """
    mark, about = F.lit(token or ""), F.lit(brief or "")
    none = F.array().cast("array<string>")
    rows = images.withColumn("labels", F.coalesce("labels", none)).withColumn("places", F.coalesce("places", none))
    lines = prompts.annotations(F.col("labels"), F.col("places"))
    length = passes.max_new_tokens

    unknown = rows.filter(~text.annotations_suffice(F.col("labels")))
    facts = passes.ask("observe", unknown.withColumn("prompt", prompts.observe(lines, about)), max(length, prompts.OBSERVE_TOKENS)).withColumnRenamed("answer", "_facts")

    seen = rows.join(facts, "path", "left")
    drafts = passes.ask("compose", seen.withColumn("prompt", prompts.compose(F.col("_facts"), lines, mark, about, style_mode, template)).drop("_facts"), length).withColumnRenamed("answer", "_draft")
    thin = rows.join(drafts.filter(F.length(text.trimmed(F.col("_draft"))) < LEAST_DRAFT).select("path"), "path", "left_semi")
    again = passes.ask("compose_fallback", thin.withColumn("prompt", prompts.full_image(lines, mark, about, style_mode, template)), length).withColumnRenamed("answer", "_second")
    drafted = rows.join(drafts, "path").join(again, "path", "left").withColumn("_draft", F.coalesce("_second", "_draft"))

    lacking = drafted.filter(text.needs_gap_pass(F.col("_draft"), F.col("labels")).isNotNull())
    gaps = passes.ask("gap", lacking.withColumn("prompt", prompts.gap(F.col("_draft"))).drop("_draft", "_second"), prompts.GAP_TOKENS).withColumnRenamed("answer", "_missing")

    whole = drafted.join(gaps, "path", "left").join(facts, "path", "left")
    caption = F.when(F.col("_missing").isNull(), F.col("_draft")).otherwise(text.merge_missing_phrases(F.col("_draft"), text.parse_gap_phrases(F.col("_missing"))))
    went = F.array_compact(F.array(*[F.when(c, name) for c, name in ((F.col("_facts").isNotNull(), "observe"), (F.lit(True), "compose"), (F.col("_second").isNotNull(), "compose_fallback"), (F.col("_missing").isNotNull(), "gap"))]))
    return whole.select("path", caption.alias("caption"), went.alias("passes"))


def single(images: DataFrame, passes: Passes, token: str | None = None, brief: str | None = None, style_mode: bool = False, template: str | None = None) -> DataFrame:
    """As grounded(), in one pass an image: the strategy for models that can be asked once only."""
    none = F.array().cast("array<string>")
    lines = prompts.annotations(F.coalesce("labels", none), F.coalesce("places", none))
    asked = images.withColumn("prompt", prompts.full_image(lines, F.lit(token or ""), F.lit(brief or ""), style_mode, template))
    answers = passes.ask("compose", asked, passes.max_new_tokens)
    return images.select("path").join(answers, "path").select("path", F.col("answer").alias("caption"), F.array(F.lit("compose")).alias("passes"))


def mock_model(draft: str = "label") -> Model:
    """A model for runs without one: answers follow from a row alone. Drafts are the column `draft` names, observations and gaps the labels."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))

    def answer(rows: DataFrame) -> DataFrame:
        by_stage = F.when(F.col("stage") == "observe", F.concat(F.lit("SUBJECT: "), F.array_join(labels, ", "))).when(F.col("stage") == "gap", F.array_join(F.concat(labels, F.array(F.lit("NONE"))), "\n"))
        return rows.select("path", by_stage.when(F.col("stage") == "compose", F.col(draft)).otherwise(F.concat_ws(" ", F.lit("A picture of"), F.array_join(labels, " and "))).alias("answer"))

    return answer
