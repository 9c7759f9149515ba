"""Caption passes: who goes through which, resuming, prompts, and a run with a model that takes prompts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import prompts
from framesift.operators import passes
from framesift.operators.captions import pass_tally
from framesift.operators.quality_gate import Scorer
from framesift.plans.config import Caption, Project, QualityGate, Upscale
from framesift.plans.runs import Hooks, Run

IMAGES = "path string, labels array<string>, places array<string>, draft string"
LONG = "A brass telescope stands beside a tall window in soft morning light, in front of a pale curtain, on a worn wooden floor of an old room."


def forty(spark):
    """28 with two labels or one that says much, 12 to be observed; 7 drafts that are thin."""
    rows = []
    for i in range(40):
        labels = None if i < 6 else ["hat"] if i < 12 else ["a brass telescope", "a pale curtain"] if i < 30 else ["a tall window in morning light"]
        draft = LONG if i % 6 else "A telescope."
        rows.append((f"i{i:02}", labels, ["left"] * len(labels or []), LONG.replace("curtain", "hat and a curtain") if labels == ["hat"] and i % 6 else draft))
    return spark.createDataFrame(rows, IMAGES)


class Asked:
    """Counts the rows that a model is asked about, by what it was given, and can fail in a pass."""

    def __init__(self, fail: str | None = None) -> None:
        self.stages: list[tuple[str, int]] = []
        self.fail, self.answer = fail, passes.mock_model("draft")

    def __call__(self, rows):
        stage = rows.select("stage").first()
        if stage is not None:
            self.stages.append((stage[0], rows.count()))
        if stage is not None and stage[0] == self.fail:
            raise RuntimeError("the model is gone")
        return self.answer(rows)


def test_fifty_nine_calls_instead_of_a_hundred_and_twenty(spark, tmp_path):
    model = Asked()
    run = passes.Passes(str(tmp_path / "passes"), model)
    found = {r.path: r for r in passes.grounded(forty(spark), run, "sks").collect()}
    assert run.tally(spark) == {"observe": 12, "compose": 40, "gap": 7} and sum(run.tally(spark).values()) == 59
    assert model.stages == [("observe", 12), ("compose", 40), ("gap", 7)]
    assert found["i12"].passes == ["compose", "gap"] and found["i12"].caption == "A telescope, a brass telescope, a pale curtain."
    assert found["i01"].passes == ["observe", "compose"] and found["i01"].caption == LONG
    assert found["i00"].passes == ["observe", "compose", "gap"] and found["i00"].caption == "A telescope."
    assert {r.stage: r.n for r in pass_tally(passes.grounded(forty(spark), run, "sks")).collect()} == run.tally(spark)
    assert len(model.stages) == 3  # all of it was there


def test_stopped_runs_go_on_with_the_pass_that_is_missing(spark, tmp_path):
    folder = str(tmp_path / "passes")
    with pytest.raises(RuntimeError):
        passes.grounded(forty(spark), passes.Passes(folder, Asked("gap")))
    model = Asked()
    assert passes.grounded(forty(spark), passes.Passes(folder, model)).count() == 40
    assert model.stages == [("gap", 7)]


def test_empty_drafts_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["one", "two words"], None, ""), ("b", None, None, None), ("c", [None, " "], [None, None], LONG)], IMAGES)
    run = passes.Passes(str(tmp_path / "odd"), passes.mock_model("draft"))
    got = {r.path: (r.caption, r.passes) for r in passes.grounded(rows, run).collect()}
    assert got["a"] == ("One and two words", ["compose", "compose_fallback", "gap"])
    assert got["b"][1] == ["observe", "compose", "compose_fallback", "gap"] and got["c"] == (LONG, ["observe", "compose"])
    none = passes.Passes(str(tmp_path / "none"), passes.mock_model("draft"))
    assert passes.grounded(rows.limit(0), none).count() == 0 and none.tally(spark) == {}
    one = passes.Passes(str(tmp_path / "single"), passes.mock_model("draft"))
    assert passes.single(rows, one).count() == 3 and one.tally(spark) == {"compose": 3}


def test_prompts(spark):
    row = spark.createDataFrame([(["a hat", "", "a {facts} cup"], ["left", "top", "on the right"], "SUBJECT: {x}\n?a thing", "sks", "  boats ")], "labels array<string>, places array<string>, facts string, token string, brief string")
    lines = prompts.annotations(F.col("labels"), F.col("places"))
    c = F.col
    made = row.select(
        prompts.observe(lines, c("brief")).alias("observe"),
        prompts.compose(c("facts"), lines, c("token"), F.lit("")).alias("compose"),
        prompts.compose(F.lit(" "), lines, c("token"), F.lit(None), style_mode=True).alias("style"),
        prompts.compose(c("facts"), lines, c("token"), F.lit(None), template="Own {concept_token} {odd}").alias("own"),
        prompts.full_image(prompts.annotations(F.array().cast("array<string>"), F.array().cast("array<string>")), c("token"), F.lit("")).alias("full"),
        prompts.gap(F.lit("a {draft}")).alias("gap"),
        prompts.region(F.lit("in the upper-left"), F.lit("")).alias("placed"), prompts.region(F.lit(None).cast("string"), F.lit("")).alias("bare"),
        prompts.region(F.lit("x"), c("brief"), "Say {region_position}").alias("said"),
    ).first()
    assert "boats" in made.observe.split("\n\n")[0] and "  Region 1 (left): a hat\n  Region 3 (on the right): a {facts} cup\n" in made.observe
    assert "SUBJECT: {x}\n?a thing" in made.compose and "keep its description" in made.compose and "contain sks exactly" in made.compose
    assert "No facts were noted" in made.style and "sks" not in made.style and "trigger word" in made.style
    assert made.own.startswith("Facts that were seen") and made.own.endswith("\n\nOwn sks {odd}")
    assert prompts.NO_LABELS in made.full and "a {draft}\n" in made.gap
    assert "a larger image, in the upper-left." in made.placed and made.bare == prompts.REGION and made.said.endswith("Say x")


def test_a_run_with_a_model_that_takes_prompts(spark, tmp_path, make_png):
    rng = np.random.default_rng(2)
    root = tmp_path / "in"
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.png").write_bytes(make_png(rng.integers(0, 255, (24, 24, 3)).tolist()))
    settings = {"quality_gate": QualityGate(scorers=(Scorer("min_side", "lt", 20.0),)), "upscale": Upscale(run=False), "caption": Caption(concept_token="sks")}
    regions = spark.createDataFrame([("a", ["a red hat", "a wooden bench"], ["left", "right"])], "stem string, labels array<string>, places array<string>")

    def vlm(rows):
        # all that a model needs is there
        assert {"path", "w", "h", "channels", "data", "stage", "prompt", "max_new_tokens"} <= set(rows.columns)
        return rows.select("path", F.when(F.col("stage") == "compose", "this image shows a street").when(F.col("stage") == "gap", "a lamp\nNONE").otherwise("SUBJECT: street").alias("answer"))

    run = Run(spark, Project("t", str(root), str(tmp_path / "out"), settings=settings), Hooks(vlm=vlm, regions=regions))
    report = run.run(["import", "quality_gate", "curate", "caption"])["caption"]
    assert report["passes"] == {"observe": 2, "compose": 3, "gap": 3} and report["captioned"] == 3 and report["missing_token"] == 0
    texts = {r.rel: r.text for r in spark.read.parquet(run.folder("caption")).collect()}
    assert texts["b.png"] == "sks, A street, a lamp" and texts["a.png"] == "sks, A street, a lamp, a red hat, a wooden bench"
    with pytest.raises(ValueError):
        Caption(strategy="other")
