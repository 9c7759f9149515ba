"""Whole runs: answers to all steps, substeps, images that a step makes, stopping within a step, and files that stay where they belong."""

from __future__ import annotations

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators.quality_gate import Scorer
from framesift.plans.config import Audit, BucketCheck, Import, Project, QualityGate, Upscale, VerifyCaptions
from framesift.plans.runs import CancelledError, Hooks, Run
from framesift.sources import files, manifest

STEPS = ["import", "quality_gate", "curate", "upscale", "caption", "verify_captions", "vae_gate", "audit", "bucket_check", "export"]
NO_ANSWERS = "path string, decision string"


@pytest.fixture
def root(tmp_path, make_png):
    rng = np.random.default_rng(8)
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name in ("a", "b", "sub/c", "d"):
        (folder / f"{name}.png").write_bytes(make_png(rng.integers(0, 255, (24, 24, 3)).tolist()))
        (folder / f"{name}.txt").write_text(f"a caption of image {name}")
    return folder


def project(root, **more) -> Project:
    settings = {
        "quality_gate": QualityGate(scorers=(Scorer("min_side", "lt", 20.0), Scorer("jpeg", "gt", 5.0), Scorer("bright", "gt", 250.0, optional=True))),
        "upscale": Upscale(target=48, highlight=24, generative=False, run=True, least_ssim=-1.0),
        "audit": Audit(min_resolution=48), "bucket_check": BucketCheck(buckets=((48, 48),), cache=True), "verify_captions": VerifyCaptions(write_edits=True),
    } | more
    return Project("t", str(root), f"{root.parent}/out", settings=settings)


class Answers:
    """An answer to each step that asks: b is rejected, c isn't upscaled, a is edited, d is dropped by the last gate."""

    def __init__(self, spark) -> None:
        self.spark, self.asked = spark, []

    def __call__(self, step, rows):
        self.asked.append(step)
        at = lambda name: F.endswith("path", F.lit(f"/{name}.png"))
        if step == "quality_gate":
            return rows.select("path", F.when(at("b"), "reject").otherwise("keep").alias("decision"))
        if step == "upscale":
            return rows.select("path", F.when(at("c"), "skip").otherwise("process").alias("decision"))
        if step == "verify_captions":
            return rows.select(F.concat(F.lit(self.root + "/"), "rel").alias("path"), F.lit("wrong").alias("decision"), F.when(F.col("rel") == "a.png", "an edited caption").alias("text"))
        if step == "vae_gate":
            return rows.select("path", F.when(at("d"), "drop").otherwise("keep").alias("decision"))
        return self.spark.createDataFrame([], NO_ANSWERS)


def hooks(answers, **more) -> Hooks:
    return Hooks(decide=answers, rebuild=lambda rows: rows.withColumn("rebuilt", F.col("data")), scorers={"bright": lambda p: float(p.gray.mean())}, **more)


def exported(root) -> dict:
    target = root.parent / "out_export"
    return {str(p.relative_to(target)): p for p in target.rglob("*") if p.is_file() and not p.name.startswith(".")}


@pytest.mark.parametrize("copy", [False, True])
def test_all_steps_with_answers(spark, root, copy):
    before = {p: p.read_bytes() for p in root.rglob("*") if p.is_file()}
    p = project(root, **{"import": Import(work_on_copy=copy)})
    answers = Answers(spark)
    answers.root = f"{p.output}/dataset" if copy else str(root)
    run = Run(spark, p, hooks(answers))
    reports = run.run()
    assert answers.asked == ["quality_gate", "upscale", "verify_captions", "vae_gate", "export"]
    assert reports["import"]["images"] == 4 and reports["quality_gate"]["rejected"] == 1
    assert reports["upscale"] == {"upscale": 2, "pass_through": 1, "outcomes": {"upscaled": 2}}
    scores = spark.read.parquet(run.folder("quality_gate_scores"))
    assert scores.filter("jpeg > 0 AND bright > 50").count() == 4
    # the last gate judged the upscaled images, and only what passed it goes on
    assert {r.rel: (r.w, r.h) for r in spark.read.parquet(run.folder("vae_gate")).collect()} == {"a.png": (48, 48), "sub/c.png": (24, 24)}
    assert reports["audit"]["undersized"] == 1 and reports["bucket_check"]["buckets"] == {"48x48": 2}
    out = exported(root)
    assert set(out) == {"a.png", "a.txt", "sub/c.png", "sub/c.txt"}
    sizes = {r.rel: r.w for r in files.decoded(spark, str(root.parent / "out_export")).collect()}
    assert sizes == {"a.png": 48, "sub/c.png": 24}
    assert out["a.txt"].read_text() == "an edited caption" and out["sub/c.png"].read_bytes() == before[root / "sub/c.png"]
    if copy:
        assert {p: p.read_bytes() for p in root.rglob("*") if p.is_file()} == before
    # a plan alone takes the layer away again: the originals are what later steps see
    again = Run(spark, p, hooks(answers))
    later = again.run(["upscale", "caption", "vae_gate", "audit"], force=True, substeps={"upscale": ["plan"], "vae_gate": ["score"]})
    assert "outcomes" not in later["upscale"] and later["audit"]["undersized"] == 3


def test_substeps_that_are_off(spark, root):
    p = project(root)
    answers = Answers(spark)
    answers.root = str(root)
    chosen = {"quality_gate": ["score_images", "write_survivors"], "curate": ["deduplicate"], "upscale": ["plan"], "caption": ["annotate"], "verify_captions": ["preview"], "vae_gate": ["score"], "audit": ["check_pairing"], "bucket_check": ["assign"], "export": ["diff"]}
    run = Run(spark, p, hooks(answers, caption=lambda rows: rows.select("stem", F.lit("made").alias("made")), embed=lambda rows: rows.select("path", F.array(F.lit(1.0)).alias("embedding"))))
    reports = run.run(substeps=chosen)
    assert answers.asked == []
    assert reports["quality_gate"]["rejected"] == 0 and "coverage" not in reports["curate"]
    assert reports["upscale"] == {"upscale": 4} and not (root.parent / "out/upscaled").exists()
    assert reports["caption"] == {"images": 4, "captioned": 4} and reports["verify_captions"]["skipped"] is True
    assert reports["audit"]["undersized"] is None and reports["audit"]["orphan_images"] == 0 and reports["audit"]["passed"]
    assert "cache_info" not in reports["bucket_check"]
    assert reports["export"]["added"] == 4 and "copied" not in reports["export"] and not (root.parent / "out_export").exists()
    assert list(run.state.steps["export"]["substeps"]) == ["diff"]
    assert run.run(["quality_gate"], force=True, substeps={"quality_gate": ["write_survivors"]})["quality_gate"]["total"] == 4


def test_defaults_of_substeps_follow_settings(spark, root):
    p = project(root, upscale=Upscale(target=48, highlight=24, generative=False), quality_gate=QualityGate(scorers=(Scorer("min_side", "lt", 20.0),), manual_review=False), bucket_check=BucketCheck(buckets=((48, 48),)))
    answers = Answers(spark)
    answers.root = str(root)
    reports = Run(spark, p, hooks(answers)).run(["import", "quality_gate", "upscale", "vae_gate", "audit", "bucket_check"])
    assert answers.asked == ["upscale", "vae_gate"] and "outcomes" not in reports["upscale"] and "cache_info" not in reports["bucket_check"]
    # a generative upscaler that isn't there is said, not passed over
    generative = project(root, upscale=Upscale(target=48, highlight=24, run=True))
    report = Run(spark, generative, hooks(answers)).run(["upscale"], force=True)["upscale"]
    assert "no generative model" in report["reason"] and report["upscale"] == 3


def test_stopped_within_a_step(spark, root):
    """A job that would take minutes ends when another thread says so; the step leaves nothing, and runs again later."""
    p = project(root)

    def slow(rows):
        def wait(batches):
            for batch in batches:
                time.sleep(120)
                yield batch

        return rows.select("path", F.lit(None).cast("binary").alias("content"), F.lit(1.0).alias("ssim"), F.lit(None).cast("string").alias("error")).mapInArrow(wait, "path string, content binary, ssim double, error string")

    answers = Answers(spark)
    answers.root = str(root)
    run = Run(spark, p, hooks(answers, upscale=slow))
    run.run(["import", "quality_gate"])

    def stop() -> None:
        while not (root.parent / "out/steps/upscale_made").exists():
            time.sleep(0.2)
        run.cancel()

    other = threading.Thread(target=stop)
    other.start()
    began = time.monotonic()
    with pytest.raises(CancelledError):
        run.run(["upscale"])
    other.join()
    assert time.monotonic() - began < 60
    assert run.state.steps["upscale"]["status"] == "cancelled"
    assert not (root.parent / "out/steps/upscale").exists() and not (root.parent / "out/steps/upscale_made").exists()
    assert Run(spark, p, hooks(answers)).run(["upscale"])["upscale"]["outcomes"] == {"upscaled": 2}


def test_cancelled_import_leaves_nothing(spark, root, monkeypatch):
    p = project(root, **{"import": Import(work_on_copy=True)})
    run = Run(spark, p, hooks(Answers(spark)))

    def broken(*args):
        run.stopped.set()
        raise RuntimeError("stopped here")

    monkeypatch.setattr(files, "decoded", broken)
    with pytest.raises(CancelledError):
        run.run(["import"])
    assert not (root.parent / "out/dataset").exists() and not (root.parent / "out/steps/import").exists()
    assert run.state.steps["import"]["status"] == "cancelled"


def test_files_stay_below_their_target(spark, tmp_path):
    target = tmp_path / "target"
    names = ["../escape.txt", "/abs.txt", "a/../../b.txt", "", "..", "ok/../fine.txt", "a/b.txt", "..dots.txt"]
    rows = spark.createDataFrame([(n, b"x") for n in [*names, None]], "rel string, content binary")
    copied = {r.rel: r.copied for r in files.copy_files(rows, target.as_uri()).collect()}
    assert {n for n, done in copied.items() if done} == {"ok/../fine.txt", "a/b.txt", "..dots.txt"}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["target/..dots.txt", "target/a/b.txt", "target/fine.txt"]


def test_layers(spark):
    images = spark.createDataFrame([("a.jpg", "/in/a.jpg", 1, "x"), ("b.png", "/in/b.png", 1, "y"), ("c.png", "/in/c.png", 1, "z")], "rel string, path string, w long, more string")
    schema = "was string, rel string, path string, size long, w long, h long"
    one = spark.createDataFrame([("a.jpg", "a.png", "/up/a.png", 9, 2, 2), ("b.png", None, None, None, None, None)], schema)
    two = spark.createDataFrame([("a.png", "a.png", "/edit/a.png", 9, 5, 5), ("none.png", "n.png", "/n.png", 1, 1, 1)], schema)
    got = manifest.overlaid(images, [one, two])
    assert sorted(map(tuple, got.collect())) == [("a.png", "/edit/a.png", 5, "x"), ("c.png", "/in/c.png", 1, "z")]
    assert sorted(map(tuple, manifest.overlaid(images, []).collect())) == sorted(map(tuple, images.collect()))
