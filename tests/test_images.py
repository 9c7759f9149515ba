"""Files, pixels and a whole run on a folder of real images."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import geometry, pixels
from framesift.operators import regions
from framesift.operators.coverage import mock_embedding
from framesift.operators.ledger import ENTRY
from framesift.plans.config import BucketCheck, Export, Import, Project, QualityGate, Upscale, VerifyCaptions, prompts
from framesift.operators.quality_gate import Scorer
from framesift.plans.runs import Hooks, Run, outcome
from framesift.sources import files, store
from framesift.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory, make_png):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    noisy = rng.integers(0, 255, (48, 48, 3)).tolist()
    wide = rng.integers(0, 255, (32, 64, 3)).tolist()
    flat = np.full((40, 40, 3), 120).tolist()
    (root / "sub dir").mkdir()
    for name, image in (("a.png", noisy), ("copy.png", noisy), ("sub dir/wide.png", wide), ("flat.png", flat), ("UPPER.PNG", flat)):
        (root / name).write_bytes(make_png(image))
    (root / "broken.png").write_bytes(b"no image")
    (root / "a.txt").write_text("A noisy square of many colours\n")
    (root / "copy.txt").write_text("The same square again")
    (root / "orphan.txt").write_text("nobody's caption")
    return str(root)


def test_scan(spark, folder):
    rows = files.scan_images(spark, folder)
    sizes = {r.rel: r.size for r in rows.select("rel", files.png_size(F.col("content")).alias("size")).collect()}
    assert set(sizes) == {"a.png", "copy.png", "sub dir/wide.png", "flat.png", "UPPER.PNG", "broken.png"}
    assert (sizes["sub dir/wide.png"].w, sizes["sub dir/wide.png"].h) == (64, 32) and sizes["broken.png"] is None
    assert "UPPER.PNG" not in {r.rel for r in files.scan_images(spark, folder, case_sensitive=True).collect()}
    assert {r.rel: r.corrupt for r in files.decoded(spark, folder).collect()}["broken.png"]
    assert {r.stem: r.text for r in files.read_captions(spark, folder).collect()} == {"a": "A noisy square of many colours", "copy": "The same square again", "orphan": "nobody's caption"}


def test_metrics(spark, folder):
    rows = {r.path.rpartition("/")[2]: r for r in pixels.image_metrics(files.decoded(spark, folder)).collect()}
    assert rows["flat.png"].blur == 0 and rows["flat.png"].noise == pytest.approx(0, abs=1e-9)
    assert rows["a.png"].blur > 1000 and rows["a.png"].phash == rows["copy.png"].phash
    assert rows["broken.png"].error and rows["broken.png"].blur is None


def test_pixel_rules():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (33, 41)).astype(float)
    assert pixels.ssim(a, a) == pytest.approx(1) and pixels.ssim(a, 255 - a) < 0
    assert pixels.hf_loss(a, a) == 0 and pixels.hf_loss(a, pixels.blur(a, 9)) > 0.3 and pixels.hf_loss(a * 0, a) == 0
    assert pixels.resized(a, 33, 41).shape == (33, 41) and np.allclose(pixels.resized(a, 33, 41), a)
    assert pixels.upscaled_size(100, 150, 300) == (300, 450)
    near = np.clip(a + rng.normal(0, 2, a.shape), 0, 255)
    assert bin((pixels.perceptual_hash(a) ^ pixels.perceptual_hash(near)) & (1 << 64) - 1).count("1") <= 8
    step = np.concatenate([np.full(50, 10.0), np.full(50, 200.0)])
    assert 10 <= pixels.otsu(step) < 200
    assert pixels.lightness(np.full((1, 1, 3), 255, np.uint8))[0, 0] == pytest.approx(100, abs=0.1)
    soft, hard = pixels.difference_views(np.zeros((9, 9, 3), np.uint8), np.zeros((9, 9, 3), np.uint8))
    assert soft.max() == 0 and hard.max() == 0
    assert pixels.blur_score(np.zeros((1, 1))) == 0


def test_whole_run(spark, folder, tmp_path):
    gate = QualityGate(scorers=(Scorer("min_side", "lt", 20.0), Scorer("blur", "lt", 1.0), Scorer("jpeg", "gt", 0.9, optional=True)))
    project = Project("t", folder, str(tmp_path / "out"), settings={"quality_gate": gate, "bucket_check": BucketCheck(cache=True)})

    def decide(step, rows):
        if step == "export":
            return rows.select(F.col("stem").alias("path"), F.lit("exclude").alias("decision")).limit(0)
        return None

    hooks = Hooks(decide=decide, caption=lambda rows: rows.select("stem", F.lit("this image shows a wide picture").alias("made")), rebuild=lambda rows: rows.withColumn("rebuilt", F.col("data")))
    run = Run(spark, project, hooks)
    reports = run.run()
    assert reports["import"]["images"] == 5
    assert reports["quality_gate"] == {"total": 5, "kept": 3, "rejected": 2, "flagged": 0}
    assert reports["curate"] == {"duplicate_pairs": 1, "images": 2}
    assert reports["caption"]["captioned"] == 2
    assert reports["verify_captions"]["skipped"] is True
    assert reports["vae_gate"]["flagged"] == 0 and reports["vae_gate"]["successful"] == 2
    assert sum(reports["bucket_check"]["buckets"].values()) == 2 and reports["bucket_check"]["cache_info"]
    # both images are captioned after the run, one of them by it
    assert reports["export"]["added"] == 2 and reports["export"]["copied"] == 2
    assert json.loads((tmp_path / "out/reports/export.json").read_text())["copied"] == 2
    assert reports["audit"]["orphan_images"] == 0
    again = Run(spark, project, hooks).run(["import", "quality_gate", "audit"])
    assert all(r["reason"] == "already_done" for r in again.values())
    forced = Run(spark, project, hooks)
    forced.run(["audit"], force=True)
    assert "bucket_check" not in forced.state.steps and "curate" in forced.state.steps
    assert not (tmp_path / "out/reports/bucket_check.json").exists() and (tmp_path / "out/reports/audit.json").exists()
    assert outcome({"skipped": ["a"]}) == ("completed", "") and outcome({})[0] == "skipped" and outcome(None)[0] == "completed"


def test_export_copies_captions_and_changes(spark, tmp_path, make_png):
    rng = np.random.default_rng(4)
    root, target = tmp_path / "in", tmp_path / "out_export"
    (root / "sub").mkdir(parents=True)
    images = [make_png(rng.integers(0, 255, (40, 40, 3)).tolist()) for _ in range(5)]
    for name, content in zip(("same", "picture", "sub/words", "new"), images, strict=False):
        (root / f"{name}.png").write_bytes(content)
    for name in ("same", "picture", "sub/words"):
        (root / f"{name}.txt").write_text(f"a caption of {name}")
    settings = {"quality_gate": QualityGate(scorers=(Scorer("min_side", "lt", 20.0),)), "export": Export(new_captions=True)}
    project = Project("t", str(root), str(tmp_path / "out"), settings=settings)
    hooks = Hooks(
        decide=lambda step, rows: rows.select(F.col("stem").alias("path"), F.lit("exclude").alias("decision")).limit(0) if step == "export" else None,
        caption=lambda rows: rows.select("stem", F.lit("a caption of this run").alias("made")),
    )
    steps = ["import", "quality_gate", "curate", "caption", "export"]
    first = Run(spark, project, hooks).run(steps)["export"]
    assert first == {"added": 4, "modified": 0, "unchanged": 0, "orphaned": 0, "copied": 4}
    texts = lambda: {str(p.relative_to(target))[:-4]: p.read_text() for p in target.rglob("*.txt")}
    made = texts()["new"]
    assert "caption of this run" in made.lower()
    assert texts() == {"same": "a caption of same", "picture": "a caption of picture", "sub/words": "a caption of sub/words", "new": made}
    (root / "picture.png").write_bytes(images[4])
    (root / "sub/words.txt").write_text("other words")
    second = Run(spark, project, hooks).run(steps, force=True)["export"]
    assert second == {"added": 0, "modified": 2, "unchanged": 2, "orphaned": 0, "copied": 2}
    assert (target / "picture.png").read_bytes() == images[4] and texts()["sub/words"] == "other words"
    third = Run(spark, project, hooks).run(["export"], force=True)["export"]
    assert third == {"added": 0, "modified": 0, "unchanged": 4, "orphaned": 0, "copied": 0}


def test_run_copies_upscales_and_edits(spark, folder, tmp_path):
    import shutil

    root = tmp_path / "in"
    shutil.copytree(folder, root)
    settings = {"import": Import(copy=True), "quality_gate": QualityGate(scorers=(Scorer("min_side", "lt", 20.0),)), "upscale": Upscale(target=96, highlight=40, generative=False, run=True, least_ssim=0.0), "verify_captions": VerifyCaptions(write_edits=True)}
    project = Project("t", str(root), f"file://{tmp_path}/out", settings=settings)

    def decide(step, rows):
        if step == "verify_captions":
            at = F.concat(F.lit(f"{root}/"), F.col("rel"))
            return rows.select(at.alias("path"), F.lit("wrong").alias("decision"), F.when(F.col("rel") == "copy.png", "  edited \u00a0").when(F.col("rel") == "flat.png", " ").alias("text"))
        return None

    hooks = Hooks(decide=decide, embed=lambda rows: rows.select("path", mock_embedding(F.col("path")).alias("embedding")))
    run = Run(spark, project, hooks)
    reports = run.run(["import", "quality_gate", "curate", "upscale", "caption", "verify_captions"])
    assert reports["import"] == {"images": 5, "copied": 8}
    assert (tmp_path / "out/dataset/sub dir/wide.png").read_bytes() == (root / "sub dir/wide.png").read_bytes()
    assert reports["curate"]["coverage"] == reports["curate"]["images"] and spark.read.parquet(run.folder("curate_coverage")).columns == ["path", "x", "y", "x_pct", "y_pct"]
    assert reports["upscale"]["outcomes"] == {"upscaled": reports["upscale"]["upscale"]}
    sizes = {r.rel: (r.w, r.h) for r in files.decoded(spark, f"{tmp_path}/out/upscaled").collect()}
    assert sizes["sub dir/wide.png"] == (192, 96)
    assert reports["verify_captions"]["edits"] == {"applied": 1, "rejected": 1}
    assert (root / "copy.txt").read_text() == "edited" and (tmp_path / "out/caption_backup/copy.txt").read_text() == "The same square again"
    files.apply_caption_edits(spark, spark.createDataFrame([(f"{root}/sub dir/../copy.png", "again"), (f"{root}/../x.png", "out"), (f"{root}/none.png", "x"), (f"{root}/flat.png", "new")], "path string, text string"), str(root), str(tmp_path / "out/caption_backup"))
    assert (root / "copy.txt").read_text() == "again" and (root / "flat.txt").read_text() == "new" and not (root / "none.txt").exists()
    # the first caption is the one that is kept
    assert (tmp_path / "out/caption_backup/copy.txt").read_text() == "The same square again" and not (tmp_path / "out/caption_backup/flat.txt").exists()


def test_region_files(spark, folder, tmp_path):
    crops = spark.createDataFrame([("sub dir/wide",), ("sub dir/wide",)], "stem string")
    boxes = spark.createDataFrame([("sub dir/wide", 5, 0.25, 0.0, 0.75, 0.5, "a red  box"), ("sub dir/wide", 7, 0.0, 0.0, 0.0, 0.0, ""), ("a", 1, 0.5, 0.5, 1.0, 1.0, "corner")], "stem string, seq int, x1 double, y1 double, x2 double, y2 double, label string")
    named = regions.numbered_regions(boxes, crops)
    assert {(r.stem, r.seq): r.crop for r in named.collect()} == {("sub dir/wide", 5): "sub dir/region__wide__03", ("sub dir/wide", 7): "sub dir/region__wide__04", ("a", 1): "region__a__01"}
    pictures = files.decoded(spark, folder).filter("NOT corrupt").withColumn("stem", F.regexp_replace("rel", r"\.png$", ""))
    at = geometry.crop_bounds(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("w"), F.col("h"))
    made = pixels.region_crops(named.join(pictures, "stem").withColumn("at", at).select("crop", "at.*", "w", "h", "channels", "data"))
    target = tmp_path / "regions"
    assert files.copy_files(made.filter("error IS NULL"), str(target.absolute().as_uri())).filter("copied").count() == 3
    read = {r.rel: r for r in files.decoded(spark, str(target)).collect()}
    assert {k: (r.w, r.h) for k, r in read.items()} == {"sub dir/region__wide__03.png": (32, 16), "sub dir/region__wide__04.png": (1, 1), "region__a__01.png": (24, 24)}
    whole = next(r for r in pictures.collect() if r.stem == "sub dir/wide")
    cut = np.frombuffer(whole.data, np.uint8).reshape(32, 64, 3)[:16, 16:48]
    assert np.array_equal(np.frombuffer(read["sub dir/region__wide__03.png"].data, np.uint8).reshape(16, 32, 3), cut)
    texts = {r.rel: r.text for r in regions.region_captions(named, "sks").collect()}
    assert set(texts) == {"sub dir/region__wide__03.txt", "region__a__01.txt"} and texts["region__a__01.txt"].lower().startswith("sks")
    struct = "stem string, boxes array<struct<x1:double,y1:double,x2:double,y2:double,label:string>>"
    side = regions.sidecars(spark.createDataFrame([("sub dir/wide", [(0.1, 0.2, 0.3, 0.4, "b")]), ("a", [])], struct))
    (target / "region__a__boxes.json").write_text("[]")
    assert files.write_sidecars(side, target.absolute().as_uri()).count() == 2
    assert json.loads((target / "sub dir/region__wide__boxes.json").read_text())[0]["label"] == "b" and not (target / "region__a__boxes.json").exists()


def test_small_files(spark, tmp_path):
    path = f"file://{tmp_path}/deep/state.json"
    assert store.read_text(spark, path) is None and not store.exists(spark, path)
    store.write_text(spark, path, "é1")
    store.write_text(spark, path, "é2")
    assert store.read_text(spark, path) == "é2" and (tmp_path / "deep/state.json").read_text() == "é2"
    store.delete(spark, path)
    (tmp_path / "deep/state.json.new").write_text("left over")
    assert store.read_text(spark, path) == "left over"
    for name, text in (("content__b", "name: b\nkind: content\ntext: say b"), ("content__a", "name: A\nkind: content\ntext: say a"), ("content__default", "name: default\nkind: content\ntext: hides"), ("content__bad", "[1"), ("content__odd", "name: s\nkind: style\ntext: other")):
        (tmp_path / f"{name}.yaml").write_text(text)
    assert prompts(str(tmp_path), "content", "built in") == [("A", "say a"), ("b", "say b"), ("Default", "built in")]
    with pytest.raises(ValueError):
        prompts(str(tmp_path), "other", "")


def test_records(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"version": 1, "entries": {"/a": {"verdict": "wrong", "caption_at_verdict": "c"}, "/b": {"verdict": "odd"}}}')
    (tmp_path / "bad.json").write_text("[1, 2]")
    assert [tuple(r)[:4] for r in files.read_ledger(spark, str(tmp_path / "l.json")).collect()] == [("/a", "wrong", "c", False)]
    assert files.read_ledger(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "s.json").write_text('{"steps": {"import": {"status": "done"}}}')
    assert files.read_run_state(spark, str(tmp_path / "s.json")).first().status == "done"


def test_streams(spark, folder, tmp_path):
    seen = ingest.image_stream(spark, folder, 2).select("rel", "size").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "seen"))
    seen.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 6
    schema = "path string, verdict string, caption string, resolved boolean, seq long"
    for i, verdict in enumerate(("wrong", "correct", "bad")):
        spark.createDataFrame([("/a", verdict, "c", False, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "verdicts"))
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "verdicts"))
    ingest.maintain_ledger(records.select("path", *ENTRY), str(tmp_path / "ledger"), str(tmp_path / "c2")).awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "ledger").glob("version=*"))
    assert [r.verdict for r in spark.read.parquet(str(tmp_path / f"ledger/version={last}")).collect()] == ["correct"]
