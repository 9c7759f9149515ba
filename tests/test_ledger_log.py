"""The ledger log, denoising, and selections of steps."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from framesift.functions import pixels
from framesift.operators import run_state
from framesift.sources import files
from framesift.streaming.ledger_log import SCHEMA, LedgerLog, maintain_ledger_log


def test_log_reads_latest_and_compacts(spark, tmp_path):
    log = LedgerLog(spark, str(tmp_path / "log"), fanout=3)
    assert log.entries().count() == 0
    want: dict[str, tuple] = {}
    for n in range(10):
        rows = [(f"p{(n * 7 + i) % 11}", ("wrong", "correct", "generic", "odd")[(n + i) % 4], f"c{n}", False, n * 10 + i) for i in range(6)]
        assert log.append(spark.createDataFrame(rows, SCHEMA), "s", n)
        assert not log.append(spark.createDataFrame(rows, SCHEMA), "s", n)  # a batch run twice
        for path, verdict, caption, resolved, seq in rows:
            if verdict != "odd":
                want[path] = max(want.get(path, (-1,)), (seq, verdict, caption, resolved))
        deltas = log.manifest()["deltas"]
        assert all(sum(k == level for _, k in deltas) < 3 for level in range(4))
        assert {p.name for p in (tmp_path / "log").iterdir() if p.is_dir()} == {name for name, _ in deltas}
    read = lambda: {r.path: (r.seq, r.verdict, r.caption, r.resolved) for r in log.entries().collect()}
    assert read() == want
    log.resolve(spark.createDataFrame([("p1",), ("none",)], "path string"), 1000)
    assert read()["p1"] == (1000, *want["p1"][1:3], True) and {k: v for k, v in read().items() if k != "p1"} == {k: v for k, v in want.items() if k != "p1"}
    log.to_json(str(tmp_path / "ledger.json"))
    document = json.loads((tmp_path / "ledger.json").read_text())
    assert document["version"] == 1 and list(document["entries"]) == sorted(want) and document["entries"]["p1"]["resolved"] is True
    again = {r.path: (r.verdict, r.caption) for r in files.read_ledger(spark, str(tmp_path / "ledger.json")).collect()}
    assert again == {k: v[1:3] for k, v in read().items()}


def test_a_batch_costs_what_it_is(spark, tmp_path):
    """Files that a batch of one record writes don't grow with what is there."""
    log = LedgerLog(spark, str(tmp_path / "log"), fanout=100)
    log.append(spark.range(2000).select(F.concat(F.lit("a"), "id").alias("path"), F.lit("wrong").alias("verdict"), F.lit("c" * 200).alias("caption"), F.lit(False).alias("resolved"), "id").withColumnRenamed("id", "seq"))
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "log").rglob("*.parquet"))
    before, large = size(), {p for p in (tmp_path / "log").rglob("*.parquet")}
    log.append(spark.createDataFrame([('q"\\', "correct", "ü\n", False, 1)], SCHEMA))
    assert size() - before < before / 3 and large <= {p for p in (tmp_path / "log").rglob("*.parquet")}
    log.to_json(str(tmp_path / "odd.json"))
    assert json.loads((tmp_path / "odd.json").read_text())["entries"]['q"\\']["caption_at_verdict"] == "ü\n"


def test_streamed_log_survives_a_batch_that_fails(spark, tmp_path, monkeypatch):
    for i, verdict in enumerate(("wrong", "correct", "bad", "generic")):
        spark.createDataFrame([("/a", verdict, "c", False, i), (f"/b{i}", "wrong", "c", False, i)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    records = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    broken = LedgerLog.compact

    def fails(self, manifest=None):
        if len(manifest["deltas"]) == 2:
            monkeypatch.setattr(LedgerLog, "compact", broken)
            raise RuntimeError("gone after the manifest was written")

    monkeypatch.setattr(LedgerLog, "compact", fails)
    try:
        maintain_ledger_log(records(), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(60)
        raise AssertionError("no batch failed")
    except AssertionError:
        raise
    except Exception as e:
        assert "gone after" in str(e)
    maintain_ledger_log(records(), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(60)
    log = LedgerLog(spark, str(tmp_path / "log"))
    assert {r.path: r.verdict for r in log.entries().collect()} == {"/a": "generic", "/b0": "wrong", "/b1": "wrong", "/b2": "wrong", "/b3": "wrong"}
    assert len(log.manifest()["deltas"]) == 4


def test_denoising_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    image = np.clip(np.add.outer(np.arange(9), np.arange(11))[:, :, None] * [6, 3, 9] + rng.normal(0, 6, (9, 11, 3)), 0, 255).astype(np.uint8)
    for patch, window, strength in ((3, 5, 6.0), (7, 9, 3.0)):
        reach, half = window // 2, patch // 2
        n = reach + half
        wide = np.pad(image.astype(float), ((n, n), (n, n), (0, 0)), mode="reflect") if min(image.shape[:2]) > n else np.stack([pixels._padded(image[:, :, c].astype(float), n) for c in range(3)], axis=2)
        want = np.zeros(image.shape)
        for y in range(9):
            for x in range(11):
                cut = lambda a, b: wide[a + n - half : a + n + half + 1, b + n - half : b + n + half + 1]
                weights, total = 0.0, np.zeros(3)
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        away = ((cut(y, x) - cut(y + dy, x + dx)) ** 2).mean()
                        k = np.exp(-away / strength**2)
                        weights, total = weights + k, total + k * wide[y + dy + n, x + dx + n]
                want[y, x] = total / weights
        assert np.abs(pixels.denoised(image, strength, patch, window).astype(float) - want).max() <= 0.5 + 1e-6
    flat = np.full((30, 30, 3), 120, np.uint8)
    noisy = np.clip(flat + rng.normal(0, 3, flat.shape), 0, 255).astype(np.uint8)
    assert pixels.denoised(noisy).std() < noisy.std() / 2 and np.array_equal(pixels.denoised(flat), flat)
    # only what is a JPEG by its name is denoised before it is brought to size
    rows = spark.createDataFrame([(f"/{n}", None, 30, 30, 3, noisy.tobytes()) for n in ("a.png", "a.JPG")], "path string, divisor int, w long, h long, channels int, data binary")
    made = {r.path: r.content for r in pixels.upscaled(rows, 30).collect()}
    assert made["/a.png"] == pixels.png_bytes(noisy) and made["/a.JPG"] == pixels.png_bytes(pixels.resampled(pixels.denoised(noisy), 30, 30))


def test_selections(spark):
    df = spark.createDataFrame([(["c", "a", "c", "x"], ["a", "b", "c"]), (None, ["a"]), (["b"], None)], "wanted array<string>, own array<string>")
    assert [r[0] for r in df.select(run_state.ordered_selection(F.col("wanted"), F.col("own"))).collect()] == [["a", "c", "x"], [], ["b"]]
