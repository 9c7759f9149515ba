"""Models built once a size, and the weights of a model's components."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from framesift.operators import upscale
from framesift.sources import files


def test_a_model_is_built_once_a_size_and_task(spark, tmp_path):
    log = str(tmp_path)

    def build(size):
        import uuid

        from pyspark import TaskContext

        if size == 500:
            raise RuntimeError("too large")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
            out.write(f"{TaskContext.get().partitionId()} {size}")

        def model(row):
            if row["path"].endswith("7"):
                raise ValueError("broken image")
            return f"{size} {row['path']}".encode(), 0.9

        return model

    # two thirds go to the target; the others to their own size
    side = F.when(F.col("id") % 3 < 2, F.col("id") % 90).when(F.col("id") % 6 == 2, 300).otherwise(F.when(F.col("id") < 30, 500).otherwise(400))
    rows = spark.range(600).select(F.format_string("/p%03d", "id").alias("path"), side.alias("min_side"), F.lit(1).alias("target_side")).repartition(7)
    got = {r.path: r for r in upscale.upscaled_by_target(rows, build, 100).collect()}
    assert len(got) == 600
    assert got["/p000"].content == b"100 /p000" and got["/p002"].content == b"300 /p002" and got["/p047"].error == "broken image"
    assert got["/p005"].error == "no model: too large" and got["/p305"].content == b"400 /p305"
    built = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert len(built) == len(set(built)) and {size for _, size in built} == {100, 300, 400}
    # the size of two thirds of the rows is spread over tasks
    assert len({part for part, size in built if size == 100}) > 1


def test_weight_components(spark, tmp_path):
    sizes = {"unet/a-1-of-2.safetensors": 10, "unet/a-2-of-2.safetensors": 20, "unet/a-1-of-2.fp16.safetensors": 3, "unet/old.bin": 500, "text/m.bin": 7, "text/m.fp16.bin": 4, "vae/v.fp16.safetensors": 5, "vae/v.bf16.safetensors": 6, "vae/deep/x.safetensors": 99, "_cache/c.bin": 9, "skipped/s.bin": 8, "unet/config.json": 2, "top.bin": 1000, "unnamed/u.bin": 11}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x" * n)
    index = {"_class_name": "P", "vae": [1], "unet": [1], "scheduler": [1], "text": [1], "skipped": [1]}
    read = lambda: [(r.component, r.size, r.so_far) for r in files.weight_components(spark, str(tmp_path), ["skipped"]).orderBy("ord").collect()]
    assert read() == []
    (tmp_path / "model_index.json").write_text("{broken")
    assert read() == []
    (tmp_path / "model_index.json").write_text(json.dumps(index))
    assert read() == [("vae", 6, 6), ("unet", 30, 36), ("scheduler", 0, 36), ("text", 7, 43)]
    (tmp_path / "model_index.json").write_text(json.dumps({"scheduler": [1]}))
    assert read() == []
