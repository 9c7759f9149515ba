from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import geometry as g
from framesift.functions import planning
from framesift.operators import audit, buckets, captions, coverage, duplicates, export, ledger, outliers, quality_gate, upscale
from framesift.operators.order import scan_order
from framesift.plans import config, steps


def flip(h: int, *bits: int) -> int:
    for b in bits:
        h ^= 1 << b
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("distance", [0, 3, 7, 8, 10, 12])
def test_near_duplicates_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [flip(h & (1 << 64) - 1, *rng.sample(range(64), rng.randint(0, 14))) for h in base for _ in range(6)] + [5, 5, 5]
    df = spark.createDataFrame(list(enumerate(hashes)), "ord long, h long")
    found = {(r.a, r.b, r.dist) for r in duplicates.near_dup_pairs(df, distance).collect()}
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert found == {(a, b, bits(hashes[a], hashes[b])) for a, b in itertools.combinations(range(len(hashes)), 2) if bits(hashes[a], hashes[b]) <= distance}


@pytest.mark.parametrize("distance", [8, 10, 11, 20])
def test_pairs_in_groups_and_blocks(spark, monkeypatch, distance):
    """Near hashes and copies over several blocks, tiles, runs and batches, against all pairs; no join of theirs is a broadcast."""
    for name, value in (("TILE", (7, 11)), ("BLOCKS", 5), ("COPIES", 4), ("RESULTS", 50), ("TASKS", 3)):
        monkeypatch.setattr(duplicates, name, value)
    rng = np.random.default_rng(distance)
    base = rng.integers(-(1 << 63), 1 << 63, 25)
    hashes = [int(base[i % 25]) ^ (0 if i % 3 else sum(1 << int(b) for b in rng.choice(63, int(rng.integers(1, 24)), replace=False))) for i in range(200)] + [5] * 23 + [-1, None]
    df = spark.createDataFrame(list(enumerate(hashes)), "ord int, h long").repartition(3)
    found = duplicates.near_dup_pairs(df, distance)
    close = duplicates.close_hashes(df, distance)
    assert dict(found.dtypes) == {"a": "int", "b": "int", "dist": "int"} and dict(close.dtypes) == {"x": "bigint", "y": "bigint"}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = sorted((i, j, bits(hashes[i], hashes[j])) for j in range(224) for i in range(j) if bits(hashes[i], hashes[j]) <= distance)
    assert sorted((r.a, r.b, r.dist) for r in found.collect()) == want
    distinct = sorted({h for h in hashes if h is not None})
    assert sorted((r.x, r.y) for r in close.collect()) == [(x, y) for i, x in enumerate(distinct) for y in distinct[i + 1 :] if bits(x, y) <= distance]
    assert duplicates.near_dup_pairs(df.limit(0), distance).count() == 0


def test_greedy_drop_follows_pair_order(spark):
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    blur = {i: float(rng.randint(0, 3)) for i in range(40)}
    gone: set[int] = set()
    for a, b in pairs:
        if a not in gone and b not in gone:
            gone.add(a if blur[a] <= blur[b] else b)
    out = duplicates.greedy_drop(spark.createDataFrame([(*p, 1) for p in pairs], "a long, b long, dist int"), spark.createDataFrame(list(blur.items()), "ord long, blur double"))
    assert sorted(r.ord for r in out.collect()) == sorted(gone)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_drop_of_hashes(spark, seed):
    """Classes of copies, cliques and chains of near hashes, ties and missing sharpness, against the walk over all pairs."""
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(12)]
    hashes = [rng.choice(base) ^ sum(1 << b for b in set(rng.choices(range(8), k=rng.choice((0, 0, 0, 1, 2, 4))))) for _ in range(150)]
    blurs = [rng.choice((None, float("nan"))) if rng.random() < 0.03 else float(rng.randint(0, 4)) for _ in hashes]
    less = lambda x, y: x is not None and y is not None and x <= y
    gone: set[int] = set()
    close = [(a, b) for a, b in itertools.combinations(range(150), 2) if (hashes[a] ^ hashes[b]).bit_count() <= 3]
    for a, b in close:
        if a not in gone and b not in gone:
            gone.add(a if less(blurs[a], blurs[b]) else b)
    rows = spark.createDataFrame(list(zip(range(150), hashes, blurs, strict=True)), "ord long, h long, blur double").repartition(3)
    found = duplicates.close_hashes(rows, 3)
    assert sorted(r.ord for r in duplicates.greedy_drop_hashes(rows, found).collect()) == sorted(gone)
    assert duplicates.pair_count(rows, found) == len(close)
    assert duplicates.greedy_drop_hashes(rows.limit(0), found.limit(0)).count() == 0 == duplicates.pair_count(rows.limit(0), found.limit(0))


def walked(hashes, blurs, distance=3):
    """The images gone after the walk over all pairs, and how many pairs there are."""
    less = lambda x, y: x is not None and y is not None and x <= y
    gone: set[int] = set()
    close = [(a, b) for a, b in itertools.combinations(range(len(hashes)), 2) if (hashes[a] ^ hashes[b]).bit_count() <= distance]
    for a, b in close:
        if a not in gone and b not in gone:
            gone.add(a if less(blurs[a], blurs[b]) else b)
    return sorted(gone), len(close)


def chained(rng, copies):
    """Images of a path of twelve hashes, each near the next one only, in one component; a third of them share a hash."""
    steps = [sum(0b11 << 5 * j for j in range(i)) for i in range(12)]
    return [steps[4] if rng.random() < 1 / 3 else rng.choice(steps) for _ in range(copies)]


@pytest.mark.parametrize(("seed", "large"), [(0, 7), (1, 40)])
def test_greedy_drop_in_rounds(spark, seed, large):
    """Large components through rounds and parts, with ties and missing sharpness."""
    rng = random.Random(seed)
    hashes = chained(rng, 90) + [(1 << 60) + (i % 9) for i in range(30)]
    # one hash after the other at first, by turns later on
    hashes[:60] = sorted(hashes[:60])
    blurs = [rng.choice((None, float("nan"))) if rng.random() < 0.04 else float(rng.randint(0, 4)) for _ in hashes]
    rows = spark.createDataFrame(list(zip(range(len(hashes)), hashes, blurs, strict=True)), "ord long, h long, blur double").repartition(3)
    close = duplicates.close_hashes(rows, 2)
    assert sorted(r.ord for r in duplicates.greedy_drop_hashes(rows, close, large).collect()) == walked(hashes, blurs, 2)[0]


def test_rounds_take_runs_at_once(spark):
    """Copies that follow each other are one step, however many: a component of 3,000 images is settled by rounds alone."""
    hashes = [(0, 3, 15)[i // 1000] for i in range(3000)]
    rows = spark.createDataFrame([(i, h, h, float(i % 10)) for i, h in enumerate(hashes)], "ord long, component long, h long, blur double").withColumn("component", F.lit(0).cast("long"))
    links = spark.createDataFrame([(0, 0, 3), (0, 3, 15)], "component long, x long, y long")
    gone, walkers, left, tied = duplicates._rounds(rows, links, 0)
    assert left.count() == tied.count() == 0
    assert sorted(r.ord for r in gone.collect()) == walked(hashes, [float(i % 10) for i in range(3000)], 2)[0]
    assert gone.count() + walkers.count() == 3000


@pytest.mark.parametrize("sharp", [True, False])
def test_parts_of_a_component(spark, sharp):
    """Near hashes that take turns image by image, in parts of a few images; with walkers that stay to the end, and where each image ends the one before."""
    rng = random.Random(8)
    hashes = [h ^ 0x7123456789ABCDEF for h in (0, 3, 15, 63, *chained(rng, 120))]
    blurs = [9.0, 2.0, 8.0, 1.0, *(rng.choice((None, float(rng.randint(0, 3)), rng.random())) for _ in range(120))] if sharp else [float(i) for i in range(124)]
    rows = spark.createDataFrame(list(zip([0] * 124, range(124), hashes, blurs, strict=True)), "component long, ord long, h long, blur double")
    links = duplicates.close_hashes(rows, 2).withColumn("component", F.lit(0).cast("long"))
    walkers = rows.limit(0)
    assert sorted(r.ord for r in duplicates._in_parts(rows, links, walkers, 60).collect()) == walked(hashes, blurs, 2)[0]
    # walkers of before: the first three images as if they had come in rounds
    gone, here = walked(hashes[:3], blurs[:3], 2)[0], [0, 1, 2]
    before = rows.filter(F.col("ord").isin([i for i in here if i not in gone]))
    after = duplicates._in_parts(rows.filter("ord > 2"), links, before, 120)
    assert sorted([*gone, *(r.ord for r in after.collect())]) == walked(hashes, blurs, 2)[0]
    assert duplicates._in_parts(rows.limit(0), links, walkers, 9).count() == 0


def test_walk_keeps_walkers_only():
    """What a stream of a component holds doesn't grow with its images, and the order of frames doesn't matter to it."""
    walk = duplicates._Walk()
    walk.link(0, 1)
    walk.link(1, 2)
    gone = [g for i in range(5000) for g in walk.come(i % 3, i, float(i % 7))]
    assert len(gone) + len(walk.walkers) == 5000 == len(set(gone)) + len(walk.walkers)
    assert len(walk.walkers) <= 2 and sum(map(len, walk.around.values())) <= 4


def test_greedy_drop_with_a_common_hash(spark):
    """A third of the images share a hash, a third a chain of near ones: over 2e10 pairs, which are never made."""
    n, kind = 300_000, F.col("ord") % 3
    h = F.when(kind == 0, 0).when(kind == 1, F.element_at(F.array(*[F.lit(x << 40) for x in (1, 7, 63)]), (F.col("ord") % 9 / 3).cast("int") + 1)).otherwise(F.xxhash64("ord"))
    rows = spark.range(n).withColumnRenamed("id", "ord").select("ord", h.cast("long").alias("h"), (F.col("ord") % 7).cast("double").alias("blur"))
    close = duplicates.close_hashes(rows, 3)
    kept = rows.join(duplicates.greedy_drop_hashes(rows, close), "ord", "left_anti")
    counts = {r.kind: r.n for r in kept.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert duplicates.pair_count(rows, close) > 1e10
    assert counts[2] == n // 3 and 1 <= counts.get(0, 0) + counts.get(1, 0) <= 2


def test_scan_order(spark):
    rows = spark.createDataFrame([(f"d{i % 7}/f{i:03d}",) for i in range(200)], "rel string").repartition(5)
    got = {r.rel: r.ord for r in scan_order(rows, [F.split("rel", "/")]).collect()}
    assert got == {rel: i for i, rel in enumerate(sorted(got, key=lambda x: x.split("/")))}
    assert scan_order(rows.limit(0), [F.col("rel")]).count() == 0


def test_buckets(spark):
    rows = spark.createDataFrame([(1, 64, 64, "square_a.png"), (2, 32, 32, "square_b.png"), (3, 96, 64, "wide.png"), (4, 0, 5, "bad.png")], "id int, w int, h int, path string")
    assigned = buckets.assign_buckets(rows, [(512, 512), (768, 512)])
    assert {(r.bw, r.bh): r.n for r in buckets.bucket_counts(assigned, [(512, 512), (768, 512), (9, 900)]).collect()} == {(512, 512): 2, (768, 512): 1, (9, 900): 0}
    thin = buckets.thin_buckets(assigned, 1).collect()
    assert [(r.bw, r.paths) for r in thin] == [(768, ["wide.png"])]
    none = buckets.assign_buckets(rows.limit(0), [(512, 512)])
    assert [r.n for r in buckets.bucket_counts(none, [(512, 512)]).collect()] == [0]


def test_gate_edges(spark):
    rows = spark.createDataFrame([("a", 10.0, 5.0, None), ("b", 9.9, 5.0, 1.0), ("c", 12.0, 5.1, 1.0), ("d", None, 5.0, 1.0)], "path string, sharp double, noise double, extra double")
    rules = [quality_gate.Scorer("sharp", "lt", 10.0, 11.0), quality_gate.Scorer("noise", "gt", threshold_key="n"), quality_gate.Scorer("extra", "gt", 2.0, optional=True), quality_gate.Scorer("gone", enabled=False)]
    got = {r.path: r for r in quality_gate.gate(rows, rules, {"n": 5.0}).collect()}
    assert [got[p].auto_reject for p in "abcd"] == [False, True, True, True]
    assert got["a"].borderline and not got["b"].borderline
    assert got["b"].auto_reasons == ["sharp 9.9 < 10.0"]
    assert got["a"].quality == pytest.approx(50.0)
    with pytest.raises(KeyError):
        quality_gate.gate(rows, [quality_gate.Scorer("sharp")])
    with pytest.raises(ValueError):
        quality_gate.Scorer("x", "eq")


def test_upscale_boundaries(spark):
    rows = [("p1.png", 1000), ("p2.png", 2000), ("p4.png", 4000), ("j2.jpg", 2000), ("j4.JPEG", 4000)]
    df = spark.createDataFrame([(p, n, n) for p, n in rows], "path string, w int, h int")
    plan = {r.path: r for r in upscale.upscale_plan(df).collect()}
    assert [plan[p].planned_action for p, _ in rows] == ["upscale", "upscale", "pass_through", "upscale", "jpeg_cleanup"]
    assert [plan[p].flagged for p, _ in rows] == [True, False, False, True, True]
    plain = {r.path: r for r in upscale.upscale_plan(df, generative=False).collect()}
    assert plain["j4.JPEG"].planned_action == "pass_through" and not plain["j2.jpg"].flagged
    both = spark.createDataFrame([("a.jpg", 100, 100), ("a.png", 100, 100)], "path string, w int, h int")
    guarded = {r.path: r for r in upscale.guard_collisions(upscale.upscale_plan(both)).collect()}
    assert guarded["a.jpg"].planned_action == "pass_through" and guarded["a.jpg"].dest == "a.jpg" and guarded["a.png"].planned_action == "upscale"


def test_outliers(spark):
    same = spark.createDataFrame([("a", 0.25), ("b", 0.25), ("c", None)], "path string, hf_loss double")
    assert not outliers.hf_outliers(same).filter("outlier").count()
    apart = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", None)], "path string, hf_loss double")
    assert [r.path for r in outliers.hf_outliers(apart, 0.0).filter("outlier").collect()] == ["b"]
    assert outliers.hf_stats(apart.limit(0)).first().threshold is None


def test_export_cases(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "stem string, digest string")
    images, texts = rows(("s/1", "I1"), ("2", "I2"), ("bare", "I3")), rows(("s/1", "c1"), ("2", "c2"))
    counts = lambda ti, tc: export.export_counts(export.export_diff(images, texts, ti, tc)).first().asDict()
    nothing = rows(("x", "y")).limit(0)
    assert counts(nothing, nothing) == {"added": 2, "modified": 0, "unchanged": 0, "orphaned": 0}
    assert counts(rows(("s/1", "I1"), ("2", "I2")), texts)["unchanged"] == 2
    assert counts(rows(("s/1", "I1"), ("2", "I2"), ("old", "z")), rows(("s/1", "other"), ("2", "c2"))) == {"added": 0, "modified": 1, "unchanged": 1, "orphaned": 1}


def test_ledger(spark):
    schema = "path string, verdict string, caption string, resolved boolean, seq long"
    old = spark.createDataFrame([("x/a.png", "wrong", "c", False, 1), ("x/b.png", "generic", "c", True, 2), ("y/b.png", "correct", "c", False, 3)], schema)
    new = spark.createDataFrame([("x/a.png", "correct", "d", False, 9), ("x/a.png", "nonsense", "e", False, 10)], schema)
    now = {r.path: r for r in ledger.upsert(old, new).collect()}
    assert now["x/a.png"].verdict == "correct" and len(now) == 3
    items = spark.createDataFrame([("z/a.png", "c"), ("z/b.png", "c"), ("x/b.png", "c")], "path string, caption string")
    got = {r.path: r for r in ledger.seed_verdicts(ledger.match(items, old)).collect()}
    assert got["z/a.png"].matched_by == "name" and got["z/a.png"].initial_verdict == "wrong"
    assert got["z/b.png"].matched_by is None and got["x/b.png"].initial_verdict == "correct"


def test_sidecars_and_edits(spark):
    raw = spark.createDataFrame([(1, '[{"x1":0.1,"y1":"0.2","x2":0.3,"y2":0.4,"label":"hat"},{"x1":1}]'), (2, "{broken"), (3, None)], "id int, json string")
    got = {r.id: r.boxes for r in captions.parse_boxes(raw).collect()}
    assert len(got[1]) == 1 and got[1][0].y1 == 0.2 and got[2] == [] and got[3] == []
    assert audit.undersized(raw, None).count() == 0


@pytest.mark.parametrize(("box", "place"), [((0.0, 0.0, 1.0, 1.0), "filling the frame"), ((0.0, 0.0, 0.1, 0.1), "a small element in the upper-left"), ((1.0, 0.9, 0.0, 0.7), "across the bottom"), ((-1.0, 0.3, 0.4, 0.6), "on the left")])
def test_box_position(spark, box, place):
    assert spark.range(1).select(g.box_position(*[F.lit(v) for v in box]).alias("p")).first().p == place


def test_step_rules():
    names = [s.name for s in steps.STEPS]
    assert steps.invalidated_by_force(["audit"], names) == ["audit", "bucket_check", "export"]
    assert steps.invalidated_by_force(["audit"], ["import", "export"]) == ["audit", "export"]
    assert steps.in_order(["export", "import", "own"], names) == ["import", "export", "own"]
    assert steps.default_substeps("bucket_check", {}) == ["assign"] and steps.default_substeps("bucket_check", {"cache": True}) == ["assign", "write_cache_info"]
    assert steps.default_substeps("quality_gate", {"manual_review": False}) == ["score_images", "write_survivors"]
    steps.validate(["quality_gate"], names, {"import"})
    for bad in (lambda: steps.validate(["quality_gate"], names, set()), lambda: steps.validate([], names, set()), lambda: steps.validate(["x"], names, set()), lambda: steps.validate(["quality_gate"], names, {"import"}, invalidated=["import"]), lambda: steps.validate(["export"], names, {"import"}, {"export": ["copy"]}), lambda: steps.enabled_substeps("export", ["nope"])):
        with pytest.raises(steps.SelectionError):
            bad()


def test_projects(tmp_path):
    project = config.Project("my-set", "/in", settings={"bucket_check": config.BucketCheck(thin_threshold=3), "quality_gate": config.QualityGate()})
    config.save(project, str(tmp_path))
    config.save(project, str(tmp_path))
    assert config.load("my-set", str(tmp_path)) == project and config.names(str(tmp_path)) == ["my-set"]
    assert config.coerced(config.Curate, {"max_distance": "5", "unknown": 1}).max_distance == 5
    assert config.coerced(config.Audit, {"min_resolution": " "}).min_resolution == 1024
    for bad in ("", "..", ".x", "a/b"):
        with pytest.raises(ValueError):
            config.folder_name(bad)
    with pytest.raises(ValueError):
        config.BucketCheck(buckets=())


def test_spot_check_takes_the_least_hashes(spark):
    rows = spark.range(5000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"))
    for share, seed in ((0.05, 3), (0.2, 0), (1.0, 1), (0.0, 2)):
        want = rows.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(max(1, int(5000 * share)))
        assert {r.path for r in captions.spot_check(rows, share, seed).collect()} == {r.path for r in want.collect()}
    assert captions.spot_check(rows.limit(0), 0.5).count() == 0 and captions.spot_check(rows.limit(1).unionByName(rows.limit(1)), 0.5).count() == 1


def test_caption_edits(spark):
    known = spark.createDataFrame([("/d/a.png", "old"), ("/d/s/b.png", None)], "path string, caption string")
    said = [("/d/a.png", " old\u2003"), ("/d/x/../a.png", "new"), ("/d/../d/a.png", ""), ("/d/../e/a.png", "x"), ("/dd/a.png", "x"), ("/d/./s//b.png", "b"), ("/d/c.png", "c"), ("/d/region__a__01.png", "r")]
    got = {r.path: (r.outcome, r.reason) for r in captions.classify_edits(spark.createDataFrame(said, "path string, text string"), known, "/d").collect()}
    assert got == {
        "/d/a.png": ("unchanged", None), "/d/x/../a.png": ("applied", None), "/d/../d/a.png": ("rejected", "empty"), "/d/../e/a.png": ("rejected", "outside_root"), "/dd/a.png": ("rejected", "outside_root"),
        "/d/./s//b.png": ("applied", None), "/d/c.png": ("rejected", "missing"), "/d/region__a__01.png": ("rejected", "region_artifact"),
    }


def test_caption_classes(spark):
    texts = [None, "", " \u3000", "abcd", " abcde ", "x" * 600, "x" * 601, "abc \n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.k for r in rows.orderBy("i").select(audit.caption_class(F.col("text")).alias("k")).collect()] == ["empty", "empty", "empty", "short", "ok", "ok", "long", "short"]


def test_seeds_and_mock_embeddings(spark):
    import zlib

    paths = ["a/b.png", "é.jpg", ""]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, seed long")
    got = {r.path: r for r in rows.select("path", planning.preview_seed(F.col("path"), F.col("seed")).alias("seed"), coverage.mock_embedding(F.col("path"), 3).alias("v")).collect()}
    for i, p in enumerate(paths):
        assert got[p].seed == (zlib.crc32(p.encode()) + i) % 2**31
        assert got[p].v == pytest.approx([zlib.crc32(f"{p}#{k}".encode()) % 2001 / 1000 - 1 for k in range(3)], abs=1e-6)


def test_verdict_rates(spark, tmp_path):
    from framesift.streaming.ingest import verdict_rates

    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = spark.createDataFrame([(at(1), "wrong"), (at(4), "wrong"), (at(9), "correct"), (at(12), "wrong")], "t string, verdict string")
    rows.select(F.to_timestamp("t").alias("ts"), "verdict").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, verdict string").parquet(str(tmp_path / "in"))
    verdict_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.start.minute, r.verdict): r.n for r in spark.table("rates").collect()} == {(0, "wrong"): 2, (0, "correct"): 1, (10, "wrong"): 1}
