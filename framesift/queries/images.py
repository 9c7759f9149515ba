"""Queries on sizes, buckets, gates, duplicates, upscaling and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import geometry as g
from framesift.functions import planning
from framesift.operators import buckets, coverage, duplicates, neighbours, outliers, quality_gate, upscale
from framesift.operators.order import scan_order
from framesift.queries import query, table
from framesift.queries.samples import IMAGES_SQL, images

BUCKETS_SQL = "b(ord, bw, bh) AS (VALUES " + ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(g.BUCKETS)) + ")"
ASSIGNED_SQL = f"""{IMAGES_SQL}, {BUCKETS_SQL},
assigned AS (SELECT * FROM (
  SELECT i.*, b.*, round(abs(ln(w / h) - ln(bw / bh)), 12) AS dist,
         row_number() OVER (PARTITION BY id ORDER BY round(abs(ln(w / h) - ln(bw / bh)), 12), ord) AS rn FROM images i CROSS JOIN b) WHERE rn = 1)
"""
CROP_SQL = """CASE WHEN w / h > bw / bh THEN 'centre-crop width to ' || trunc(h * (bw / bh))::BIGINT || 'px (from ' || w || 'px)'
  ELSE 'centre-crop height to ' || trunc(w / (bw / bh))::BIGINT || 'px (from ' || h || 'px)' END"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.assign_buckets(images(spark, sf_dir), digits=12)


@query(f"WITH {ASSIGNED_SQL} SELECT id, bw, bh, ord FROM assigned")
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("id", "bw", "bh", "ord")


@query(f"WITH {ASSIGNED_SQL} SELECT b.bw, b.bh, count(a.id) AS n FROM b LEFT JOIN assigned a ON a.ord = b.ord GROUP BY ALL")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_counts(_assigned(spark, sf_dir))


THIN_BUCKETS = [*g.BUCKETS, (3000, 300), (300, 3000), (2048, 400)]
THIN_SQL = ASSIGNED_SQL.replace(BUCKETS_SQL, "b(ord, bw, bh) AS (VALUES " + ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(THIN_BUCKETS)) + ")")


@query(f"""WITH {THIN_SQL}, few AS (SELECT *, {CROP_SQL} AS crop, count(*) OVER (PARTITION BY ord) AS n FROM assigned),
firsts AS (SELECT bw, bh, n, crop, min(path || crop) AS place FROM few WHERE n <= 150 GROUP BY ALL),
s AS (SELECT bw, bh, string_agg(crop, '; ' ORDER BY place) AS suggestion FROM firsts GROUP BY bw, bh)
SELECT bw, bh, n, string_agg(path, '|' ORDER BY path, crop) AS paths, any_value(suggestion) AS suggestion FROM few JOIN s USING (bw, bh) WHERE n <= 150 GROUP BY bw, bh, n""")
def thin_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = buckets.thin_buckets(buckets.assign_buckets(images(spark, sf_dir), THIN_BUCKETS, digits=12), threshold=150)
    return found.withColumn("paths", F.array_join("paths", "|"))


@query(f"""WITH {ASSIGNED_SQL}, c AS (SELECT b.bw, b.bh, count(a.id) AS n FROM b LEFT JOIN assigned a ON a.ord = b.ord GROUP BY ALL)
SELECT bw, bh, n, CASE WHEN n = 0 THEN 'empty' WHEN n <= 200 THEN 'thin' ELSE 'healthy' END AS status FROM c""")
def bucket_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_status(buckets.bucket_counts(_assigned(spark, sf_dir)), threshold=200)


@query(f"""WITH {ASSIGNED_SQL}, c AS (SELECT b.bw, b.bh, count(a.id) AS n FROM b LEFT JOIN assigned a ON a.ord = b.ord GROUP BY ALL)
SELECT count(*) AS total, count_if(n > 0)::BIGINT AS populated, count_if(n > 0 AND n <= 200)::BIGINT AS thin, sum(n)::BIGINT AS images FROM c""")
def bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_summary(buckets.bucket_counts(_assigned(spark, sf_dir)), threshold=200)


@query(f"""WITH {ASSIGNED_SQL}, c AS (SELECT bw || 'x' || bh AS bucket, count(*) AS n FROM assigned GROUP BY ALL)
SELECT '{{' || string_agg('"' || bucket || '":' || n, ',' ORDER BY bucket) || '}}' AS cache_info FROM c""")
def cache_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.cache_info(buckets.bucket_counts(_assigned(spark, sf_dir)))


@query(f"WITH {ASSIGNED_SQL} SELECT id, {CROP_SQL} AS suggestion FROM assigned")
def crop_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("id", g.crop_suggestion(F.col("w"), F.col("h"), F.col("bw"), F.col("bh")).alias("suggestion"))


@query(f"WITH {ASSIGNED_SQL} SELECT id, floor((1 - least((w / h) / (bw / bh), (bw / bh) / (w / h))) * 100 + 0.5)::BIGINT AS loss FROM assigned")
def crop_loss_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("id", g.crop_loss_pct(F.col("w"), F.col("h"), F.col("bw"), F.col("bh")).alias("loss"))


@query(f"""WITH {IMAGES_SQL}, m AS (SELECT id, least(w, h) AS s, w, h FROM images)
SELECT id, CASE WHEN abs(s / 2 - 1024) <= abs(s / 3 - 1024) THEN 2 ELSE 3 END AS divisor, greatest(1, s // 2) AS halved,
  greatest(256, w // 64 * 64) AS snap64, greatest(8, h // 8 * 8) AS snap8 FROM m""")
def snap_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.least("w", "h")
    return images(spark, sf_dir).select("id", g.downscale_divisor(side).alias("divisor"), F.greatest(F.lit(1).cast("long"), F.floor(side / 2)).alias("halved"), g.snap(F.col("w"), 64, 256).alias("snap64"), g.snap(F.col("h"), 8, 8).alias("snap8"))


@query(f"""WITH {IMAGES_SQL} SELECT id, CASE WHEN w * h > 1048576 THEN greatest(1, trunc(w * sqrt(1048576.0::DOUBLE / (w * h)))::BIGINT) ELSE w END AS new_w,
  CASE WHEN w * h > 1048576 THEN greatest(1, trunc(h * sqrt(1048576.0::DOUBLE / (w * h)))::BIGINT) ELSE h END AS new_h FROM images""")
def pixel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = g.pixel_budget(F.col("w"), F.col("h"))
    return images(spark, sf_dir).select("id", size["w"].alias("new_w"), size["h"].alias("new_h"))


BOXES_SQL = """boxes AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * 9 AS x1, l_tax * 10 AS y1, (l_quantity % 11) / 10 AS x2, (l_quantity % 13) / 11 - 0.1 AS y2 FROM lineitem)"""
SORTED_SQL = """s AS (SELECT id, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM (
  SELECT id, least(1.0, greatest(0.0, x1)) AS a, least(1.0, greatest(0.0, y1)) AS b, least(1.0, greatest(0.0, x2)) AS c, least(1.0, greatest(0.0, y2)) AS d FROM boxes))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 9).alias("x1"), (F.col("l_tax") * 10).alias("y1"), ((q % 11) / 10).alias("x2"), ((q % 13) / 11 - 0.1).alias("y2"))


ZONE_X = "CASE WHEN cx < 0.30 THEN '{}' WHEN cx < 0.62 THEN '{}' ELSE '{}' END"


@query(f"""WITH {BOXES_SQL}, {SORTED_SQL}, z AS (SELECT id, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM s),
p AS (SELECT *, CASE WHEN cy < 0.30 THEN {ZONE_X.format('in the upper-left', 'at the top-center', 'in the upper-right')}
  WHEN cy < 0.62 THEN {ZONE_X.format('on the left', 'in the center', 'on the right')} ELSE {ZONE_X.format('in the lower-left', 'at the bottom-center', 'in the lower-right')} END AS corner FROM z)
SELECT id, CASE WHEN w >= 0.66 AND h >= 0.66 THEN CASE WHEN w * h >= 0.75 THEN 'filling the frame' ELSE 'spread across most of the frame' END
  WHEN w >= 0.66 THEN CASE WHEN cy < 0.30 THEN 'across the top' WHEN cy < 0.62 THEN 'across the middle' ELSE 'across the bottom' END
  WHEN h >= 0.66 THEN {ZONE_X.format('down the left side', 'down the center', 'down the right side')}
  WHEN w * h < 0.06 THEN 'a small element ' || corner ELSE corner END AS position FROM p""")
def box_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("id", g.box_position(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("position"))


@query(f"""WITH {BOXES_SQL}, {SORTED_SQL}, p AS (SELECT id, least(trunc(x1 * 640)::BIGINT, 639) AS "left", least(trunc(y1 * 480)::BIGINT, 479) AS top, trunc(x2 * 640)::BIGINT AS r, trunc(y2 * 480)::BIGINT AS b FROM s)
SELECT id, "left", top, greatest("left" + 1, r) AS "right", greatest(top + 1, b) AS bottom FROM p""")
def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = g.crop_bounds(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640).cast("long"), F.lit(480).cast("long"))
    return _boxes(spark, sf_dir).select("id", at.alias("b")).select("id", "b.*")


@query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '0.1,0.2,' || (p_size / 100) || ',0.9: ' || p_name WHEN 1 THEN (p_size * 10) || ', 40,20,' || p_size WHEN 2 THEN 'a,b,c,d' ELSE '1,2,3' END AS spec FROM part),
l AS (SELECT id, string_split(split_part(spec, ':', 1), ',') AS parts, trim(CASE WHEN contains(spec, ':') THEN substr(spec, instr(spec, ':') + 1) ELSE '' END) AS label FROM p),
n AS (SELECT id, label, list_transform(parts, lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS v FROM l),
k AS (SELECT id, label, CASE WHEN len(list_filter(v, lambda x: x <= 1.0)) = 4 THEN v ELSE [v[1] / 800, v[2] / 600, v[3] / 800, v[4] / 600] END AS v FROM n WHERE len(v) = 4 AND len(list_filter(v, lambda x: x IS NULL)) = 0),
c AS (SELECT id, label, list_transform(v, lambda x: least(1.0, greatest(0.0, x))) AS v FROM k)
SELECT id, least(v[1], v[3]) AS x1, least(v[2], v[4]) AS y1, greatest(v[1], v[3]) AS x2, greatest(v[2], v[4]) AS y2, label FROM c""")
def parse_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    spec = F.when(k % 4 == 0, F.concat(F.lit("0.1,0.2,"), (size / 100).cast("string"), F.lit(",0.9: "), F.col("p_name"))).when(k % 4 == 1, F.concat((size * 10).cast("string"), F.lit(", 40,20,"), size.cast("string"))).when(k % 4 == 2, "a,b,c,d").otherwise("1,2,3")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), g.parse_box(spec, F.lit(800.0), F.lit(600.0)).alias("b"))
    return rows.filter("b IS NOT NULL").select("id", "b.*")


GATE = (quality_gate.Scorer("min_side", "lt", 20.0), quality_gate.Scorer("blur", "lt", 20000.0, 40000.0), quality_gate.Scorer("noise", "gt", 0.08), quality_gate.Scorer("jpeg", "gt", 0.06, optional=True))
SCORED_SQL = """scored AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS min_side, l_extendedprice AS blur, l_discount AS noise, CASE WHEN l_linenumber <> 3 THEN l_tax END AS jpeg FROM lineitem),
gated AS (SELECT *, min_side < 20.0 OR blur < 20000.0 OR noise > 0.08 OR coalesce(jpeg > 0.06, false) AS auto_reject, blur < 40000.0 AS near,
  concat_ws('; ', CASE WHEN min_side < 20.0 THEN 'min_side' END, CASE WHEN blur < 20000.0 THEN 'blur' END, CASE WHEN noise > 0.08 THEN 'noise' END, CASE WHEN jpeg > 0.06 THEN 'jpeg' END) AS failed,
  list_filter([least(1.0, greatest(0.0, min_side / 40.0)), least(1.0, greatest(0.0, blur / 40000.0)), least(1.0, greatest(0.0, 1 - noise / 0.16)), least(1.0, greatest(0.0, 1 - jpeg / 0.12))], lambda x: x IS NOT NULL) AS q
  FROM (SELECT * FROM scored))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("min_side"), F.col("l_extendedprice").alias("blur"), F.col("l_discount").alias("noise"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("jpeg"))


@query(f"WITH {SCORED_SQL} SELECT id, auto_reject, NOT auto_reject AND near AS borderline, failed FROM gated")
def quality_gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = quality_gate.gate(_scored(spark, sf_dir), GATE)
    return gated.select("id", "auto_reject", "borderline", F.array_join(F.transform("auto_reasons", lambda r: F.substring_index(r, " ", 1)), "; ").alias("failed"))


JPEG_CLAMP = "CASE WHEN jpeg IS NULL THEN NULL ELSE least(1.0, greatest(0.0, 1 - jpeg / 0.12)) END"
QUALITY_SQL = SCORED_SQL.replace("least(1.0, greatest(0.0, 1 - jpeg / 0.12))", JPEG_CLAMP)


@query(f"WITH {QUALITY_SQL}, r AS (SELECT id, 100 * list_sum(q) / len(q) AS quality FROM gated) SELECT id, quality, CASE WHEN quality >= 66 THEN 'green' WHEN quality >= 40 THEN 'amber' ELSE 'red' END AS band FROM r")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_gate.gate(_scored(spark, sf_dir), GATE).select("id", "quality")
    return rows.withColumn("band", quality_gate.quality_band(F.col("quality")))


DECIDED_SQL = f"""{SCORED_SQL}, decided AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'flag' WHEN id % 13 = 0 THEN 'keep' WHEN id % 17 = 0 THEN 'reject' WHEN auto_reject THEN 'reject' ELSE 'keep' END AS decision FROM gated)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    said = F.when(F.col("id") % 11 == 0, "flag").when(F.col("id") % 13 == 0, "keep").when(F.col("id") % 17 == 0, "reject")
    decisions = scored.select("id", said.alias("decision")).filter("decision IS NOT NULL").distinct()
    return quality_gate.apply_decisions(quality_gate.gate(scored, GATE), decisions, "id")


@query(f"WITH {DECIDED_SQL} SELECT id, decision, decision IN ('keep', 'flag') AS kept FROM decided")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("id", "decision", "kept")


@query(f"WITH {DECIDED_SQL} SELECT count(*) AS total, count_if(decision IN ('keep', 'flag'))::BIGINT AS kept, count_if(decision = 'reject')::BIGINT AS rejected, count_if(decision = 'flag')::BIGINT AS flagged FROM decided")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gate.gate_counts(_decided(spark, sf_dir))


@query(f"WITH {DECIDED_SQL} SELECT s.id, s.blur FROM scored s SEMI JOIN (SELECT id FROM decided WHERE decision <> 'reject') d ON s.id = d.id")
def gate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gate.survivors(_scored(spark, sf_dir), _decided(spark, sf_dir), "id").select("id", "blur")


#: Sign bits of the embeddings, with copies of one to four flipped bits, so that pairs lie on both sides of a small distance.
HASHES_SQL = """signs AS (SELECT vec_id, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS h, embedding[1]::DOUBLE AS blur FROM embeddings),
hashes AS (SELECT vec_id * 5 + k AS ord, xor(h, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1::BIGINT << (vec_id % 60)::INT WHEN 2 THEN 3::BIGINT << (vec_id % 60)::INT WHEN 3 THEN 7::BIGINT << (vec_id % 60)::INT ELSE 15::BIGINT << (vec_id % 59)::INT END) AS h, round(blur, 1) AS blur FROM signs, (VALUES (0), (1), (2), (3), (4)) AS t(k))"""
PAIRS_SQL = "pairs AS (SELECT a.ord AS a, b.ord AS b, bit_count(xor(a.h, b.h))::INT AS dist FROM hashes a JOIN hashes b ON a.ord < b.ord AND bit_count(xor(a.h, b.h)) <= {})"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(F.slice("embedding", 1, 63), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    signs = table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b).alias("h"), F.col("embedding")[0].cast("double").alias("blur"))
    shift = lambda n, m: F.call_function("shiftleft", F.lit(n).cast("long"), (F.col("vec_id") % m).cast("int"))
    copies = signs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    mask = F.when(F.col("k") == 0, F.lit(0).cast("long")).when(F.col("k") == 1, shift(1, 60)).when(F.col("k") == 2, shift(3, 60)).when(F.col("k") == 3, shift(7, 60)).otherwise(shift(15, 59))
    return copies.select((F.col("vec_id") * 5 + F.col("k")).alias("ord"), F.col("h").bitwiseXOR(mask).alias("h"), F.round("blur", 1).alias("blur"))


@query(f"WITH {HASHES_SQL}, {PAIRS_SQL.format(3)} SELECT a, b, dist FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_dup_pairs(_hashes(spark, sf_dir), 3)


@query(f"WITH {HASHES_SQL}, {PAIRS_SQL.format(20)} SELECT a, b, dist FROM pairs")
def near_dup_pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_dup_pairs(_hashes(spark, sf_dir), 20)


@query(f"WITH {HASHES_SQL}, {PAIRS_SQL.format(8)} SELECT a, b, dist FROM pairs")
def near_dup_pairs_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_dup_pairs(_hashes(spark, sf_dir), 8)


@query()
def greedy_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = _hashes(spark, sf_dir)
    return duplicates.greedy_drop_hashes(hashes, duplicates.close_hashes(hashes, 3))


PLAN_SQL = f"""{IMAGES_SQL}, plan AS (SELECT *, least(w, h) AS min_side, regexp_matches(lower(path), '\\.jpe?g$') AS is_jpeg, regexp_matches(lower(path), '\\.jpe?g$') AND least(w, h) >= 700 AS needs_pre_downscale,
  CASE WHEN least(w, h) < 1800 THEN 'upscale' WHEN regexp_matches(lower(path), '\\.jpe?g$') AND least(w, h) >= 700 THEN 'jpeg_cleanup' ELSE 'pass_through' END AS planned_action FROM images),
planned AS (SELECT *, min_side <= 700 OR needs_pre_downscale AS flagged FROM plan)"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upscale.upscale_plan(images(spark, sf_dir), target=1800, highlight=700)


@query(f"WITH {PLAN_SQL} SELECT id, min_side, is_jpeg, needs_pre_downscale, planned_action, flagged FROM planned")
def upscale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("id", "min_side", "is_jpeg", "needs_pre_downscale", "planned_action", "flagged")


DEST_SQL = "CASE WHEN planned_action <> 'pass_through' AND is_jpeg THEN regexp_replace(path, '\\.[^./]*$', '.png') ELSE path END"


@query(f"""WITH {PLAN_SQL}, d AS (SELECT *, {DEST_SQL} AS first_dest FROM planned), c AS (SELECT *, count(*) OVER (PARTITION BY first_dest) > 1 AND is_jpeg AND planned_action <> 'pass_through' AS collides FROM d)
SELECT id, collides, CASE WHEN collides THEN 'pass_through' ELSE planned_action END AS planned_action, flagged AND NOT collides AS flagged, CASE WHEN collides THEN path ELSE first_dest END AS dest FROM c""")
def upscale_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the folder alone tells images apart here, so that a JPEG and a PNG can meet in one name
    return upscale.guard_collisions(_planned(spark, sf_dir)).select("id", "collides", "planned_action", "flagged", "dest")


@query(f"""WITH {PLAN_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'pass_through' ELSE planned_action END AS planned_action FROM planned""")
def upscale_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _planned(spark, sf_dir)
    return upscale.review(plan, plan.filter("id % 5 = 0").select("path", F.lit("skip").alias("decision"))).select("id", "planned_action")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 4 OR l_linenumber = 5 THEN 'skipped' WHEN l_quantity / 50 < 0.6 THEN 'rejected_post' ELSE 'upscaled' END AS outcome FROM lineitem""")
def upscale_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), F.when(n != 4, F.col("l_quantity") / 50).alias("ssim"), F.when(n == 5, "failed").alias("error"))
    return upscale.outcomes(rows).select("id", "outcome")


@query(f"""WITH {PLAN_SQL} SELECT greatest(1800, min_side) AS target_side, count(*) AS n, count_if(abs(min_side / 2 - 1024) <= abs(min_side / 3 - 1024))::BIGINT AS by_two
FROM planned WHERE planned_action = 'jpeg_cleanup' OR (planned_action = 'upscale' AND needs_pre_downscale) GROUP BY ALL""")
def cleanup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upscale.cleanup_groups(_planned(spark, sf_dir), target=1800)


@query(f"""WITH {IMAGES_SQL}, f AS (SELECT * FROM images ORDER BY path LIMIT 500), r AS (SELECT count(*) AS scanned, count_if(least(w, h) <= 900)::BIGINT AS undersized, count_if(path LIKE '%.jpg')::BIGINT AS jpeg FROM f)
SELECT *, undersized > 0 OR jpeg > 0 AS recommended FROM r""")
def upscale_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upscale.attention(images(spark, sf_dir), threshold=900, cap=500)


def _hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), "event_type", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("hf_loss"))


HF_SQL = "hf AS (SELECT event_id AS path, event_type, CASE WHEN event_id % 97 <> 0 THEN value END AS hf_loss FROM events)"


@query(f"WITH {HF_SQL} SELECT count(hf_loss) AS successful, count_if(hf_loss IS NULL)::BIGINT AS failed, round(avg(hf_loss), 6) AS mean, round(stddev_pop(hf_loss), 6) AS std, round(avg(hf_loss) + 2 * stddev_pop(hf_loss), 6) AS threshold FROM hf")
def hf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = outliers.hf_stats(_hf(spark, sf_dir))
    return s.select("successful", "failed", *[F.round(c, 6).alias(c) for c in ("mean", "std", "threshold")])


@query(f"WITH {HF_SQL}, s AS (SELECT event_type, avg(hf_loss) + 1.5 * stddev_pop(hf_loss) AS t FROM hf GROUP BY event_type) SELECT path, hf.event_type, coalesce(hf_loss > t, false) AS outlier FROM hf JOIN s USING (event_type)")
def hf_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.hf_outliers(_hf(spark, sf_dir), 1.5, ["event_type"]).select("path", "event_type", "outlier")


@query(f"WITH {HF_SQL} SELECT path FROM hf WHERE path % 6 <> 0")
def hf_drop_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hf(spark, sf_dir)
    said = F.when(F.col("path") % 6 == 0, "drop").when(F.col("path") % 6 == 1, "keep").otherwise("whatever")
    return outliers.apply_drops(rows, rows.select("path", said.alias("decision"))).select("path")


@query()
def coverage_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.percent_coordinates(coverage.principal_plane(table(spark, sf_dir, "embeddings"), "vec_id"))


@query()
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("embedding IS NOT NULL")
    placed = scan_order(rows, [F.col("vec_id")]).withColumnRenamed("embedding", "vector")
    graph, ids = neighbours.neighbour_graph(placed.select("ord", "vector"), 10), placed.select("ord", "vec_id")
    named = graph.join(ids.select(F.col("ord").alias("u"), "vec_id"), "u").join(ids.select(F.col("ord").alias("v"), F.col("vec_id").alias("near_id")), "v")
    return named.select("vec_id", "near_id", F.col("d").alias("distance"))


@query()
def coverage_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.percent_coordinates(neighbours.coverage_layout(table(spark, sf_dir, "embeddings"), "vec_id"))


@query("""WITH p AS (SELECT p_partkey AS id, 'set' || (p_partkey % 7) AS parent, p_name || CASE WHEN p_partkey % 5 = 0 THEN '_' || p_partkey || '_of_a_long_series.png' ELSE '.png' END AS name FROM part),
l AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN parent || '/' || name ELSE name END AS label FROM p)
SELECT id, CASE WHEN length(label) > 24 THEN '…' || right(label, 23) ELSE label END AS label FROM l""")
def point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.when(k % 5 == 0, F.concat(F.lit("_"), k.cast("string"), F.lit("_of_a_long_series.png"))).otherwise(".png"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("set"), (k % 7).cast("string")).alias("parent"), name.alias("name"))
    return coverage.point_labels(rows).select("id", "label")


@query()
def mock_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", coverage.mock_embedding(F.col("path")).alias("embedding"))


@query("""WITH m AS (SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS gb, s_suppkey % 3 > 0 AS cuda, s_suppkey % 5 > 0 AS quantizer, CASE s_suppkey % 4 WHEN 0 THEN 'seed_7b_fp16' WHEN 1 THEN 'seed_7b_fp8' WHEN 2 THEN 'seed_3b_fp16' ELSE 'seed_3b_fp8' END AS model FROM supplier)
SELECT id, CASE WHEN gb <= 16 THEN 'ViT-B-32' WHEN gb <= 24 THEN 'facebook/dinov2-base' WHEN gb <= 32 THEN 'Qwen/Qwen3-VL-Embedding-2B' ELSE 'Qwen/Qwen3-VL-Embedding-8B' END AS embedding,
  CASE WHEN gb <= 0 THEN 'stable-diffusion-v1-5/stable-diffusion-v1-5' WHEN gb <= 16 THEN 'stabilityai/stable-diffusion-xl-base-1.0' ELSE 'black-forest-labs/FLUX.2-klein-base-9B' END AS render,
  CASE WHEN NOT cuda OR NOT quantizer THEN 'none' WHEN gb > 0 AND gb <= 16 THEN '4bit' WHEN gb <= 32 THEN '8bit' ELSE 'none' END AS quantization,
  CASE WHEN gb >= CASE model WHEN 'seed_7b_fp16' THEN 40 WHEN 'seed_7b_fp8' THEN 24 WHEN 'seed_3b_fp16' THEN 24 ELSE 16 END THEN 'gpu' ELSE 'cpu' END AS residency FROM m""")
def vram_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    model = F.when(k % 4 == 0, "seed_7b_fp16").when(k % 4 == 1, "seed_7b_fp8").when(k % 4 == 2, "seed_3b_fp16").otherwise("seed_3b_fp8")
    gb = (k % 50).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), planning.embedding_model(gb).alias("embedding"), planning.render_model(gb).alias("render"), planning.caption_quantization(gb, k % 3 > 0, k % 5 > 0).alias("quantization"), planning.residency(F.lit("auto"), model, gb).alias("residency"))


@query("""WITH m AS (SELECT p_partkey AS id, (p_size % 14)::DOUBLE AS params, (p_partkey % 9)::DOUBLE AS txt, (p_partkey % 48)::DOUBLE AS total, (p_partkey % 31)::DOUBLE AS free, p_partkey % 4 > 0 AS cuda, p_partkey % 5 > 0 AS quantizer,
  CASE p_partkey % 6 WHEN 0 THEN '4bit' WHEN 1 THEN '8bit' WHEN 2 THEN 'none' ELSE 'auto' END AS quantization, CASE WHEN p_partkey % 7 = 0 THEN 'sequential' ELSE 'auto' END AS offload FROM part),
n AS (SELECT *, (params + txt) * 2.0::DOUBLE * 1.15::DOUBLE AS need, CASE WHEN free = 0 THEN total * 0.85::DOUBLE ELSE least(total * 0.85::DOUBLE, greatest(free - 1.0, 0.0)) END AS room,
  CASE WHEN quantization IN ('4bit', '8bit') AND NOT cuda THEN 'needs CUDA' WHEN quantization IN ('4bit', '8bit') AND NOT quantizer THEN 'needs a quantizer' END AS error FROM m),
c AS (SELECT *, CASE WHEN quantization <> 'auto' THEN quantization WHEN NOT quantizer OR room = 0 OR need <= room THEN 'none' ELSE '4bit' END AS chosen FROM n),
h AS (SELECT *, need / CASE chosen WHEN '4bit' THEN 3.6::DOUBLE WHEN '8bit' THEN 1.9::DOUBLE ELSE 1.0::DOUBLE END AS held FROM c),
o AS (SELECT *, CASE WHEN offload <> 'auto' THEN offload WHEN room = 0 THEN 'model' WHEN held <= room * 0.75::DOUBLE THEN 'none' WHEN held <= room THEN 'model' ELSE 'sequential' END AS placed FROM h)
SELECT id, CASE WHEN error IS NULL THEN CASE WHEN NOT cuda THEN 'none' WHEN chosen = '4bit' AND placed = 'sequential' THEN 'none' ELSE chosen END END AS quantization,
  CASE WHEN error IS NULL THEN CASE WHEN cuda THEN placed ELSE 'none' END END AS offload, CASE WHEN error IS NULL THEN CASE WHEN cuda THEN 'cuda' ELSE 'cpu' END END AS device,
  CASE WHEN error IS NULL THEN CASE WHEN cuda THEN 'bfloat16' ELSE 'float32' END END AS dtype, error FROM o""")
def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("p_partkey"), "double"
    quantization = F.when(k % 6 == 0, "4bit").when(k % 6 == 1, "8bit").when(k % 6 == 2, "none").otherwise("auto")
    offload = F.when(k % 7 == 0, "sequential").otherwise("auto")
    plan = planning.generation_plan((F.col("p_size") % 14).cast(d), (k % 9).cast(d), (k % 48).cast(d), (k % 31).cast(d), k % 4 > 0, k % 5 > 0, quantization, offload)
    return table(spark, sf_dir, "part").select(k.alias("id"), plan.alias("p")).select("id", "p.*")


@query()
def preview_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", planning.preview_seed(F.col("path"), F.col("id")).alias("seed"))
