"""Queries on review sessions and the project library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import review
from framesift.queries import query, table

STATES_SQL = """s AS (SELECT event_id AS idx, user_id AS session, 'img' || event_id AS path, event_id % 7 = 0 AS skipped, event_id % 5 = 0 AS dirty, event_id % 3 = 0 AS done,
  CASE WHEN event_id % 2 = 0 THEN ['hat', CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'bench' END] ELSE [] END AS labels FROM events),
e AS (SELECT *, CASE WHEN skipped THEN true WHEN dirty THEN false ELSE done END AS left_alone, list_filter(labels, lambda x: trim(x) <> '') AS named FROM s)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    box = lambda label: F.struct(F.lit(0.1).alias("x1"), label.alias("label"))
    boxes = F.when(k % 2 == 0, F.array(box(F.lit("hat")), box(F.when(k % 4 == 0, " ").otherwise("bench")))).otherwise(F.array().cast("array<struct<x1:double,label:string>>"))
    return table(spark, sf_dir, "events").select(k.alias("idx"), F.col("user_id").alias("session"), F.concat(F.lit("img"), k.cast("string")).alias("path"), (k % 7 == 0).alias("skipped"), (k % 5 == 0).alias("dirty"), (k % 3 == 0).alias("done"), boxes.alias("boxes"))


@query(f"WITH {STATES_SQL} SELECT path, left_alone AS skipped, len(named) AS n_boxes FROM e")
def annotation_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.submitted(_states(spark, sf_dir)).select("path", "skipped", F.size("annotations").cast("long").alias("n_boxes"))


@query(f"WITH {STATES_SQL} SELECT path, CASE WHEN idx = 10 THEN false WHEN dirty THEN left_alone ELSE true END AS skipped FROM e")
def annotation_skip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.submitted(_states(spark, sf_dir), skip_all=True, active=10).select("path", "skipped")


@query(f"WITH {STATES_SQL} SELECT path, CASE WHEN skipped THEN 'skipped' WHEN done AND NOT dirty THEN 'done' WHEN len(labels) > 0 THEN 'has-boxes' ELSE 'empty' END AS state FROM e")
def strip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("path", review.strip_state(F.col("skipped"), F.col("dirty"), F.col("done"), F.col("boxes")).alias("state"))


@query(f"WITH {STATES_SQL} SELECT session, min(idx) FILTER (NOT left_alone AND len(labels) > len(named)) AS idx FROM e GROUP BY session")
def first_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.first_unlabelled(_states(spark, sf_dir), "session")


@query("""SELECT d.doc_id AS path, d.doc_id % 4 <> 0 AND (l.quality IS NULL OR l.quality = 1) AS done, CASE WHEN l.quality = 0 THEN 'wrong' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)""")
def caption_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id").alias("path")
    verdicts = table(spark, sf_dir, "labels").filter("quality = 0").select(k, F.lit("wrong").alias("verdict"))
    return review.caption_descriptors(docs.select(k), docs.filter("doc_id % 4 <> 0").select(k), verdicts)


@query("""SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') OR (c_custkey % 3 = 0 AND contains('/data/' || c_nationkey, '12'))""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("token"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/DATA/"), F.col("c_nationkey").cast("string"))).alias("input_dir"))
    return review.library_search(rows, "12").select("id")


@query("""SELECT name FROM (SELECT c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS mtime FROM customer) ORDER BY coalesce(mtime, 0) DESC, name""")
def library_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("mtime"))
    return review.library_sorted(rows).select("name")


@query("""SELECT o_orderpriority AS step, o_orderstatus AS field, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' THEN 'seed' ELSE 'own ' || o_orderkey END AS value FROM orders""")
def seeded_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("step"), F.col("o_orderstatus").alias("field"), F.concat(F.lit("own "), F.col("o_orderkey").cast("string")).alias("value"))
    seeds = fields.select("step", "field").distinct().withColumn("seed", F.when(F.startswith("step", F.lit("1")) & (F.col("field") == "F"), "seed"))
    return review.seeded_config(fields, seeds)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'the data set that is there stands for the import' WHEN 1 THEN o_orderstatus || ' is done; force runs it again' ELSE o_orderstatus || ' had nothing to do: none' END AS said,
  CASE WHEN o_orderkey % 5 = 0 THEN 'not available' ELSE (o_orderkey % 100) || '/100' END AS quality, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 9)::VARCHAR ELSE printf('%.3f', o_orderkey % 9 + 0.25::DOUBLE) END AS score,
  'gen_' || (o_orderkey % 1000) || '_' || lpad((o_orderkey % 12)::VARCHAR, 3, '0') || '.png' AS preview, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey * 1000003) % 4294967296 END, CASE WHEN o_orderkey % 3 = 0 THEN 7 END, o_orderkey) AS seed, o_orderkey % 100 > 77 AS truncated FROM orders""")
def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    reason = F.when(k % 3 == 0, "legacy_import").when(k % 3 == 1, "already_done").otherwise("none")
    score = F.when(k % 2 == 0, (k % 9).cast("double")).otherwise(k % 9 + F.lit(0.25))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        review.describe_skip(F.col("o_orderstatus"), reason).alias("said"),
        review.quality_text(F.when(k % 5 != 0, k % 100)).alias("quality"),
        review.score_text(score).alias("score"),
        review.preview_name(k % 1000, k % 12).alias("preview"),
        review.next_seed(F.when(k % 4 == 0, k * 1000003), F.when(k % 3 == 0, F.lit(7).cast("long")), k).alias("seed"),
        review.prompt_truncated(k % 100, F.lit(77)).alias("truncated"),
    )


@query("""SELECT c_nationkey AS step, NOT c_nationkey % 4 = 0 AND sum(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) > 0 AS findings FROM customer GROUP BY c_nationkey""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(F.count_if(F.col("c_custkey") % 5 == 0), F.lit(0).cast("long"))
    reports = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("step")).agg(counts.alias("counts")).withColumn("skipped", F.col("step") % 4 == 0)
    return reports.select("step", review.has_findings(reports).alias("findings"))
