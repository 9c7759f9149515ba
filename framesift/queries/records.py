"""Queries on pairing, export, the verdict ledger and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions import planning, text
from framesift.operators import audit, captions, export, ledger, regions, run_state
from framesift.plans import steps
from framesift.queries import query, table
from framesift.queries.samples import IMAGES_SQL, LEDGER_SQL, images, records


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS stem, CASE WHEN l.doc_id IS NULL THEN 'orphan_image' WHEN d.doc_id IS NULL THEN 'orphan_caption' ELSE 'paired' END AS status
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 <> 3) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("stem"))
    return audit.pairing(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem")))


@query("SELECT doc_id AS stem FROM documents INTERSECT SELECT doc_id FROM labels")
def stems_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.col("doc_id").alias("stem")
    return table(spark, sf_dir, "documents").select(stem).intersect(table(spark, sf_dir, "labels").select(stem))


@query("SELECT doc_id AS stem FROM documents EXCEPT SELECT doc_id FROM labels")
def stems_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.col("doc_id").alias("stem")
    return table(spark, sf_dir, "documents").select(stem).subtract(table(spark, sf_dir, "labels").select(stem))


@query("SELECT doc_id AS stem FROM documents UNION SELECT doc_id + 500 FROM labels")
def names_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem")).union(table(spark, sf_dir, "labels").select((F.col("doc_id") + 500).alias("stem"))).distinct()


@query(f"WITH {IMAGES_SQL} SELECT regexp_replace(path, '\\.[^./]*$', '') AS stem, max(path) AS rel FROM images GROUP BY 1")
def last_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.last_by_stem(images(spark, sf_dir).withColumnRenamed("path", "rel"))


#: A text without white space at its ends.
TRIMMED = "regexp_replace(coalesce({}, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, length({TRIMMED.format('text')}) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'empty' WHEN n < 5 THEN 'short' WHEN n > 600 THEN 'long' ELSE 'ok' END AS class FROM t""")
def caption_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", audit.caption_class(F.col("text")).alias("class"))


@query(f"WITH {IMAGES_SQL} SELECT id FROM images WHERE id % 19 <> 0 AND least(w, h) < 1024")
def undersized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.undersized(images(spark, sf_dir).withColumn("corrupt", F.col("id") % 19 == 0), 1024).select("id")


@query(f"""WITH {IMAGES_SQL}, c AS (SELECT length({TRIMMED.format('text')}) AS n FROM documents),
a AS (SELECT count_if(l.doc_id IS NULL)::BIGINT AS orphan_images, count_if(d.doc_id IS NULL)::BIGINT AS orphan_captions, count_if(l.doc_id = d.doc_id)::BIGINT AS paired
      FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id),
b AS (SELECT count_if(n = 0)::BIGINT AS empty, count_if(n > 0 AND n < 5)::BIGINT AS short, count_if(n > 600)::BIGINT AS long FROM c),
i AS (SELECT count_if(id % 19 = 0)::BIGINT AS corrupt, count_if(id % 19 <> 0 AND least(w, h) < 1024)::BIGINT AS undersized FROM images)
SELECT *, orphan_images + orphan_captions + corrupt + empty + undersized AS issues, orphan_images + orphan_captions + corrupt + empty + undersized = 0 AS passed FROM a, b, i""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = audit.pairing(docs.select(F.col("doc_id").alias("stem")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem")))
    return audit.audit_summary(pairs, docs.select("text"), images(spark, sf_dir).withColumn("corrupt", F.col("id") % 19 == 0), 1024)


EXPORT_SQL = """f AS (SELECT doc_id, text FROM documents),
s AS (SELECT doc_id AS stem, sha1(text) AS si, sha1(text) AS sc FROM f WHERE doc_id % 7 <> 0),
t AS (SELECT doc_id AS stem, sha1(CASE WHEN doc_id % 5 = 1 THEN text || 'x' ELSE text END) AS ti, CASE WHEN doc_id % 9 <> 4 THEN sha1(CASE WHEN doc_id % 11 = 2 THEN text || 'y' ELSE text END) END AS tc FROM f WHERE doc_id % 8 <> 0),
k AS (SELECT coalesce(s.stem, t.stem) AS stem, CASE WHEN si IS NULL THEN 'orphaned' WHEN ti IS NULL THEN 'added' WHEN si = ti THEN 'unchanged' ELSE 'modified' END AS image_status,
  CASE WHEN sc IS NULL THEN 'orphaned' WHEN tc IS NULL THEN 'added' WHEN sc = tc THEN 'unchanged' ELSE 'modified' END AS caption_status FROM s FULL JOIN t ON s.stem = t.stem),
d AS (SELECT *, CASE WHEN image_status IN ('added', 'orphaned') THEN image_status WHEN image_status = 'unchanged' AND caption_status = 'unchanged' THEN 'unchanged' ELSE 'modified' END AS status FROM k)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    digest = lambda x: F.sha1(x.cast("binary")).alias("digest")
    source = docs.filter(k % 7 != 0)
    target = docs.filter(k % 8 != 0)
    return export.export_diff(
        source.select(k.alias("stem"), digest(F.col("text"))),
        source.select(k.alias("stem"), digest(F.col("text"))),
        target.select(k.alias("stem"), digest(F.when(k % 5 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")))),
        target.filter(k % 9 != 4).select(k.alias("stem"), digest(F.when(k % 11 == 2, F.concat("text", F.lit("y"))).otherwise(F.col("text")))),
    )


@query(f"WITH {EXPORT_SQL} SELECT * FROM d")
def export_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"WITH {EXPORT_SQL} SELECT " + ", ".join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in ("added", "modified", "unchanged", "orphaned")) + " FROM d")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_counts(_diff(spark, sf_dir))


@query(f"WITH {EXPORT_SQL} SELECT stem, CASE status WHEN 'added' THEN 0 ELSE 1 END AS rank FROM d WHERE status IN ('added', 'modified') AND stem % 3 <> 0")
def export_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = _diff(spark, sf_dir)
    return export.to_copy(diff, diff.filter("stem % 3 = 0")).select("stem", "rank")


@query("""WITH s AS (SELECT doc_id AS rel, strlen(text) AS n, sha1(text) AS d FROM documents WHERE doc_id % 7 <> 0), t AS (SELECT doc_id AS rel, strlen(text) + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS n, sha1(CASE WHEN doc_id % 5 = 1 THEN text || 'x' ELSE text END) AS d FROM documents WHERE doc_id % 8 <> 0)
SELECT coalesce(s.rel, t.rel) AS rel, CASE WHEN t.d IS NULL THEN 'added' WHEN s.d IS NULL THEN 'orphaned' WHEN s.n = t.n AND s.d = t.d THEN 'unchanged' ELSE 'modified' END AS status FROM s FULL JOIN t ON s.rel = t.rel""")
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    target = docs.filter(k % 8 != 0).select(k.alias("rel"), F.when(k % 5 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return export.file_status(export.file_digests(docs.filter(k % 7 != 0).select(k.alias("rel"), F.col("text").alias("content"))), export.file_digests(target))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the records upon a ledger of the first."""
    rows = records(spark, sf_dir)
    half = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    first = ledger.upsert(rows.limit(0), rows.filter(F.col("seq") <= half))
    return ledger.upsert(first, rows.filter(F.col("seq") > half))


@query(f"WITH {LEDGER_SQL} SELECT * FROM ledger")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@query(f"WITH {LEDGER_SQL} SELECT path, verdict FROM ledger WHERE verdict IN ('generic', 'wrong') AND NOT resolved")
def flagged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).filter(ledger.flagged(F.col("verdict"), F.col("resolved"))).select("path", "verdict")


@query(f"WITH {LEDGER_SQL} SELECT path, resolved OR path LIKE 'u1/%' AS resolved, path LIKE 'u1/%' AND NOT resolved AS changed FROM ledger")
def ledger_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    return ledger.mark_resolved(rows, rows.filter("path LIKE 'u1/%'")).select("path", "resolved", "changed")


ITEMS_SQL = """items AS (SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'u' || (user_id % 3) ELSE 'moved' END || '/img' || (user_id % 40) || '.png' AS path, 'caption ' || (user_id % 5) AS caption FROM (SELECT DISTINCT user_id FROM events)),
names AS (SELECT split_part(path, '/', 2) AS name, min(verdict) AS verdict, min(caption) AS caption, bool_and(resolved) AS resolved FROM ledger GROUP BY 1 HAVING count(*) = 1),
matched AS (SELECT i.id, i.path, i.caption, coalesce(e.verdict, n.verdict) AS verdict, coalesce(e.caption, n.caption) AS caption_at_verdict, coalesce(e.resolved, n.resolved) AS resolved,
  CASE WHEN e.path IS NOT NULL THEN 'path' WHEN n.name IS NOT NULL THEN 'name' END AS matched_by FROM items i LEFT JOIN ledger e ON e.path = i.path LEFT JOIN names n ON n.name = split_part(i.path, '/', 2))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    text = lambda c: c.cast("string")
    folder = F.when(user % 2 == 0, F.concat(F.lit("u"), text(user % 3))).otherwise("moved")
    items = table(spark, sf_dir, "events").select("user_id").distinct().select(user.alias("id"), F.concat(folder, F.lit("/img"), text(user % 40), F.lit(".png")).alias("path"), F.concat(F.lit("caption "), text(user % 5)).alias("caption"))
    return ledger.match(items, _ledger(spark, sf_dir))


@query(f"WITH {LEDGER_SQL}, {ITEMS_SQL} SELECT id, path, verdict, matched_by FROM matched")
def ledger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("id", "path", "verdict", "matched_by")


@query(f"WITH {LEDGER_SQL}, {ITEMS_SQL} SELECT id, CASE WHEN verdict IS NULL OR resolved OR caption_at_verdict <> caption THEN 'correct' ELSE verdict END AS initial_verdict FROM matched")
def seed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.seed_verdicts(_matched(spark, sf_dir)).select("id", "initial_verdict")


@query(f"WITH {LEDGER_SQL}, {ITEMS_SQL} SELECT count(*) AS images, count(verdict) AS verified, count_if(verdict IS NULL)::BIGINT AS unverified, count_if(verdict = 'correct')::BIGINT AS correct, count_if(verdict = 'generic')::BIGINT AS generic, count_if(verdict = 'wrong')::BIGINT AS wrong FROM matched")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verdict_counts(_matched(spark, sf_dir))


@query("""SELECT doc_id AS path, CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS verdict, CASE WHEN doc_id % 4 = 1 THEN 'after ' || doc_id ELSE text END AS caption, doc_id % 4 = 1 AS resolved
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0""")
def verifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    verdict = F.when(k % 3 == 0, "no verdict").when(F.col("quality") == 1, "correct").otherwise("wrong")
    results = table(spark, sf_dir, "labels").select(k.alias("path"), verdict.alias("verdict"))
    applied = docs.filter(k % 4 == 1).select(k.alias("path"), F.concat(F.lit("after "), k.cast("string")).alias("after"))
    return ledger.record_results(docs.select(k.alias("path"), F.col("text").alias("caption")), results, applied)


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN text END AS caption, coalesce(quality = 0, false) AS flagged FROM documents LEFT JOIN labels USING (doc_id))
SELECT id FROM c WHERE caption IS NULL OR flagged""")
def pending_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("caption"), (F.col("quality") == 0).alias("flagged"))
    return captions.pending(rows).select("id")


@query("""SELECT doc_id AS id, CASE WHEN (doc_id % 3 = 0 OR doc_id % 7 = 5) AND doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'keep' WHEN doc_id % 3 = 0 OR doc_id % 7 = 5 OR doc_id % 4 = 1 THEN 'caption_plain' ELSE 'caption_regions' END AS action FROM documents""")
def caption_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    skipped = F.when(k % 7 == 5, None).otherwise(k % 3 == 0)
    labels = F.when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("source"))
    return table(spark, sf_dir, "documents").select(k.alias("id"), captions.caption_action(k % 2 == 0, skipped, labels, k % 5 == 0).alias("action"))


@query(f"""WITH e AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN '/other/' WHEN 6 THEN '/data/../' WHEN 5 THEN '/data/x/../' WHEN 1 THEN '/data/region__' WHEN 7 THEN '/data/region__' ELSE '/data/' END || doc_id AS path,
  CASE doc_id % 6 WHEN 3 THEN ' ' WHEN 4 THEN ' ' || text ELSE 'new' END AS text, {TRIMMED.format('text')} AS old FROM documents),
c AS (SELECT doc_id, path, CASE WHEN doc_id % 6 <> 2 THEN old END AS before, {TRIMMED.format('text')} AS after FROM e),
r AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'outside_root' WHEN doc_id % 6 = 1 THEN 'region_artifact' WHEN before IS NULL THEN 'missing' WHEN after = '' THEN 'empty' END AS reason FROM c)
SELECT path, reason, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN before = after THEN 'unchanged' ELSE 'applied' END AS outcome FROM r""")
def caption_edit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    number = k.cast("string")
    path = F.concat(F.when(k % 12 == 0, "/other/").when(k % 12 == 6, "/data/../").when(k % 12 == 5, "/data/x/../").when(k % 6 == 1, "/data/region__").otherwise("/data/"), number).alias("path")
    old, there = F.concat(F.lit(" "), "text"), F.concat(F.when(k % 6 == 1, "/data/region__").otherwise("/data/"), number).alias("path")
    edits = docs.select(path, F.when(k % 6 == 3, " ").when(k % 6 == 4, old).otherwise("new").alias("text"))
    return captions.classify_edits(edits, docs.filter(k % 6 != 2).select(there, old.alias("caption")), "/data").select("path", "reason", "outcome")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 8")
def last_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.last_n(table(spark, sf_dir, "events"), 8, "user_id", "event_id").select("user_id", "event_id")


@query("""SELECT user_id, event_id, lag(event_type) OVER w AS previous, round(max(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS high, row_number() OVER w AS number FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = run_state.progress(table(spark, sf_dir, "events").withColumn("previous", before), "user_id", "event_id", "value")
    return rows.select("user_id", "event_id", "previous", F.round("high", 6).alias("high"), "number")


@query("""WITH p AS (SELECT l_orderkey AS shard, l_linenumber, l_returnflag AS variant, l_quantity::BIGINT AS bytes, l_partkey FROM lineitem),
one AS (SELECT shard, l_linenumber, bytes FROM (SELECT *, row_number() OVER (PARTITION BY shard, l_linenumber ORDER BY variant, bytes, l_partkey) AS rn FROM p) WHERE rn = 1)
SELECT shard, l_linenumber, sum(bytes) OVER (PARTITION BY shard ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes_so_far FROM one""")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shard"), "l_linenumber", F.col("l_returnflag").alias("variant"), F.col("l_quantity").cast("long").alias("bytes"), "l_partkey")
    one = rows.groupBy("shard", "l_linenumber").agg(F.min(F.struct("variant", "bytes", "l_partkey"))["bytes"].alias("bytes"))
    so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0))
    return one.select("shard", "l_linenumber", so_far.alias("bytes_so_far"))


EVENTS_SQL = "s AS (SELECT 'step' || (user_id % 12) AS step, event_id AS seq, event_type AS status, 'r' || (event_id % 3) AS reason, 'sub' || (user_id % 5) AS substep, CASE WHEN value > 5 THEN 'done' ELSE 'pending' END AS sub FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    sub = F.create_map(text("sub", F.col("user_id") % 5), F.when(F.col("value") > 5, "done").otherwise("pending"))
    return table(spark, sf_dir, "events").select(text("step", F.col("user_id") % 12).alias("step"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), text("r", F.col("event_id") % 3).alias("reason"), sub.alias("substeps"))


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT step, arg_max(status, seq) AS status, arg_max(reason, seq) AS reason FROM s GROUP BY step), b AS (SELECT step, substep, arg_max(sub, seq) AS sub FROM s GROUP BY ALL)
SELECT step, any_value(status) AS status, any_value(reason) AS reason, string_agg(substep || '=' || sub, ',' ORDER BY substep) AS substeps FROM l JOIN b USING (step) GROUP BY step""")
def run_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.map_entries("substeps"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return run_state.latest(_events(spark, sf_dir)).select("step", "status", "reason", F.array_join(pairs, ",").alias("substeps"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END WHEN o_orderkey % 3 = 1 THEN 'running' ELSE 'pending' END AS status FROM orders""")
def substep_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    subs = F.when(k % 3 == 1, F.create_map(F.lit("a"), F.lit("running"))).when(k % 3 == 2, F.create_map(F.lit("b"), F.lit("done")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), run_state.substep_status(F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed"), subs, F.lit("a")).alias("status"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'legacy_import' WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'already_done' END AS reason FROM orders""")
def step_skip_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    return table(spark, sf_dir, "orders").select(k.alias("id"), run_state.skip_reason(status, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("reason"))


BADGE_SQL = """b AS (SELECT o_orderkey AS id, o_custkey % 50 AS project, o_orderkey % 4 = 0 AS optional, CASE WHEN o_orderstatus IS NULL THEN 'pending' WHEN o_orderstatus <> 'O' AND o_orderkey % 5 < 2 AND o_orderkey % 11 = 0 THEN 'stale' WHEN o_orderstatus <> 'O' AND o_orderkey % 5 = 1 THEN 'skipped' WHEN o_orderstatus <> 'O' THEN 'done' ELSE 'failed' END AS badge,
CASE WHEN o_custkey % 50 = 3 THEN 'failed' WHEN o_custkey % 50 = 4 AND o_orderkey % 10 = 0 THEN 'queued' END AS live FROM orders)"""


def _badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_custkey") % 50
    outcome = F.when(k % 5 == 0, "completed").when(k % 5 == 1, "skipped")
    badge = run_state.badge(F.when(F.col("o_orderstatus") != "O", "done").when(F.col("o_orderstatus") == "O", "failed"), outcome, k % 11 != 0)
    live = F.when(p == 3, "failed").when((p == 4) & (k % 10 == 0), "queued")
    return table(spark, sf_dir, "orders").select(k.alias("id"), p.alias("project"), (k % 4 == 0).alias("optional"), badge.alias("badge"), live.alias("live"))


@query(f"WITH {BADGE_SQL} SELECT id, badge FROM b")
def step_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _badges(spark, sf_dir).select("id", "badge")


@query(f"""WITH {BADGE_SQL} SELECT project, CASE WHEN bool_or(coalesce(live = 'queued', false)) THEN 'running' WHEN bool_or(coalesce(live = 'failed', false)) THEN 'failed' WHEN count_if(NOT optional) > 0 AND count_if(NOT optional) = count_if(NOT optional AND badge IN ('done', 'skipped')) THEN 'completed' ELSE 'draft' END AS status
FROM (SELECT * FROM b UNION ALL SELECT id, project + 100, optional, 'done', NULL FROM b) GROUP BY project""")
def project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _badges(spark, sf_dir)
    done = rows.withColumn("project", F.col("project") + 100).withColumn("badge", F.lit("done")).withColumn("live", F.lit(None).cast("string"))
    return run_state.project_status(rows.unionByName(done))


@query(f"WITH {BADGE_SQL} SELECT id FROM b WHERE NOT optional AND badge <> 'done'")
def unfinished_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_state.unfinished(_badges(spark, sf_dir)).select("id")


STEPS_SQL = "d(ord, step) AS (VALUES " + ", ".join(f"({s.order}, '{s.name}')" for s in steps.STEPS) + ")"
EDGES_SQL = "e(step, prerequisite) AS (VALUES " + ", ".join(f"('{s.name}', '{p}')" for s in steps.STEPS for p in s.prerequisites) + ")"


@query(f"""WITH {STEPS_SQL}, p AS (SELECT c_custkey AS project, ord, step, ord = c_custkey % 10 OR ord = c_custkey % 7 + 2 AS selected FROM customer, d),
f AS (SELECT *, min(CASE WHEN selected THEN ord END) OVER (PARTITION BY project) AS first FROM p) SELECT project, ord, step FROM f WHERE ord >= first""")
def force_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project")).withColumn("s", F.explode(F.array(*[F.struct(F.lit(s.order).alias("ord"), F.lit(s.name).alias("step")) for s in steps.STEPS])))
    rows = rows.select("project", "s.*").withColumn("selected", (F.col("ord") == F.col("project") % 10) | (F.col("ord") == F.col("project") % 7 + 2))
    return run_state.force_invalidated(rows).select("project", "ord", "step")


STEP_NAMES = [s.name for s in steps.checked()]
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in STEP_NAMES) + "]"
SELECTION_SQL = f"""s AS (SELECT c_custkey AS project, {NAMES_SQL} AS names, c_custkey AS k FROM customer),
w AS (SELECT project, [names[k * 3 % 10 + 1], names[(k + 4) % 10 + 1], names[k * 7 % 10 + 1], names[k * 3 % 10 + 1]] AS wanted, list_filter(names, lambda n: n <> names[k % 10 + 1]) AS own FROM s)"""


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, wanted, own: which steps are selected, and which the project has: all but one."""
    k, names = F.col("c_custkey"), F.array(*map(F.lit, STEP_NAMES))
    at = lambda n: F.get(names, (n % 10).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("project"), F.array(at(k * 3), at(k + 4), at(k * 7), at(k * 3)).alias("wanted"), F.filter(names, lambda n: n != at(k)).alias("own"))


@query(f"""WITH {SELECTION_SQL}, o AS (SELECT project, list_concat(list_filter(own, lambda n: list_contains(wanted, n)), list_filter(wanted, lambda n, i: NOT list_contains(own, n) AND list_position(wanted, n) = i)) AS steps FROM w)
SELECT project, i::INT - 1 AS place, steps[i] AS step FROM o, unnest(range(1, len(steps) + 1)) u(i)""")
def select_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = run_state.ordered_selection(F.col("wanted"), F.col("own"))
    return _selections(spark, sf_dir).select("project", F.posexplode(ordered).alias("place", "step"))


@query(f"""WITH {SELECTION_SQL}, {EDGES_SQL}, c AS (SELECT DISTINCT project, unnest(wanted) AS step FROM w), t AS (SELECT * FROM c UNION SELECT project, own[project % 9 + 1] FROM w)
SELECT c.project, c.step, e.prerequisite FROM c JOIN e USING (step) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.project = c.project AND t.step = e.prerequisite)""")
def prereq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _selections(spark, sf_dir)
    done = rows.select("project", F.get("own", (F.col("project") % 9).cast("int")).alias("step"))
    return run_state.prerequisite_violations(rows.select("project", F.explode("wanted").alias("step")), steps.edge_table(spark), done, ["project"])


@query("""WITH r AS (SELECT event_id AS id, event_type AS step FROM events) SELECT id, CASE step WHEN 'click' THEN 'select' ELSE step END AS step FROM r WHERE step <> 'error'""")
def migrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = spark.createDataFrame([("click", "select"), ("error", None)], "old string, new string")
    return run_state.migrate_ids(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("step")), renames)


@query("""SELECT event_id AS id, json_extract(props, '$.k')::BIGINT / 100.0 AS x1, event_type AS label FROM events WHERE event_id % 9 <> 4""")
def boxes_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100
    made = F.array(F.struct(k.alias("x1"), F.lit(0.1).alias("y1"), F.lit(0.9).alias("x2"), F.lit(0.5).alias("y2"), F.col("event_type").alias("label")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 4, F.concat(F.lit("[{"), "event_type")).otherwise(F.to_json(made)).alias("json"))
    return captions.parse_boxes(rows).select("id", F.explode("boxes").alias("b")).select("id", "b.x1", "b.label")


@query("""SELECT event_type AS stage, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT 'compose', count(*) FROM events""")
def pass_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = F.when(F.col("user_id") % 3 != 0, F.array(F.lit("compose"), "event_type")).otherwise(F.array(F.lit("compose")))
    return captions.pass_tally(table(spark, sf_dir, "events").select(took.alias("passes")))


@query("""WITH r AS (SELECT 'set/img' || user_id AS stem, event_id AS seq, user_id % 4 AS there, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT stem, seq, (there + place)::INT AS number, 'set/region__' || split_part(stem, '/', 2) || '__' || CASE WHEN there + place < 10 THEN '0' ELSE '' END || (there + place) AS crop FROM r""")
def region_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    stem = F.concat(F.lit("set/img"), user.cast("string")).alias("stem")
    events = table(spark, sf_dir, "events")
    crops = events.select(user).distinct().select(stem, F.explode(F.when(user % 4 > 0, F.sequence(F.lit(1).cast("long"), user % 4))).alias("n"))
    return regions.numbered_regions(events.select(stem, F.col("event_id").alias("seq")), crops).select("stem", "seq", "number", "crop")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'deep ' || p_name || ' "x"' WHEN 2 THEN 'last' END AS found,
  CASE p_partkey % 5 WHEN 0 THEN 'ViT-B-16' WHEN 1 THEN 'ViT-B-32' WHEN 2 THEN 'ViT-B-32' ELSE p_brand END AS model FROM part""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    deep = F.to_json(F.struct(F.lit(1).alias("n"), F.lit("").alias("none"), F.array(F.struct(F.concat(F.lit("deep "), name, F.lit(' "x"')).alias("text"))).alias("list")))
    answer = F.when(k % 4 == 0, F.to_json(F.struct(name.alias("caption"), F.lit("other").alias("more")))).when(k % 4 == 1, deep).when(k % 4 == 2, '[[], {"a": {}}, 3, null, "last"]').otherwise('{"a": [1, {"b": ""}]}')
    model = F.when(k % 5 == 0, "openai/clip-vit-base-patch16").when(k % 5 == 1, "openai/clip-vit-base-patch32").when(k % 5 == 2, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.first_string(answer).alias("found"), planning.canonical_model(model).alias("model"))
