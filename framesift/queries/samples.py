"""Stand-ins for images, captions and records on the sample tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.queries import table

IMAGES_SQL = """
images AS (
  SELECT p_partkey AS id, 256 + (p_partkey * 37) % 3000 AS w, 256 + (p_size * 613 + p_partkey * 11) % 3000 AS h,
         'set' || (p_partkey % 7) || '/' || replace(p_name, ' ', '_') || '_' || (p_partkey // 3) || (CASE WHEN p_partkey % 3 = 0 THEN '.jpg' ELSE '.png' END) AS path
  FROM part
)
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(F.lit("set"), (key % 7).cast("string"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.floor(key / 3).cast("string"), F.when(key % 3 == 0, ".jpg").otherwise(".png"))
    return table(spark, sf_dir, "part").select(key.alias("id"), (256 + (key * 37) % 3000).alias("w"), (256 + (F.col("p_size") * 613 + key * 11) % 3000).alias("h"), path.alias("path"))


CAPTIONS_SQL = """
captions AS (
  SELECT p_partkey AS id,
    CASE p_partkey % 8 WHEN 0 THEN 'This image shows a photo of ' || p_name || 's on the table'
      WHEN 1 THEN 'A ' || p_name || ' with the brass handle, beside two curtains'
      WHEN 2 THEN 'In this picture, here we see the ' || p_name || '. Stock photo by nobody'
      WHEN 3 THEN '  ' || p_name || '  '
      WHEN 4 THEN 'A ' || p_name || ' stands near an old window in the morning light while various people walk along the street and look up at the tall grey houses.'
      WHEN 5 THEN 'sks, the ' || p_name || ' and some kind of ' || lower(p_type) || ' item, on a wooden bench under the red lamp, next to the white door of the house at noon.'
      WHEN 6 THEN '' ELSE 'The photograph depicts: ' || p_type || ' ' || p_name END AS caption,
    p_name AS label, p_type AS kind, p_size AS size
  FROM part
)
"""


#: Tasks that captions are dealt over.
CAPTION_TASKS = 48


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind, k = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 8
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    caption = (
        F.when(k == 0, say("This image shows a photo of ", name, "s on the table"))
        .when(k == 1, say("A ", name, " with the brass handle, beside two curtains"))
        .when(k == 2, say("In this picture, here we see the ", name, ". Stock photo by nobody"))
        .when(k == 3, say("  ", name, "  "))
        .when(k == 4, say("A ", name, " stands near an old window in the morning light while various people walk along the street and look up at the tall grey houses."))
        .when(k == 5, say("sks, the ", name, " and some kind of ", F.lower(kind), " item, on a wooden bench under the red lamp, next to the white door of the house at noon."))
        .when(k == 6, "")
        .otherwise(say("The photograph depicts: ", kind, " ", name))
    )
    # a small file is one task's to read, but its captions are work for many
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size").repartition(CAPTION_TASKS, "p_partkey")
    return rows.select(F.col("p_partkey").alias("id"), caption.alias("caption"), name.alias("label"), kind.alias("kind"), F.col("p_size").alias("size"))


LEDGER_SQL = """
records AS (
  SELECT 'u' || (user_id % 3) || '/img' || (user_id % 40) || '.png' AS path, event_id AS seq,
         CASE event_type WHEN 'error' THEN 'wrong' WHEN 'click' THEN 'generic' WHEN 'view' THEN 'correct' ELSE event_type END AS verdict,
         'caption ' || (event_id % 5) AS caption, event_id % 4 = 0 AS resolved
  FROM events
),
ledger AS (
  SELECT path, verdict, caption, resolved, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM records WHERE verdict IN ('correct', 'generic', 'wrong')) WHERE rn = 1
)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    verdict = F.when(kind == "error", "wrong").when(kind == "click", "generic").when(kind == "view", "correct").otherwise(kind)
    path = F.concat(F.lit("u"), (user % 3).cast("string"), F.lit("/img"), (user % 40).cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "events").select(path.alias("path"), event.alias("seq"), verdict.alias("verdict"), F.concat(F.lit("caption "), (event % 5).cast("string")).alias("caption"), (event % 4 == 0).alias("resolved"))
