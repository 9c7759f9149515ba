"""Run state: which steps are done, what a forced run undoes, badges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.order import counted


def latest(events: DataFrame, key: str = "step") -> DataFrame:
    """The last record of each key from (key, seq, status, reason); substeps (a map) add up, later ones win."""
    cols = ["status", "reason"]
    last = events.groupBy(key).agg(F.max(F.struct("seq", *cols)).alias("e")).select(key, *[f"e.{c}" for c in cols])
    if "substeps" not in events.columns:
        return last
    subs = events.select(key, "seq", F.explode("substeps").alias("substep", "value")).groupBy(key, "substep").agg(F.max_by("value", "seq").alias("value"))
    maps = subs.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("substep", "value")))).alias("substeps"))
    return last.join(maps, key, "left")


def substep_status(status: Column, substeps: Column, substep: Column) -> Column:
    """A substep's own status; without any map of substeps that of a step that is done or skipped; else pending."""
    inherited = F.when(status.isin("done", "skipped"), status).otherwise("pending")
    return F.when(substeps.isNull(), inherited).otherwise(F.coalesce(F.try_element_at(substeps, substep), F.lit("pending")))


def skip_reason(status: Column, resume_aware: Column, legacy_import: Column, force: Column) -> Column:
    """Why a selected step doesn't run: legacy_import or already_done; null if it runs."""
    return F.when(force, None).when(legacy_import, "legacy_import").when(resume_aware, None).when(status == "done", "already_done")


def badge(status: Column, outcome: Column, report_there: Column) -> Column:
    """What the step list shows: stale without its report, skipped if it had nothing to do, else its status."""
    ran = outcome.isin("completed", "skipped")
    state = F.coalesce(status, F.lit("pending"))
    return F.when((state == "done") & F.coalesce(ran, F.lit(False)) & ~report_there, "stale").when((state == "done") & F.coalesce(outcome == "skipped", F.lit(False)), "skipped").otherwise(state)


def unfinished(steps: DataFrame) -> DataFrame:
    """Steps that are needed and not done."""
    return steps.filter(~F.col("optional") & (F.col("badge") != "done"))


def progress(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds number and high to events: the place within key by order, and the highest value up to there, which never falls."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("number", F.row_number().over(w)).withColumn("high", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def project_status(steps: DataFrame, key: str = "project") -> DataFrame:
    """key, status from (key, optional, badge, live): running, failed, completed or draft."""
    live = F.max(F.when(F.col("live").isin("queued", "running", "waiting_input", "starting"), 2).when(F.col("live") == "failed", 1).otherwise(0))
    needed = F.count_if(~F.col("optional"))
    met = F.count_if(~F.col("optional") & F.col("badge").isin("done", "skipped"))
    rows = steps.groupBy(key).agg(live.alias("_live"), needed.alias("_needed"), met.alias("_met"))
    status = F.when(F.col("_live") == 2, "running").when(F.col("_live") == 1, "failed").when((F.col("_needed") > 0) & (F.col("_needed") == F.col("_met")), "completed").otherwise("draft")
    return rows.select(key, status.alias("status"))


def force_invalidated(steps: DataFrame, key: str = "project") -> DataFrame:
    """Rows of (key, ord, step, selected) from the first selected step on."""
    first = F.min(F.when(F.col("selected"), F.col("ord"))).over(Window.partitionBy(key))
    return steps.withColumn("_first", first).filter(F.col("ord") >= F.col("_first")).drop("_first")


def prerequisite_violations(selected: DataFrame, edges: DataFrame, satisfied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, step, prerequisite that is neither selected nor satisfied; with columns by, each of their values is a project of its own."""
    keys = list(by)
    needs = selected.select(*keys, "step").distinct().join(F.broadcast(edges), "step")
    there = selected.select(*keys, F.col("step").alias("prerequisite")).union(satisfied.select(*keys, "step")).distinct()
    return needs.join(there, [*keys, "prerequisite"], "left_anti").select(*keys, "step", "prerequisite")


def ordered_selection(selected: Column, configured: Column) -> Column:
    """Selected steps (an array) in the order of the project's own, each once; those it is without come last, as they were named."""
    wanted = F.array_distinct(F.coalesce(selected, F.array().cast("array<string>")))
    own = F.coalesce(configured, F.array().cast("array<string>"))
    return F.concat(F.filter(F.array_distinct(own), lambda s: F.array_contains(wanted, s)), F.filter(wanted, lambda s: ~F.array_contains(own, s)))


def migrate_ids(records: DataFrame, renames: DataFrame, key: str = "step") -> DataFrame:
    """Records under their new ids; those whose step is gone (null) are left out."""
    joined = records.join(counted(renames.select(F.col("old").alias(key), F.col("new").alias("_new"), F.lit(True).alias("_known"))), key, "left")
    return joined.withColumn(key, F.when(F.col("_known"), F.col("_new")).otherwise(F.col(key))).filter(F.col(key).isNotNull()).drop("_new", "_known")
