"""Quality gate: scorers with thresholds, decisions, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scorer:
    """A rule on a score column: `lt` rejects values below the threshold, `gt` those above; equal ones pass."""

    name: str
    op: str = "lt"
    threshold: float | None = None
    borderline: float | None = None
    enabled: bool = True
    optional: bool = False
    threshold_key: str | None = None

    def __post_init__(self) -> None:
        if self.op not in ("lt", "gt"):
            raise ValueError(f"scorer {self.name!r}: op must be 'lt' or 'gt', got {self.op!r}")


#: The default scorers.
DEFAULT_SCORERS = (Scorer("min_side", "lt", 1024.0), Scorer("blur", "lt", 100.0, 150.0), Scorer("noise", "gt", 25.0), Scorer("jpeg", "gt", 0.08, optional=True), Scorer("watermark", "gt", 0.80, optional=True))


def resolved(scorers: Sequence[Scorer], thresholds: Mapping[str, float] | None = None) -> list[Scorer]:
    """Scorers in use, each with its threshold; one without any is an error."""
    out = []
    for s in scorers:
        if not s.enabled:
            continue
        value = s.threshold if s.threshold is not None else (thresholds or {}).get(s.threshold_key or "")
        if value is None:
            raise KeyError(f"scorer {s.name!r} has no threshold")
        out.append(Scorer(s.name, s.op, float(value), s.borderline, True, s.optional))
    return out


def _fails(s: Scorer) -> Column:
    v = F.col(s.name)
    return F.coalesce(v < s.threshold if s.op == "lt" else v > s.threshold, F.lit(not s.optional))


def quality_score(scorers: Sequence[Scorer]) -> Column:
    """0 to 100: the mean of each gate's value on a scale that has the threshold in the middle; unrounded."""
    parts = []
    for s in scorers:
        if s.threshold > 0:
            q = F.col(s.name) / (2 * s.threshold)
            # least and greatest pass over nulls, so a missing score is left out by itself
            parts.append(F.when(q.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), q if s.op == "lt" else 1 - q))))
    known = F.filter(F.array(*parts) if parts else F.array().cast("array<double>"), lambda q: q.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, q: acc + q)
    return F.when(F.size(known) > 0, 100 * total / F.size(known)).otherwise(0.0)


def gate(rows: DataFrame, scorers: Sequence[Scorer] = DEFAULT_SCORERS, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Adds auto_reasons, auto_reject, borderline, quality. A missing score of a scorer that isn't optional rejects its row."""
    rules = resolved(scorers, thresholds)
    sign = {"lt": "<", "gt": ">"}
    reasons = F.array_compact(F.array(*[F.when(_fails(s), F.concat_ws(" ", F.lit(s.name), F.coalesce(F.col(s.name).cast("string"), F.lit("unreadable")), F.lit(sign[s.op]), F.lit(str(s.threshold)))) for s in rules]))
    near = F.lit(False)
    for s in rules:
        if s.op == "lt" and s.borderline is not None:
            near = near | F.coalesce(F.col(s.name) < s.borderline, F.lit(False))
    return (
        rows.withColumn("auto_reasons", reasons)
        .withColumn("auto_reject", F.size("auto_reasons") > 0)
        .withColumn("borderline", ~F.col("auto_reject") & near)
        .withColumn("quality", quality_score(rules))
    )


def quality_band(quality: Column) -> Column:
    return F.when(quality >= 66, "green").when(quality >= 40, "amber").otherwise("red")


def apply_decisions(gated: DataFrame, decisions: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Adds decision and kept: a reviewer's keep, flag or reject, else what the gate says."""
    auto = F.when(F.col("auto_reject"), "reject").otherwise("keep")
    rows = gated if decisions is None else gated.join(decisions.select(key, F.col("decision").alias("_said")), key, "left")
    said = F.lit(None).cast("string") if decisions is None else F.col("_said")
    return rows.withColumn("decision", F.coalesce(said, auto)).withColumn("kept", F.col("decision").isin("keep", "flag")).drop("_said")


def gate_counts(decided: DataFrame) -> DataFrame:
    """One row: total, kept, rejected, flagged."""
    d = F.col("decision")
    return decided.agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"), F.count_if(d == "reject").alias("rejected"), F.count_if(d == "flag").alias("flagged"))


def survivors(rows: DataFrame, decided: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(decided.filter("kept").select(key), key, "left_semi")
