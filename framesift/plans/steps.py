"""The steps of the curation pipeline, and rules on selecting them."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    name: str
    order: int
    prerequisites: tuple[str, ...] = ()
    optional: bool = False
    resume_aware: bool = False
    substeps: tuple[str, ...] = ()
    #: (substep, the substep that it needs)
    needs: tuple[tuple[str, str], ...] = ()


# The steps in their order.
STEPS = (
    Step("import", 0),
    Step("quality_gate", 1, ("import",), substeps=("score_images", "review_decisions", "write_survivors"), needs=(("review_decisions", "score_images"),)),
    Step("curate", 2, ("quality_gate",), substeps=("deduplicate", "coverage_scan")),
    Step("upscale", 3, ("import",), optional=True, substeps=("plan", "review", "upscale"), needs=(("review", "plan"), ("upscale", "plan"))),
    Step("caption", 4, ("quality_gate", "curate"), resume_aware=True, substeps=("annotate", "caption", "validate_captions")),
    Step("verify_captions", 5, ("caption",), optional=True, resume_aware=True, substeps=("preview", "review", "apply_edits"), needs=(("apply_edits", "review"),)),
    Step("vae_gate", 6, ("import",), resume_aware=True, substeps=("score", "review", "apply_drops")),
    Step("audit", 7, ("vae_gate",), substeps=("check_pairing", "check_corrupt_files", "check_caption_quality", "check_resolution")),
    Step("bucket_check", 8, ("audit",), substeps=("assign", "write_cache_info")),
    Step("export", 9, ("import",), optional=True, substeps=("diff", "copy"), needs=(("copy", "diff"),)),
)


class SelectionError(ValueError):
    """A selection of steps that can't be run."""


def checked(steps: Sequence[Step] = STEPS) -> list[Step]:
    """Steps by order; orders and names have to be unique, names file names, prerequisites known."""
    names, orders = [s.name for s in steps], [s.order for s in steps]
    if len(set(names)) < len(names) or len(set(orders)) < len(orders):
        raise ValueError("names and orders of steps must be unique")
    for s in steps:
        if not re.fullmatch("[a-z][a-z0-9_]*", s.name):
            raise ValueError(f"{s.name!r} is no step name")
        if missing := set(s.prerequisites) - set(names):
            raise ValueError(f"{s.name} requires unknown {sorted(missing)}")
    return sorted(steps, key=lambda s: s.order)


BY_NAME = {s.name: s for s in checked()}


def in_order(selected: Iterable[str], configured: Sequence[str]) -> list[str]:
    """Selected steps in the project's order; those it is without come last."""
    wanted = list(dict.fromkeys(selected))
    return [s for s in configured if s in wanted] + [s for s in wanted if s not in configured]


def enabled_substeps(step: str, chosen: Iterable[str] | None = None, disabled: Collection[str] = ()) -> list[str]:
    """A step's substeps in their order: the chosen ones, or all but the disabled; unknown or repeated ones are errors."""
    known = BY_NAME[step].substeps
    if chosen is None:
        return [s for s in known if s not in disabled]
    chosen = list(chosen)
    if unknown := [s for s in chosen if s not in known]:
        raise SelectionError(f"{step} has no substep {', '.join(unknown)}")
    if len(set(chosen)) < len(chosen):
        raise SelectionError(f"{step} has a substep twice")
    return [s for s in known if s in chosen]


def default_substeps(step: str, settings: dict[str, bool]) -> list[str]:
    """Substeps that are on by default, after a step's own toggles: a toggle that is off takes its substep away."""
    toggles = {"manual_review": "review_decisions", "coverage": "coverage_scan", "check_pairing": "check_pairing", "check_corrupt": "check_corrupt_files", "check_caption_length": "check_caption_quality", "check_resolution_gate": "check_resolution", "cache": "write_cache_info", "write_edits": "apply_edits", "run": "upscale"}
    off = {sub for toggle, sub in toggles.items() if not settings.get(toggle, toggle != "cache")}
    return enabled_substeps(step, disabled=off)


def validate(selected: Sequence[str], configured: Sequence[str], satisfied: Collection[str], substeps: dict[str, list[str]] | None = None, invalidated: Collection[str] = (), has_dataset: bool = True) -> None:
    """Raises a SelectionError unless the selected steps can run."""
    if unknown := [s for s in selected if s not in configured]:
        raise SelectionError(f"not in the project: {', '.join(unknown)}")
    if not selected:
        raise SelectionError("select a step at least")
    for name in selected:
        step = BY_NAME[name]
        on = enabled_substeps(name, (substeps or {}).get(name))
        if step.substeps and not on:
            raise SelectionError(f"{name} has no enabled substep")
        for sub, need in step.needs:
            if sub in on and need not in on:
                raise SelectionError(f"{sub} requires {need}")
        for need in step.prerequisites:
            if need not in selected and (need in invalidated or need not in satisfied):
                raise SelectionError(f"{name} requires {need} to be done or selected")
    if "import" not in selected and not has_dataset:
        raise SelectionError("there is no working dataset; select import first")


def invalidated_by_force(selected: Iterable[str], configured: Sequence[str]) -> list[str]:
    """Steps that a forced run undoes: from the first selected one on, in the project's order; a step that the project is without counts by its own order."""
    wanted = list(dict.fromkeys(selected))
    places = [i for i, s in enumerate(configured) if s in wanted]
    if places:
        return list(configured[min(places) :])
    orders = [BY_NAME[s].order for s in wanted if s in BY_NAME]
    if not orders:
        return []
    return list(dict.fromkeys([*wanted, *(s for s in configured if s in BY_NAME and BY_NAME[s].order >= min(orders))]))


def step_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.order, s.name, s.optional, s.resume_aware) for s in checked()], "ord int, step string, optional boolean, resume_aware boolean")


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, p) for s in checked() for p in s.prerequisites], "step string, prerequisite string")
