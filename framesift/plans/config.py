"""Settings of the steps, and projects in YAML files."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from framesift.functions.geometry import BUCKETS
from framesift.operators.quality_gate import DEFAULT_SCORERS, Scorer
from framesift.plans.steps import STEPS


@dataclass(frozen=True)
class QualityGate:
    scorers: tuple[Scorer, ...] = DEFAULT_SCORERS
    manual_review: bool = True


@dataclass(frozen=True)
class Import:
    #: Whether images and caption files are copied to the output's `dataset` folder too; files that are there stay.
    copy: bool = False
    #: Whether all later steps work on that copy, so that the input is never changed.
    work_on_copy: bool = False


@dataclass(frozen=True)
class Curate:
    max_distance: int = 3


@dataclass(frozen=True)
class Upscale:
    target: int = 3072
    highlight: int = 1536
    generative: bool = True
    least_ssim: float = 0.60
    #: Whether planned images are upscaled, by the caller's model or, if none is generative, by Lanczos; else there is a plan only.
    run: bool = False


@dataclass(frozen=True)
class Caption:
    concept_token: str | None = None
    style_mode: bool = False
    overwrite: bool = False
    #: `grounded` (observe, compose, fill gaps, each where it is needed) or `single`; for models that take prompts.
    strategy: str = "grounded"
    prompt: str | None = None
    domain_brief: str | None = None
    max_new_tokens: int = 200

    def __post_init__(self) -> None:
        if self.strategy not in ("grounded", "single"):
            raise ValueError("caption: strategy must be grounded or single")


@dataclass(frozen=True)
class VerifyCaptions:
    #: Whether reviewers' new texts are written to the caption files; what was there is kept in `caption_backup`.
    write_edits: bool = False


@dataclass(frozen=True)
class VaeGate:
    sigma: float = 2.0
    cutoff: float = 0.25

    def __post_init__(self) -> None:
        if self.sigma < 0 or not 0 < self.cutoff < 0.5:
            raise ValueError("vae_gate: sigma must be 0 or more, cutoff between 0 and 0.5")


@dataclass(frozen=True)
class Audit:
    min_resolution: int | None = 1024


@dataclass(frozen=True)
class BucketCheck:
    thin_threshold: int = 2
    cache: bool = False
    buckets: tuple[tuple[int, int], ...] = tuple(BUCKETS)

    def __post_init__(self) -> None:
        if self.thin_threshold < 0:
            raise ValueError("bucket_check: thin_threshold must be 0 or more")
        if not self.buckets or any(len(b) != 2 or min(b) < 1 for b in self.buckets):
            raise ValueError("bucket_check: buckets must be pairs of positive sizes")


@dataclass(frozen=True)
class Export:
    #: Whether images that have a caption of this run only, and no caption file, are exported too.
    new_captions: bool = True


@dataclass(frozen=True)
class Nothing:
    """Settings of a step that has none."""


KINDS: dict[str, type] = {"import": Import, "verify_captions": VerifyCaptions, "quality_gate": QualityGate, "curate": Curate, "upscale": Upscale, "caption": Caption, "vae_gate": VaeGate, "audit": Audit, "bucket_check": BucketCheck, "export": Export}


@dataclass(frozen=True)
class Project:
    name: str
    input_dir: str
    output_dir: str | None = None
    steps: tuple[str, ...] = tuple(s.name for s in STEPS)
    settings: dict[str, Any] = field(default_factory=dict)

    def of(self, step: str) -> Any:
        return self.settings.get(step) or KINDS.get(step, Nothing)()

    @property
    def output(self) -> str:
        return self.output_dir or f"{self.input_dir.rstrip('/')}_output"


def coerced(kind: type, raw: dict[str, Any]) -> Any:
    """Settings from plain values: unknown keys are left out, blanks and nulls mean the default, bad values raise."""
    out = {}
    for f in dataclasses.fields(kind):
        value = raw.get(f.name)
        if value is None or (isinstance(value, str) and not value.strip()):
            continue
        if f.name == "scorers":
            value = tuple(Scorer(**{k: v for k, v in s.items() if k in Scorer.__dataclass_fields__}) for s in value)
        elif f.name == "buckets":
            value = tuple(tuple(b) for b in value)
        elif f.type.startswith("int"):
            value = int(value)
        elif f.type.startswith("float"):
            value = float(value)
        elif f.type.startswith("bool") and not isinstance(value, bool):
            value = str(value).strip().lower() in ("1", "true", "yes", "on")
        out[f.name] = value
    return kind(**out)


def folder_name(name: str) -> str:
    """A project's folder; names that could lead elsewhere are errors."""
    name = (name or "").strip()
    if not re.fullmatch("[A-Za-z0-9_-][A-Za-z0-9._-]*", name):
        raise ValueError(f"{name!r} is no project name: use letters, digits, '-', '_' and '.'")
    return name.replace("-", "_")


def save(project: Project, root: str) -> Path:
    """Writes a project's index and a file for each step with settings, then moves them into place."""
    folder = Path(root) / folder_name(project.name)
    fresh = folder.with_name(f".{folder.name}.new")
    fresh.mkdir(parents=True, exist_ok=True)
    index = {"name": project.name, "input_dir": project.input_dir, "output_dir": project.output_dir, "steps": list(project.steps)}
    (fresh / "index.yaml").write_text(yaml.safe_dump(index, sort_keys=False))
    for step, settings in project.settings.items():
        (fresh / f"{step}.yaml").write_text(yaml.safe_dump(_plain(dataclasses.asdict(settings)), sort_keys=False))
    if folder.exists():
        for old in folder.iterdir():
            old.unlink()
        folder.rmdir()
    fresh.rename(folder)
    return folder


def load(name: str, root: str) -> Project:
    """A project from its folder: the index decides which steps there are; a step without a file has the defaults."""
    folder = Path(root) / folder_name(name)
    index = yaml.safe_load((folder / "index.yaml").read_text())
    settings = {s: coerced(KINDS[s], yaml.safe_load(file.read_text()) or {}) for s in index["steps"] if s in KINDS and (file := folder / f"{s}.yaml").exists()}
    return Project(index["name"], index["input_dir"], index.get("output_dir"), tuple(index["steps"]), settings)


def names(root: str) -> list[str]:
    """Names of all projects below root, sorted."""
    folders = [p for p in Path(root).glob("*") if not p.name.startswith(".") and (p / "index.yaml").exists()]
    return sorted(yaml.safe_load((p / "index.yaml").read_text())["name"] for p in folders)


#: Kinds of caption prompts, and the name of the built-in one.
PROMPT_KINDS, DEFAULT_PROMPT = ("content", "style"), "Default"


def prompts(root: str, kind: str, default: str) -> list[tuple[str, str]]:
    """(name, text) of the prompts of a kind in a prompt library, by name; the built-in one has the text given. Files that can't be read, or that would hide it, are left out."""
    if kind not in PROMPT_KINDS:
        raise ValueError(f"{kind!r} is no kind of prompt")
    found = [(DEFAULT_PROMPT, default)]
    for file in sorted(Path(root).glob(f"{kind}__*.yaml")):
        try:
            saved = yaml.safe_load(file.read_text())
            name, own, text = str(saved["name"]), saved["kind"], str(saved["text"])
        except (OSError, ValueError, KeyError, TypeError, yaml.YAMLError):
            continue
        if own == kind and name.strip().lower() != DEFAULT_PROMPT.lower():
            found.append((name, text))
    return sorted(found, key=lambda p: p[0].lower())


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value
