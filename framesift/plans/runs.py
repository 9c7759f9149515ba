"""Runs of the pipeline: each step reads what earlier ones stored and stores a table and a report of its own.

Images are never changed in place. A step's result is the set of images that it lets through, with what it found
out of them; reviewers' answers come as a table between two steps. A step that makes new images writes them to a folder of
its own and a layer of the manifest: all later steps see the images as the layers say.
"""

from __future__ import annotations

import dataclasses
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import pixels, text
from framesift.functions.geometry import downscale_divisor
from framesift.operators import audit, buckets, captions, coverage, duplicates, export, neighbours, outliers, quality_gate, upscale
from framesift.operators.order import scan_order
from framesift.operators.passes import Model, Passes, grounded, single
from framesift.plans.config import Project
from framesift.plans.steps import BY_NAME, SelectionError, checked, default_substeps, enabled_substeps, in_order, invalidated_by_force, validate
from framesift.sources import files, headers, manifest, store


@dataclass
class Hooks:
    """What a caller may plug in. decide(step, rows) gives reviewers' answers, (path, decision), for captions with a new text if they give one.

    vlm answers prompts, (path, answer) of (path, w, h, channels, data, stage, prompt, max_new_tokens); regions gives (stem, labels, places) of
    what people marked. caption, rebuild, upscale and embed are models on columns: upscale gives (path, content, ssim, error) of (path, divisor, w, h, channels,
    data), upscale_for builds one for a size, which works on an image at a time (see upscaled_by_target), embed gives (path, embedding) of images. scorers are more named numbers on an image, for the gate's scorers of that name.
    """

    decide: Callable[[str, DataFrame], DataFrame | None] = lambda step, rows: None
    caption: Callable[[DataFrame], DataFrame] | None = None
    vlm: Model | None = None
    regions: DataFrame | None = None
    rebuild: Callable[[DataFrame], DataFrame] | None = None
    upscale: Callable[[DataFrame], DataFrame] | None = None
    upscale_for: Callable[[int], upscale.SizedModel] | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    scorers: dict[str, pixels.Scoring] = field(default_factory=dict)
    before: Callable[[str], None] = lambda step: None
    after: Callable[[str, dict], None] = lambda step, report: None
    cancelled: Callable[[], bool] = lambda: False


class CancelledError(RuntimeError):
    """A caller stopped the run."""


@dataclass
class State:
    """What is done, kept as JSON beside the results; small, and on the driver."""

    spark: SparkSession
    path: str
    steps: dict[str, dict[str, Any]] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, output: str) -> State:
        path = f"{output}/state.json"
        try:
            return cls(spark, path, json.loads(store.read_text(spark, path) or "")["steps"])
        except (ValueError, KeyError, TypeError):
            return cls(spark, path)

    def mark(self, step: str, status: str, **more: Any) -> None:
        self.steps[step] = {"status": status, "completed_at": time.strftime("%Y-%m-%dT%H:%M:%S"), **more}
        store.write_text(self.spark, self.path, json.dumps({"steps": self.steps}, indent=2))

    def satisfied(self) -> set[str]:
        return {s for s, r in self.steps.items() if r["status"] in ("done", "skipped")}


def outcome(report: Any) -> tuple[str, str]:
    """What a report says of its step: completed, or skipped and why. A list of skipped images is no skipped step."""
    if not isinstance(report, dict):
        return "completed", ""
    if not report:
        return "skipped", "its report is empty"
    if report.get("skipped") is True:
        return "skipped", str(report.get("reason") or "it had nothing to do")
    return "completed", ""


def skip_reason(state: State, step: str, force: bool) -> str | None:
    done = state.steps.get(step, {}).get("status") == "done"
    return "already_done" if done and not force and not BY_NAME[step].resume_aware else None


class Run:
    def __init__(self, spark: SparkSession, project: Project, hooks: Hooks | None = None) -> None:
        self.spark, self.project, self.hooks = spark, project, hooks or Hooks()
        self.state = State.read(spark, project.output)
        self.on: set[str] = set()
        #: Marks the jobs of this run; folders that the step in hand has begun to write.
        self.tag, self.begun = f"framesift-{uuid.uuid4().hex}", []
        self.stopped, self.idle = threading.Event(), threading.Event()
        self.idle.set()
        checked()

    def cancel(self) -> None:
        """Stops the run, from another thread, and waits for it: jobs of the step in hand are stopped, and what it has written goes."""
        self.stopped.set()
        # a job that was about to begin is stopped the next time round
        while True:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if self.idle.wait(0.5):
                return

    # tables between the steps

    def folder(self, step: str) -> str:
        return f"{self.project.output}/steps/{step}"

    @property
    def root(self) -> str:
        """The folder of the working images and captions: the input, or the copy that the import made of it."""
        return f"{self.project.output}/dataset" if self.project.of("import").work_on_copy else self.project.input_dir

    def store(self, step: str, rows: DataFrame) -> DataFrame:
        if self.stopped.is_set():
            raise CancelledError(step)
        self.begun.append(self.folder(step))
        rows.write.mode("overwrite").parquet(self.folder(step))
        return self.spark.read.parquet(self.folder(step))

    def report_path(self, step: str) -> str:
        return f"{self.project.output}/reports/{step}.json"

    def images(self, *steps: str) -> DataFrame:
        """Images that the last of these steps that has run lets through."""
        for step in reversed(steps):
            if step in self.state.satisfied() and store.exists(self.spark, self.folder(step)):
                return self.spark.read.parquet(self.folder(step))
        raise SelectionError(f"none of {', '.join(steps)} has run")

    def current(self, *steps: str) -> DataFrame:
        """As images(), each as the manifest's layers have it now."""
        return manifest.overlaid(self.images(*steps), self.layers())

    def layers(self) -> list[DataFrame]:
        """Layers of the steps that are done, first to last."""
        there = [s for s in ("upscale",) if s in self.state.satisfied() and store.exists(self.spark, self.folder(f"{s}_layer"))]
        return [self.spark.read.parquet(self.folder(f"{s}_layer")) for s in there]

    def _roots(self) -> list[str]:
        made = f"{self.project.output}/upscaled"
        return [self.root, *([made] if self.layers() and store.exists(self.spark, made) else [])]

    def decoded(self) -> DataFrame:
        """All images that can be read, wherever they are; those of a step are joined by path."""
        return manifest.united([files.decoded(self.spark, root) for root in self._roots()]).filter("NOT corrupt")

    # the steps

    def _import(self) -> dict:
        c, source = self.project.of("import"), self.project.input_dir
        report: dict[str, Any] = {}
        if c.copy or c.work_on_copy:
            target = f"{self.project.output}/dataset"
            if not store.exists(self.spark, target):
                self.begun.append(target)
            sidecars = files.read_captions(self.spark, source).select("rel", F.col("text").cast("binary").alias("content"))
            images = files.scan_images(self.spark, source, case_sensitive=True).select("rel", "content")
            report["copied"] = files.copy_files(images.unionByName(sidecars), store.uri(target)).filter("copied").count()
        rows = files.scan_images(self.spark, self.root, case_sensitive=True)
        known = files.decoded(self.spark, self.root).select("rel", "w", "h", "corrupt")
        stored = self.store("import", rows.drop("content").join(known, "rel", "left"))
        return {"images": stored.count()} | report

    def _quality_gate(self) -> dict:
        rules = self.project.of("quality_gate").scorers
        if "score_images" in self.on:
            named = {**pixels.NAMED, **self.hooks.scorers}
            values = pixels.image_metrics(self.decoded(), {s.name: named[s.name] for s in rules if s.name in named and s.enabled}).drop("error")
            scored = self.images("import").join(values, "path", "left")
            for s in rules:
                if s.name not in scored.columns:
                    scored = scored.withColumn(s.name, F.lit(None).cast("double"))
            gated = quality_gate.gate(scored, rules)
            answers = self.hooks.decide("quality_gate", gated) if "review_decisions" in self.on else None
            stored = self.store("quality_gate_scores", quality_gate.apply_decisions(gated, answers))
        elif store.exists(self.spark, self.folder("quality_gate_scores")):
            stored = self.spark.read.parquet(self.folder("quality_gate_scores"))
        else:
            return {"skipped": True, "reason": "images have no scores"}
        if "write_survivors" in self.on:
            self.store("quality_gate", stored.filter("kept"))
        return quality_gate.gate_counts(stored).first().asDict()

    def _curate(self) -> dict:
        # the place of an image in the scan, sorted by path parts, orders the pairs
        numbered = self.store("curate_order", scan_order(self.images("import", "quality_gate"), [files.path_order(F.col("rel"))]))
        report: dict[str, Any] = {}
        if "deduplicate" in self.on:
            hashes = numbered.filter("phash IS NOT NULL").select("ord", F.col("phash").alias("h"), "blur")
            # pairs of different hashes; which images have them is in curate_order
            close = self.store("curate_close", duplicates.close_hashes(hashes, self.project.of("curate").max_distance))
            dropped = duplicates.greedy_drop_hashes(hashes, close)
            kept = self.store("curate", numbered.join(dropped, "ord", "left_anti").drop("ord"))
            report["duplicate_pairs"] = duplicates.pair_count(hashes, close)
        else:
            kept = self.store("curate", numbered.drop("ord"))
        report["images"] = kept.count()
        if "coverage_scan" in self.on and self.hooks.embed is not None:
            pictures = self.decoded().join(kept.select("path"), "path", "left_semi")
            how, places = neighbours.plane_of(self.store("curate_embeddings", self.hooks.embed(pictures)), "path")
            plane = self.store("curate_coverage", coverage.percent_coordinates(places))
            report |= {"coverage": plane.count(), "coverage_method": how}
        return report

    def _upscale(self) -> dict:
        c = self.project.of("upscale")
        # a layer of an earlier run counts no more
        store.delete(self.spark, self.folder("upscale_layer"))
        plan = upscale.guard_collisions(upscale.upscale_plan(self.images("import", "quality_gate", "curate"), c.target, c.highlight, c.generative))
        answers = self.hooks.decide("upscale", plan) if "review" in self.on else None
        stored = self.store("upscale", upscale.review(plan, answers) if answers is not None else plan)
        report: dict[str, Any] = {r["planned_action"]: r["count"] for r in stored.groupBy("planned_action").count().collect()}
        if not report:
            return {"skipped": True, "reason": "no images"}
        sized = self.hooks.upscale_for
        model = self.hooks.upscale or (None if sized is None else lambda rows: upscale.upscaled_by_target(rows, sized, c.target)) or (None if c.generative else lambda rows: pixels.upscaled(rows, c.target))
        if "upscale" in self.on and model is None:
            report["reason"] = "nothing was upscaled: no generative model was given"
        elif "upscale" in self.on:
            report["outcomes"] = self._upscaled(stored.filter("planned_action <> 'pass_through'"), model, c.least_ssim)
        return report

    def _upscaled(self, jobs: DataFrame, model: Callable[[DataFrame], DataFrame], least_ssim: float) -> dict:
        """Runs the model on planned images; what is like its original takes its place in the manifest. Failures keep the original."""
        pictures = files.decoded(self.spark, self.root).filter("NOT corrupt").select("path", "channels", "data")
        rows = jobs.join(pictures, "path").withColumn("divisor", F.when(F.col("needs_pre_downscale"), downscale_divisor(F.col("min_side"))))
        # content is large: it is written once, and read again only where it is wanted
        made = self.store("upscale_made", upscale.outcomes(model(rows), least_ssim))
        name = F.concat(F.regexp_extract("rel", "^(.*/)?", 0), F.substring_index("dest", "/", -1))
        wanted = made.filter("outcome = 'upscaled'").join(jobs.select("path", F.col("rel").alias("was"), name.alias("rel")), "path")
        target = f"{self.project.output}/upscaled"
        files.copy_files(wanted.select("rel", "content"), store.uri(target), overwrite=True).count()
        sizes = headers.image_headers(self.spark, target).select("rel", "path", "size", "w", "h")
        self.store("upscale_layer", wanted.select("was", "rel").join(sizes, "rel"))
        return {r["outcome"]: r["count"] for r in made.groupBy("outcome").count().collect()}

    def _captions(self) -> DataFrame:
        return files.read_captions(self.spark, self.root).select("stem", "text")

    def _final_captions(self) -> DataFrame:
        """stem, text as reviewers' edits have them, else as the caption step left them, else as the files do."""
        found = self._captions()
        if "caption" in self.state.satisfied() and store.exists(self.spark, self.folder("caption")):
            last = self.spark.read.parquet(self.folder("caption")).filter("text IS NOT NULL").select("stem", F.col("text").alias("last"))
            how = "full_outer" if self.project.of("export").new_captions else "left"
            # two images can share a stem, and so a caption
            found = found.join(last.groupBy("stem").agg(F.min("last").alias("last")), "stem", how).select("stem", F.coalesce("last", "text").alias("text"))
        if "verify_captions" in self.state.satisfied() and store.exists(self.spark, self.folder("caption_edits")):
            edits = self.spark.read.parquet(self.folder("caption_edits")).filter("outcome = 'applied'")
            stem = audit.rel_stem(files.relative(captions.resolved_path(F.col("path")), self.root))
            found = found.join(edits.groupBy(stem.alias("stem")).agg(F.max("after").alias("edit")), "stem", "left").select("stem", F.coalesce("edit", "text").alias("text"))
        return found

    def _caption(self) -> dict:
        c = self.project.of("caption")
        images = self.current("import", "quality_gate", "curate").withColumn("stem", audit.rel_stem(F.col("rel")))
        rows = images.join(self._captions().withColumnRenamed("text", "caption"), "stem", "left").withColumn("flagged", F.lit(False))
        todo = captions.pending(rows, c.overwrite)
        asked: Passes | None = None
        no_labels = F.array().cast("array<string>")
        if "caption" in self.on and self.hooks.vlm is not None:
            asked = Passes(f"{self.project.output}/passes", self.hooks.vlm, c.max_new_tokens, self.begun.append)
            if self.state.steps.get("caption", {}).get("status") == "done":
                # only the passes of a run that was stopped are gone on with
                store.delete(self.spark, asked.folder)
            regions = self.hooks.regions if self.hooks.regions is not None else self.spark.createDataFrame([], "stem string, labels array<string>, places array<string>")
            wanted = todo.select("path", "stem").join(self.decoded().drop("rel"), "path").join(regions, "stem", "left")
            how = grounded if c.strategy == "grounded" else single
            told = how(wanted, asked, c.concept_token, c.domain_brief, c.style_mode, c.prompt)
            named = todo.select("path", "stem").join(told, "path").join(regions.select("stem", "labels"), "stem", "left")
            made = named.select("stem", text.clean_caption(F.col("caption"), F.coalesce("labels", no_labels), F.lit(c.concept_token), c.style_mode).alias("made"))
        elif self.hooks.caption is None or "caption" not in self.on:
            made = todo.select("stem", F.lit(None).cast("string").alias("made"))
        else:
            made = self.hooks.caption(todo).select("stem", text.clean_caption(F.col("made"), F.array().cast("array<string>"), F.lit(c.concept_token), c.style_mode).alias("made"))
        whole = rows.join(made, "stem", "left").withColumn("text", F.coalesce("made", "caption"))
        stored = self.store("caption", whole.select(*images.columns, "text"))
        report = stored.agg(F.count(F.lit(1)).alias("images"), F.count("text").alias("captioned")).first().asDict()
        if asked is not None:
            report["passes"] = asked.tally(self.spark)
        if "validate_captions" in self.on:
            checks = captions.caption_checks(stored.filter("text IS NOT NULL").withColumnRenamed("text", "caption"), c.concept_token, c.style_mode)
            report |= checks.agg(F.count_if("missing_token").alias("missing_token"), F.count_if("out_of_bounds").alias("out_of_bounds")).first().asDict()
        return report

    def _verify_captions(self) -> dict:
        rows = self.images("caption")
        answers = self.hooks.decide("verify_captions", rows) if "review" in self.on else None
        if answers is None:
            return {"skipped": True, "reason": "no verdicts"}
        stored = self.store("verify_captions", answers)
        store.delete(self.spark, self.folder("caption_edits"))
        report: dict[str, Any] = {r["decision"]: r["count"] for r in stored.groupBy("decision").count().collect()}
        if "apply_edits" in self.on and "text" in stored.columns:
            edits = stored.filter("text IS NOT NULL").select("path", "text")
            judged = self.store("caption_edits", files.apply_caption_edits(self.spark, edits, self.root, f"{self.project.output}/caption_backup"))
            report["edits"] = {r["outcome"]: r["count"] for r in judged.groupBy("outcome").count().collect()}
        return report

    def _vae_gate(self) -> dict:
        c = self.project.of("vae_gate")
        images = self.current("import", "quality_gate", "curate")
        if "score" in self.on:
            if self.hooks.rebuild is None:
                return {"skipped": True, "reason": "no reconstruction model"}
            rebuilt = self.hooks.rebuild(self.decoded().join(images.select("path"), "path", "left_semi"))
            scores = self.store("vae_gate_scores", pixels.reconstruction_loss(rebuilt, c.cutoff))
        elif store.exists(self.spark, self.folder("vae_gate_scores")):
            scores = self.spark.read.parquet(self.folder("vae_gate_scores"))
        else:
            return {"skipped": True, "reason": "images have no scores"}
        judged = outliers.hf_outliers(scores, c.sigma)
        answers = self.hooks.decide("vae_gate", judged) if "review" in self.on else None
        if answers is not None and "apply_drops" in self.on:
            # rows that answers are about are known by the path that they have now
            images = outliers.apply_drops(images, answers)
        self.store("vae_gate", images)
        return outliers.hf_stats(scores, c.sigma).first().asDict() | {"flagged": judged.filter("outlier").count()}

    def _left(self) -> DataFrame:
        """The images that all gates let through, as they are now."""
        if "vae_gate" in self.state.satisfied() and store.exists(self.spark, self.folder("vae_gate")):
            return self.images("vae_gate")
        return self.current("import", "quality_gate", "curate")

    def _audit(self) -> dict:
        images = self._left().withColumn("stem", audit.rel_stem(F.col("rel")))
        texts = self._final_captions()
        checks = {"check_pairing": ("orphan_images", "orphan_captions"), "check_corrupt_files": ("corrupt",), "check_caption_quality": ("empty", "short", "long"), "check_resolution": ("undersized",)}
        off = [name for check, names in checks.items() if check not in self.on for name in names]
        return audit.audit_summary(audit.pairing(images, texts), texts, images, self.project.of("audit").min_resolution, off).first().asDict()

    def _bucket_check(self) -> dict:
        c = self.project.of("bucket_check")
        images = self._left().filter("w IS NOT NULL")
        if images.isEmpty():
            return {"skipped": True, "reason": "no images", "buckets": {}, "thin": []}
        if "assign" in self.on:
            assigned = self.store("bucket_check", buckets.assign_buckets(images, c.buckets))
        elif store.exists(self.spark, self.folder("bucket_check")):
            assigned = self.spark.read.parquet(self.folder("bucket_check"))
        else:
            return {"skipped": True, "reason": "images have no buckets", "buckets": {}, "thin": []}
        counts = buckets.bucket_counts(assigned, c.buckets)
        report = {"buckets": {f"{r['bw']}x{r['bh']}": r["n"] for r in counts.collect()}, "thin": [r.asDict() for r in buckets.thin_buckets(assigned, c.thin_threshold).orderBy("bw", "bh").collect()]}
        return report | ({"cache_info": json.loads(buckets.cache_info(counts).first()[0] or "{}")} if "write_cache_info" in self.on else {})

    def _export(self) -> dict:
        target = f"{self.project.output}_export"
        digests = lambda rows: rows.select(audit.rel_stem(F.col("rel")).alias("stem"), F.sha1("content").alias("digest"))
        texts = lambda rows: rows.select("stem", F.sha1(F.col("text").cast("binary")).alias("digest"))
        captioned = self._final_captions()
        source = manifest.united([files.scan_images(self.spark, root) for root in self._roots()]).join(self._left().select("path"), "path", "left_semi")
        none = self.spark.createDataFrame([], "stem string, digest string")
        there = store.exists(self.spark, target)
        diff = export.export_diff(digests(source), texts(captioned), digests(files.scan_images(self.spark, target)) if there else none, texts(files.read_captions(self.spark, target)) if there else none)
        stored = self.store("export_diff", diff)
        report = export.export_counts(stored).first().asDict()
        answers = self.hooks.decide("export", stored) if "copy" in self.on else None
        if answers is not None:
            chosen = export.to_copy(stored, answers.filter("decision = 'exclude'").select(F.col("path").alias("stem")))
            pictures = source.select(audit.rel_stem(F.col("rel")).alias("stem"), "rel", "content")
            sidecars = captioned.select("stem", F.concat("stem", F.lit(".txt")).alias("rel"), F.col("text").cast("binary").alias("content"))
            rows = pictures.unionByName(sidecars).join(chosen.select("stem"), "stem", "left_semi")
            written = files.copy_files(rows, store.uri(target), overwrite=True).filter("copied")
            report["copied"] = written.select(audit.rel_stem(F.col("rel"))).distinct().count()
        return report

    # a run

    def run(self, selected: Iterable[str] | None = None, force: bool = False, substeps: dict[str, list[str]] | None = None) -> dict[str, dict]:
        """Runs the selected steps, all by default, in the project's order; the report of each, or why it was skipped."""
        configured = list(self.project.steps)
        chosen = in_order(selected if selected is not None else configured, configured)
        undone = invalidated_by_force(chosen, configured) if force else []
        # what isn't chosen follows the steps' own settings; unknown steps are for validate() to name
        own = {s: default_substeps(s, dataclasses.asdict(self.project.of(s))) for s in chosen if s in BY_NAME} | (substeps or {})
        validate(chosen, configured, self.state.satisfied(), own, undone, store.exists(self.spark, self.folder("import")))
        for step in undone:
            self.state.steps.pop(step, None)
            store.delete(self.spark, self.report_path(step))
        self.idle.clear()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return self._steps(chosen, force, own)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            self.idle.set()

    def _steps(self, chosen: list[str], force: bool, substeps: dict[str, list[str]]) -> dict[str, dict]:
        reports: dict[str, dict] = {}
        for step in chosen:
            if self.hooks.cancelled() or self.stopped.is_set():
                raise CancelledError(step)
            if reason := skip_reason(self.state, step, force):
                reports[step] = {"skipped": True, "reason": reason}
                continue
            self.hooks.before(step)
            on = enabled_substeps(step, substeps.get(step))
            self.on, self.begun = set(on), []
            try:
                report = getattr(self, f"_{step}")()
                if self.stopped.is_set():
                    raise CancelledError(step)
            except Exception as e:
                if self.stopped.is_set():
                    for folder in self.begun:
                        store.delete(self.spark, folder)
                    self.state.mark(step, "cancelled")
                    raise CancelledError(step) from e
                self.state.mark(step, "failed", reason=str(e)[:500])
                raise
            how, why = outcome(report)
            self.state.mark(step, "done", outcome=how, reason=why, substeps={s: "done" for s in on})
            store.write_text(self.spark, self.report_path(step), json.dumps(report, indent=2, default=str))
            self.hooks.after(step, report)
            reports[step] = report
        return reports
