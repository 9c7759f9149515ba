"""Model and memory planning as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Memory ladders (GB), and figures for planning a text-to-image model.
EMBEDDING_LADDER = [(16, "ViT-B-32"), (24, "facebook/dinov2-base"), (32, "Qwen/Qwen3-VL-Embedding-2B")]
EMBEDDING_LARGEST = "Qwen/Qwen3-VL-Embedding-8B"
RENDER_LADDER = [(0, "stable-diffusion-v1-5/stable-diffusion-v1-5"), (16, "stabilityai/stable-diffusion-xl-base-1.0")]
RENDER_LARGEST = "black-forest-labs/FLUX.2-klein-base-9B"
MODEL_ALIASES = {
    "openai/clip-vit-base-patch32": "ViT-B-32",
    "openai/clip-vit-base-patch16": "ViT-B-16",
    "openai/clip-vit-large-patch14": "ViT-L-14",
    "openai/clip-vit-large-patch14-336": "ViT-L-14-336",
}
QUANT_DIVISOR = {"none": 1.0, "8bit": 1.9, "4bit": 3.6}
OVERHEAD, TOTAL_SHARE, FREE_MARGIN, RESIDENT_SHARE = 1.15, 0.85, 1.0, 0.75
UNKNOWN_PARAMS, UNKNOWN_TEXT = 3.0, 1.0


def ladder(gb: Column, rungs: list[tuple[int, str]], largest: str) -> Column:
    """The name of the first rung that is not below gb."""
    gb = F.coalesce(gb.cast("double"), F.lit(0.0))
    (first, name), *rest = rungs
    out = F.when(gb <= first, name)
    for most, name in rest:
        out = out.when(gb <= most, name)
    return out.otherwise(largest)


def embedding_model(gb: Column) -> Column:
    return ladder(gb, EMBEDDING_LADDER, EMBEDDING_LARGEST)


def canonical_model(model: Column) -> Column:
    """The id that a model is listed under; none means the smallest, unknown ids stay."""
    known = F.create_map(*[F.lit(x) for pair in MODEL_ALIASES.items() for x in pair])
    return F.when(F.coalesce(F.length(model), F.lit(0)) == 0, EMBEDDING_LADDER[0][1]).otherwise(F.coalesce(F.try_element_at(known, model), model))


def render_model(gb: Column) -> Column:
    return ladder(gb, RENDER_LADDER, RENDER_LARGEST)


def caption_quantization(gb: Column, cuda: Column, quantizer: Column) -> Column:
    """4 bit up to 16 GB, 8 bit up to 32 or if unknown, else none."""
    gb = F.coalesce(gb, F.lit(0.0))
    return F.when(~cuda | ~quantizer, "none").when((gb > 0) & (gb <= 16), "4bit").when(gb <= 32, "8bit").otherwise("none")


def residency(policy: Column, model: Column, gb: Column) -> Column:
    """Where an upscaling model stays: gpu if there is memory enough for its size, else cpu."""
    name = F.lower(model)
    half = F.contains(name, F.lit("fp16")) & ~F.contains(name, F.lit("fp8"))
    large = F.contains(name, F.lit("7b"))
    least = F.when(large & half, 40.0).when(large | half, 24.0).otherwise(16.0)
    wish = F.lower(F.trim(F.coalesce(policy, F.lit("auto"))))
    return F.when(wish.isin("cpu", "gpu"), wish).when(wish != "auto", "cpu").when(gb >= least, "gpu").otherwise("cpu")


def budget(total: Column, free: Column) -> Column:
    """Memory to plan with: a share of all, and what is free but for a margin."""
    total, free = F.greatest(F.coalesce(total, F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(free, F.lit(0.0)), F.lit(0.0))
    return F.when(free == 0, total * TOTAL_SHARE).otherwise(F.least(total * TOTAL_SHARE, F.greatest(free - FREE_MARGIN, F.lit(0.0))))


def weight_gb(params: Column, text: Column) -> Column:
    return (F.coalesce(params, F.lit(UNKNOWN_PARAMS)) + F.coalesce(text, F.lit(UNKNOWN_TEXT))) * 2.0 * OVERHEAD


def generation_plan(params: Column, text: Column, total: Column, free: Column, cuda: Column, quantizer: Column, quantization: Column, offload: Column) -> Column:
    """How to load a text-to-image model: quantization, offload, device, dtype, error.

    Explicit 4bit or 8bit that can't be had is an error; auto steps down. 4-bit weights can't be offloaded layer by
    layer, so that such a plan is without quantization.
    """
    need, room = weight_gb(params, text), budget(total, free)
    explicit = quantization.isin("4bit", "8bit")
    error = F.when(explicit & ~cuda, "needs CUDA").when(explicit & ~quantizer, "needs a quantizer")
    auto = F.when(~quantizer | (room == 0) | (need <= room), "none").otherwise("4bit")
    chosen = F.when(quantization == "auto", auto).otherwise(quantization)
    divisor = F.when(chosen == "4bit", QUANT_DIVISOR["4bit"]).when(chosen == "8bit", QUANT_DIVISOR["8bit"]).otherwise(1.0)
    held = need / divisor
    placed = F.when(room == 0, "model").when(held <= room * RESIDENT_SHARE, "none").when(held <= room, "model").otherwise("sequential")
    placed = F.when(offload == "auto", placed).otherwise(offload)
    final = F.when((chosen == "4bit") & (placed == "sequential"), "none").otherwise(chosen)
    ok = error.isNull()
    return F.struct(
        F.when(ok, F.when(~cuda, "none").otherwise(final)).alias("quantization"),
        F.when(ok, F.when(~cuda, "none").otherwise(placed)).alias("offload"),
        F.when(ok, F.when(cuda, "cuda").otherwise("cpu")).alias("device"),
        F.when(ok, F.when(cuda, "bfloat16").otherwise("float32")).alias("dtype"),
        error.alias("error"),
    )


def preview_seed(path: Column, seed: Column) -> Column:
    """A seed for a preview that depends on its path."""
    return F.pmod(F.crc32(path.cast("binary")) + seed, F.lit(2**31))


def model_family(model: Column) -> Column:
    """The family of a model that isn't in the catalogue, by its name."""
    name = F.lower(model)
    return F.when(F.contains(name, F.lit("dinov2")), "dinov2").when(F.contains(name, F.lit("qwen")), "qwen").when(F.contains(name, F.lit("/")), "dinov2").otherwise("clip")
