"""Sizes, aspect ratios, buckets and boxes as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default resolution buckets.
BUCKETS = [(1024, 1024), (1152, 896), (896, 1152), (1216, 832), (832, 1216), (1344, 768), (768, 1344), (1536, 640), (640, 1536)]


def whole(value: Column) -> Column:
    """The whole part of a number, as int() gives it."""
    return value.cast("long")


def bucket_distance(w: Column, h: Column, bw: int, bh: int) -> Column:
    """Distance of aspect ratios on a log scale."""
    return F.abs(F.ln(w / h) - F.ln(F.lit(bw / bh)))


def nearest_bucket(w: Column, h: Column, buckets: Sequence[tuple[int, int]] = BUCKETS, digits: int | None = None) -> Column:
    """The bucket (ord, bw, bh) of the nearest aspect ratio; of equally near ones the first. Null for sizes below 1."""
    near = [F.struct((F.round(d, digits) if digits else d).alias("dist"), F.lit(i).alias("ord"), F.lit(bw).alias("bw"), F.lit(bh).alias("bh")) for i, (bw, bh) in enumerate(buckets) for d in [bucket_distance(w, h, bw, bh)]]
    return F.when((w >= 1) & (h >= 1), F.array_min(F.array(*near)))


def crop_suggestion(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    """How to crop an image to a bucket's aspect ratio."""
    wide = w / h > bw / bh
    return F.when(wide, F.concat(F.lit("centre-crop width to "), whole(h * (bw / bh)).cast("string"), F.lit("px (from "), w.cast("string"), F.lit("px)"))).otherwise(
        F.concat(F.lit("centre-crop height to "), whole(w / (bw / bh)).cast("string"), F.lit("px (from "), h.cast("string"), F.lit("px)"))
    )


def crop_loss_pct(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    """Percent of an image that a crop to the bucket's ratio takes away; null for sizes below 1."""
    source, target = w / F.nullif(h, F.lit(0)), bw / F.nullif(bh, F.lit(0))
    loss = F.floor((1 - F.least(source / target, target / source)) * 100 + 0.5)
    return F.when((w > 0) & (h > 0) & (bw > 0) & (bh > 0), loss)


def downscale_divisor(min_side: Column) -> Column:
    """2 or 3, whichever brings the short side nearer to 1024; 2 if both do."""
    return F.when(F.abs(min_side / 2 - 1024) <= F.abs(min_side / 3 - 1024), 2).otherwise(3)


def pixel_budget(w: Column, h: Column, most: int = 1024 * 1024) -> Column:
    """Size (w, h) within a number of pixels, at the same ratio."""
    scale = F.sqrt(F.lit(float(most)) / (w * h))
    over = w * h > most
    return F.struct(F.when(over, F.greatest(F.lit(1), whole(w * scale))).otherwise(w).alias("w"), F.when(over, F.greatest(F.lit(1), whole(h * scale))).otherwise(h).alias("h"))


def snap(value: Column, step: int, least: int) -> Column:
    """Down to a multiple of step, at least `least`."""
    return F.greatest(F.lit(least).cast("long"), whole(F.floor(value / step)) * step)


def clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def sorted_box(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """A box clamped to the unit square, with its corners in order."""
    a, b, c, d = clamped(x1), clamped(y1), clamped(x2), clamped(y2)
    return F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)


def crop_bounds(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """A box in pixels, at least one pixel wide and high."""
    a, b, c, d = sorted_box(x1, y1, x2, y2)
    left, top = F.least(whole(a * w), w - 1), F.least(whole(b * h), h - 1)
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(left + 1, whole(c * w)).alias("right"), F.greatest(top + 1, whole(d * h)).alias("bottom"))


def box_position(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where a box lies, in plain words."""
    a, b, c, d = sorted_box(x1, y1, x2, y2)
    w, h, cx, cy = c - a, d - b, (a + c) / 2, (b + d) / 2
    wide, tall = w >= 0.66, h >= 0.66
    zone = lambda v, names: F.when(v < 0.30, names[0]).when(v < 0.62, names[1]).otherwise(names[2])
    corner = F.when(cy < 0.30, zone(cx, ("in the upper-left", "at the top-center", "in the upper-right"))).when(cy < 0.62, zone(cx, ("on the left", "in the center", "on the right"))).otherwise(zone(cx, ("in the lower-left", "at the bottom-center", "in the lower-right")))
    return (
        F.when(wide & tall, F.when(w * h >= 0.75, "filling the frame").otherwise("spread across most of the frame"))
        .when(wide, zone(cy, ("across the top", "across the middle", "across the bottom")))
        .when(tall, zone(cx, ("down the left side", "down the center", "down the right side")))
        .when(w * h < 0.06, F.concat(F.lit("a small element "), corner))
        .otherwise(corner)
    )


def parse_box(spec: Column, w: Column, h: Column) -> Column:
    """A box from `X1,Y1,X2,Y2[:LABEL]`: in pixels, or in shares of the image if none is above 1. Null if it isn't one."""
    place, label = F.substring_index(spec, ":", 1), F.when(F.contains(spec, F.lit(":")), F.substr(spec, F.instr(spec, ":") + 1)).otherwise("")
    parts = F.transform(F.split(place, ","), lambda p: F.trim(p).try_cast("double"))
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull())
    shares = F.forall(parts, lambda p: p <= 1.0)
    at = [F.when(shares, F.get(parts, F.lit(i))).otherwise(F.get(parts, F.lit(i)) / (w if i % 2 == 0 else h)) for i in range(4)]
    a, b, c, d = sorted_box(*at)
    return F.when(ok, F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"), F.trim(label).alias("label")))
