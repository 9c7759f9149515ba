from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesift.functions import text as t

RICH = "A brass telescope stands on a wooden table beside the tall window while soft morning light falls across the dusty floor of a quiet room."


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    ("draft", "labels", "reason"),
    [
        (RICH, ["brass telescope"], None),
        ("A telescope.", [], "short_caption"),
        (RICH, ["a chipped enamel mug"], "missing_label"),
        (RICH, ["Tall Windows"], None),
        (RICH + " It shows some kind of object, beautiful too.", [], "low_information"),
        (RICH + " A photorealistic view.", [], None),
        (None, [], "short_caption"),
    ],
)
def test_needs_gap_pass(spark, draft, labels, reason):
    assert one(spark, t.needs_gap_pass(F.lit(draft).cast("string"), strings(*labels))) == reason


def test_parse_gap_phrases(spark):
    parse = lambda raw: one(spark, t.parse_gap_phrases(F.lit(raw).cast("string")))
    assert parse('- a red hat\n2. "a wooden bench"\n* the open window') == ["a red hat", "a wooden bench", "the open window"]
    assert parse("Missing elements:\na hat\nNONE\na dog") == ["a hat"]
    assert parse("the caption lacks a dog\n" + "word " * 9 + "\na dog.") == ["a dog"]
    assert parse("a\nb\nc\nd") == ["a", "b", "c"]
    assert parse(None) == [] and parse("") == []


def test_merge(spark):
    merge = lambda c, *p: one(spark, t.merge_missing_phrases(F.lit(c), strings(*p)))
    assert merge("A telescope", "a red hat", "the red hats") == "A telescope, a red hat"
    assert merge("A brass telescope.", "a red curtain") == "A brass telescope, a red curtain."
    assert merge("A skyline", "Eiffel Tower") == "A skyline, Eiffel Tower"
    assert merge("A room", "LED strip") == "A room, LED strip"
    assert merge("A room", "Red lamp") == "A room, red lamp"
    assert merge("A telescope.") == "A telescope."
    assert merge("x" * 598, "a red hat") == "x" * 598


def test_labels_and_tokens(spark):
    clean = lambda c, labels, token, style=False: one(spark, t.clean_caption(F.lit(c), strings(*labels), F.lit(token).cast("string"), style))
    assert clean("This image shows a mug", ["sks, a blue rim"], "sks") == "sks, A mug, a blue rim"
    assert clean("a mug with a rim", ["a chipped mug"], None) == "A mug with a rim"
    assert clean("a mug", [], "sks", True) == "A mug"
    assert clean("a mug", ["one two three four five six seven eight lamps"], None) == "A mug"
    again = lambda c: one(spark, t.normalize_region_caption(F.lit(c), F.lit("sks")))
    assert again("SKS, a mug") == "sks, A mug" and again("a mug") == "sks, A mug" and again(" ") == ""
    assert one(spark, t.head_noun(F.lit("a chipped enamel mug with a blue rim"))) == "mug"
    assert one(spark, t.head_noun(F.lit("of the"))) is None
    assert one(spark, t.fill_template(F.lit("x {concept_token} {y}"), {"concept_token": F.lit("sks")})) == "x sks {y}"
    assert [one(spark, t.initials(F.lit(n))) for n in ("red fox", "fox", "-")] == ["RF", "FO", "??"]


def test_captions_are_work_for_many_tasks(spark):
    """The sample's captions, from one small file, are dealt over tasks, and each text rule is worked out once."""
    from framesift.queries import QUERIES

    for name in ("normalize_region_caption", "compose_caption"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.rdd.getNumPartitions() > 8
    # cleaning a clean caption is one expression more, not a multiple of it
    size = lambda c: len(spark.range(1).select(F.lit("a").alias("x")).select(c.alias("x"))._jdf.queryExecution().analyzed().toString())
    once = size(t.strip_boilerplate(F.col("x")))
    assert size(t.strip_boilerplate(t.strip_boilerplate(F.col("x")))) < 2.2 * once


def test_human_bytes(spark):
    """As Python (and C) round: by the binary value, halves to the even digit; and the largest unit that is asked for."""

    def reference(size: float, units: tuple[str, ...]) -> str:
        for unit in units:
            if size < 1024 or unit == units[-1]:
                return f"{size:.{0 if unit in ('B', 'KB') else 1}f} {unit}"
            size /= 1024

    sizes = [0.5, 1.5, 2.5, 1023.5, 1536.0, 2560.0, 1.25 * 2**20, 1.75 * 2**20, 2.25 * 2**30, 3.95 * 2**20, 1.55 * 2**20, 1.05 * 2**30, 1.15 * 2**40, 1023.96 * 2**20, 2.0**40, 5.25 * 2**40, 3e15, 1e19]
    sizes += [(1 + (2 * i + 1) / 20 + e * 2.0**-52) * 2**20 for i in range(10) for e in (-1, 0, 1)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, v double").select("i", t.human_bytes(F.col("v")).alias("all"), t.human_bytes(F.col("v"), "GB").alias("gb")).orderBy("i").collect()
    units = ("B", "KB", "MB", "GB", "TB")
    assert [r["all"] for r in df] == [reference(v, units) for v in sizes]
    assert [r["gb"] for r in df] == [reference(v, units[:4]) for v in sizes]


def reference_strip(text: str) -> str:
    """The rule itself, written as a loop."""
    patterns = [re.compile(p, re.IGNORECASE) for p in t.BOILERPLATE]
    text, before = text.strip(), None
    while text != before:
        before = text
        for p in patterns:
            text = p.sub("", text).strip()
    return text[:1].upper() + text[1:]


PIECES = st.lists(st.sampled_from(["This image shows ", "a photo of ", "here we see ", "In this picture, ", "a red mug", " Stock photo", "ai generated", ". ", "\n", " the photo shows: ", "(shutterstock"]), max_size=8)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=1, max_size=30))
def test_strip_boilerplate(spark, batches):
    texts = ["".join(b) for b in batches]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.strip_boilerplate(F.col("s")).alias("x"))
    assert [r["x"] for r in df.orderBy("i").collect()] == [reference_strip(s) for s in texts]
