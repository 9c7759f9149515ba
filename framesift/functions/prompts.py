"""Prompts of the caption passes as Column builders: what a model is asked, with its placeholders filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.text import annotation_lines, bound, fill_template, trimmed, with_brief

ONLY_SEEN = "Say only what can plainly be seen, and add nobody and nothing else. What you can't name with confidence, describe by shape, material and colour."
OBSERVE = f"""Look at the image and note facts for a caption that comes later. {ONLY_SEEN}
{{bbox_annotations}}
One line each, a few words, "not visible" where there is nothing to say; begin a line with "?" if it describes something that you can't name:
SUBJECT:
COUNT:
APPEARANCE:
ACTION:
SETTING:
OBJECTS:
FRAMING:
LIGHTING:
COLOURS:
STYLE:"""
CAPTION_RULES = """Write one caption of 20 to 80 words (fewer for a single plain object) in natural language: the main subject first, then setting, style, light, colours and mood where they are there. Weave labelled regions in, in their own words. No filler, no "this image shows", no quotes, nothing but the caption. {token_rule}"""
TOKEN_RULE = "It has to contain {concept_token} exactly as written."
STYLE_RULE = "It has no trigger word: content alone."
FULL_IMAGE = f"Caption this image for training a text-to-image model.\n{{bbox_annotations}}\n{ONLY_SEEN}\n{CAPTION_RULES}"
COMPOSE = f"Write a training caption for this image.\n{{grounding}}\n{{bbox_annotations}}\n{CAPTION_RULES}"
OBSERVED = "Use these facts and no others; leave out what is not visible:\n{facts}"
UNNAMED = '\nA fact behind "?" has no sure name: keep its description, and leave the mark out.'
ANNOTATED = "No facts were noted: what the labelled regions leave open (setting, framing, light, colours, style) read off the image."
FACTS_FIRST = "Facts that were seen in the image (use only these):\n{facts}\n\n"
GAP = """Compare this caption with the image:
{draft}
Name what is plainly visible and missing from it: one short noun phrase a line, three lines at most, without numbers or marks. Don't repeat or rewrite the caption. If nothing is missing, answer NONE."""
REGION = "Name what is shown here in one short phrase: the main thing and what marks it (material, colour, shape). Only what is visible; no list, no mention of a crop."
REGION_PLACED = f"This is a part of a larger image, {{region_position}}. {REGION} Leave the larger image out."
NO_LABELS = "  (no annotations: describe the whole image)"
#: Tokens that a pass may make at least (observe) or at most (gap).
OBSERVE_TOKENS, GAP_TOKENS = 320, 48


def annotations(labels: Column, places: Column) -> Column:
    """The labelled regions, a line each, or that there are none."""
    return bound(annotation_lines(labels, places), lambda lines: F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NO_LABELS))


def _rules(prompt: str, style_mode: bool) -> str:
    return prompt.replace("{token_rule}", STYLE_RULE if style_mode else TOKEN_RULE)


def observe(lines: Column, brief: Column) -> Column:
    return with_brief(fill_template(F.lit(OBSERVE), {"bbox_annotations": lines}), brief)


def full_image(lines: Column, token: Column, brief: Column, style_mode: bool = False, template: str | None = None) -> Column:
    """A user's template has the same placeholders as the built-in one."""
    prompt = F.lit(template or _rules(FULL_IMAGE, style_mode or False))
    return with_brief(fill_template(prompt, {"bbox_annotations": lines, "concept_token": token}), brief)


def compose(facts: Column, lines: Column, token: Column, brief: Column, style_mode: bool = False, template: str | None = None) -> Column:
    """From facts that were observed; without any, null or blank, the regions are what the caption rests on. A user's template comes behind the facts."""
    known = trimmed(F.coalesce(facts, F.lit("")))
    there = F.length(known) > 0
    if template:
        body = fill_template(F.lit(template), {"bbox_annotations": lines, "concept_token": token})
        return with_brief(F.when(there, F.concat(fill_template(F.lit(FACTS_FIRST), {"facts": known}), body)).otherwise(body), brief)
    observed = F.concat(fill_template(F.lit(OBSERVED), {"facts": known}), F.when(F.contains(known, F.lit("?")), UNNAMED).otherwise(""))
    # facts are filled in last: braces in them are text
    body = fill_template(F.lit(_rules(COMPOSE, style_mode)), {"bbox_annotations": lines, "concept_token": token})
    return with_brief(fill_template(body, {"grounding": F.when(there, observed).otherwise(ANNOTATED)}), brief)


def gap(draft: Column) -> Column:
    return fill_template(F.lit(GAP), {"draft": draft})


def region(position: Column, brief: Column, template: str | None = None) -> Column:
    """For a crop; position says where it was, null if that isn't known."""
    if template:
        prompt = fill_template(F.lit(template), {"region_position": position, "bbox_annotations": F.lit(""), "concept_token": F.lit("")})
    else:
        prompt = F.when(F.length(position) > 0, fill_template(F.lit(REGION_PLACED), {"region_position": position})).otherwise(REGION)
    return with_brief(prompt, brief)
