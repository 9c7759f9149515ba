"""Caption text rules as Column builders, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without visual content, prepositions, filler terms, boilerplate patterns, the head of a brief, and limits.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "behind", "beside", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "over", "that", "the", "their", "there", "this", "to", "under", "up", "with", "within"]
PREPOSITIONS = ["about", "above", "across", "against", "along", "amid", "among", "around", "at", "atop", "before", "behind", "below", "beneath", "beside", "between", "beyond", "by", "down", "during", "for", "from", "in", "inside", "into", "near", "of", "off", "on", "onto", "outside", "over", "past", "through", "to", "toward", "under", "underneath", "up", "upon", "with", "within", "without"]
FILLER = ["some kind of", "a type of", "a sort of", "various", "several objects", "an object", "a scene", "something", "unidentified", "unknown", "detailed", "beautiful", "realistic", "high quality", "stunning", "intricate", "etc"]
BOILERPLATE = [
    r"^(this image (shows?|depicts?|features?|captures?|presents?)[,:]?\s*)",
    r"^(the (photo|photograph|image|picture) (shows?|depicts?|features?|captures?)[,:]?\s*)",
    r"^(in this (image|photo|photograph|picture)[,:]?\s*)",
    r"^(here (we see|is)[,:]?\s*)",
    r"^(a (photo|photograph|image|picture) (of|showing|depicting|featuring)[,:]?\s*)",
    r"\s*\(?(generated|ai.?generated|stock photo|getty images?|shutterstock)[^.]*\.?\s*$",
]
LIST_MARKER = r"^(?U)\s*(?:[-*•–—]+|\d+[.)])\s*"
DOMAIN_BRIEF = "Domain context for this dataset — authoritative, and it outranks your own assumptions about what things are:\n{domain_brief}\n\n"
MIN_WORDS, MAX_CHARS, MAX_PHRASES, MAX_PHRASE_WORDS, MAX_LABEL_WORDS = 20, 600, 3, 8, 6
QUOTES = "\"'“”‘’"
#: Unicode white space, with the separators that Python counts too.
BLANK = r"[\s\x1c-\x1f]"


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def stripped_of(text: Column, characters: str) -> Column:
    """Without any of some characters at either end."""
    inner = "".join("\\" + c if c in "\\]^-[&" else c for c in characters)
    return F.regexp_replace(text, f"^[{inner}]+|[{inner}]+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def _ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def singular(word: Column) -> Column:
    """Folds a plural: a word of over three letters loses its s, but not after s, u or i."""
    return F.when((F.length(word) > 3) & word.rlike("[^sui]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def content_words(text: Column) -> Column:
    """Distinct words with visual content, lower case and singular."""
    return F.array_distinct(F.transform(F.filter(_ascii_words(text), lambda w: ~w.isin(STOPWORDS)), singular))


def covered(haystack: Column, phrase: Column) -> Column:
    """Whether all content words of phrase are in haystack; true for a phrase without any."""
    return F.size(F.array_except(content_words(phrase), content_words(haystack))) == 0


def head_noun(phrase: Column) -> Column:
    """What a phrase names: its last content word before the first preposition or comma; null if there is none."""
    base = F.substring_index(F.coalesce(phrase, F.lit("")), ",", 1)
    start = F.struct(F.lit(None).cast("string").alias("head"), F.lit(False).alias("over"))

    def step(s: Column, w: Column) -> Column:
        over = s["over"] | w.isin(PREPOSITIONS)
        return F.struct(F.when(over | w.isin(STOPWORDS), s["head"]).otherwise(w).alias("head"), over.alias("over"))

    return F.aggregate(_ascii_words(base), start, step, lambda s: singular(s["head"]))


def mentions(haystack: Column, phrase: Column) -> Column:
    """Whether haystack has the thing that phrase names; true if it names none."""
    return bound(head_noun(phrase), lambda head: head.isNull() | F.array_contains(content_words(haystack), head))


def strip_boilerplate(text: Column) -> Column:
    """Without stock phrases at either end, over and over until none is left; then a capital first."""

    def one_pass(t: Column) -> Column:
        for pattern in BOILERPLATE:
            t = trimmed(F.regexp_replace(t, f"(?iUd){pattern}", ""))
        return t

    # where no phrase is found a pass changes nothing, and one search is cheaper than six replacements
    stock = f"(?iUd)(?:{'|'.join(BOILERPLATE)})"

    def step(s: Column, _: Column) -> Column:
        done = F.struct(s["text"].alias("text"), F.lit(True).alias("over"))
        again = bound(one_pass(s["text"]), lambda t: F.struct(t.alias("text"), (t == s["text"]).alias("over")))
        return F.when(s["over"], s).when(~s["text"].rlike(stock), done).otherwise(again)

    def clean(text: Column) -> Column:
        # each pass that changes the text takes 8 characters away or more
        passes = F.sequence(F.lit(0), F.floor(F.length(text) / 8).cast("int"))
        return F.aggregate(passes, F.struct(text.alias("text"), F.lit(False).alias("over")), step, lambda s: s["text"])

    return bound(bound(trimmed(text), clean), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2147483647)))


def token_present(caption: Column, token: Column) -> Column:
    return F.contains(F.lower(caption), F.lower(token))


def length_ok(caption: Column, least: int = 10, most: int = MAX_CHARS) -> Column:
    return F.length(trimmed(caption)).between(least, most)


def needs_gap_pass(draft: Column, labels: Column, min_words: int = MIN_WORDS) -> Column:
    """Why a draft needs another pass: short_caption, missing_label or low_information; null if it doesn't."""
    text = trimmed(F.coalesce(draft, F.lit("")))
    named = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), trimmed), lambda x: F.length(x) > 0)
    filler = r"(?iU)\b(?:" + "|".join(FILLER) + r")\b"
    return bound(
        text,
        lambda t: F.when(F.size(words(t)) < min_words, "short_caption")
        .when(F.exists(named, lambda x: ~mentions(t, x)), "missing_label")
        .when(t.rlike(filler), "low_information"),
    )


def parse_gap_phrases(raw: Column, most: int = MAX_PHRASES, most_words: int = MAX_PHRASE_WORDS) -> Column:
    """The short noun phrases of a reply, one a line; stops at `none`, leaves out headers, talk of captions and prose."""
    lines = F.split(F.coalesce(raw, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")

    def clean(line: Column) -> Column:
        line = trimmed(F.regexp_replace(trimmed(line), LIST_MARKER, ""))
        return trimmed(stripped_of(line, QUOTES))

    def step(s: Column, line: Column) -> Column:
        bare = F.lower(stripped_of(line, " .,:;!"))
        out = (F.length(bare) == 0) | line.endswith(":") | F.contains(bare, F.lit("caption")) | (F.size(words(bare)) > most_words)
        over = s["over"] | ((F.length(bare) > 0) & (bare == "none")) | (F.size(s["found"]) >= most)
        return F.struct(F.when(over | out, s["found"]).otherwise(F.concat(s["found"], F.array(stripped_of(line, " .,;")))).alias("found"), over.alias("over"))

    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("over"))
    return F.aggregate(F.transform(lines, clean), start, step, lambda s: s["found"])


def _is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def decapitalised(phrase: Column) -> Column:
    """A small first letter, but for acronyms and names (a later word with a capital)."""
    small = F.concat(F.lower(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 2147483647))
    return bound(
        words(phrase),
        lambda ws: F.when(F.size(ws) == 0, phrase)
        .when((F.length(ws[0]) > 1) & _is_upper(ws[0]), phrase)
        .when(F.exists(F.slice(ws, F.lit(2), F.size(ws)), lambda w: _is_upper(F.substring(w, 1, 1))), phrase)
        .otherwise(small),
    )


def merge_missing_phrases(caption: Column, phrases: Column, most: int = MAX_CHARS) -> Column:
    """caption with the phrases it doesn't cover appended, as far as it stays within most characters."""
    whole = trimmed(F.coalesce(caption, F.lit("")))

    def step(s: Column, phrase: Column) -> Column:
        p = stripped_of(stripped_of(trimmed(F.coalesce(phrase, F.lit(""))), QUOTES), " .,;")
        longer = F.concat(s["body"], F.lit(", "), decapitalised(p))
        fits = (F.length(p) > 0) & ~covered(s["body"], p) & (F.length(longer) + F.length(s["stop"]) <= most)
        return F.when(fits, F.struct(longer.alias("body"), s["stop"].alias("stop"), F.lit(True).alias("more"))).otherwise(s)

    def merge(text: Column) -> Column:
        stop = F.when(text.endswith("."), ".").otherwise("")
        start = F.struct(F.regexp_replace(text, "[ .,;]+$", "").alias("body"), stop.alias("stop"), F.lit(False).alias("more"))
        return F.aggregate(F.coalesce(phrases, F.array().cast("array<string>")), start, step, lambda s: F.when(s["more"], F.concat(s["body"], s["stop"])).otherwise(text))

    return bound(whole, merge)


def label_text(label: Column, token: Column) -> Column:
    """A region label without the parts that are the concept token."""
    parts = F.transform(F.split(label, ","), trimmed)
    own = F.filter(parts, lambda p: (F.length(p) > 0) & (F.coalesce(F.length(token), F.lit(0)).eqNullSafe(0) | ~F.lower(p).eqNullSafe(F.lower(trimmed(token)))))
    return F.array_join(own, ", ")


def _missing_labels(caption: Column, labels: Column, token: Column) -> Column:
    named = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: label_text(trimmed(F.coalesce(x, F.lit(""))), token)), lambda x: F.length(x) > 0)
    return F.filter(named, lambda x: ~mentions(caption, x))


def enforce_region_labels(caption: Column, labels: Column, token: Column) -> Column:
    """caption with the labels it doesn't mention appended, but for labels of over six content words."""
    short = F.filter(_missing_labels(caption, labels, token), lambda x: F.size(content_words(x)) <= MAX_LABEL_WORDS)
    return bound(short, lambda xs: F.when(F.size(xs) == 0, caption).otherwise(merge_missing_phrases(caption, xs)))


def with_token(caption: Column, token: Column) -> Column:
    """caption behind the concept token, if it is without it."""
    lacks = (F.coalesce(F.length(token), F.lit(0)) > 0) & ~token_present(caption, token)
    return F.when(lacks, F.concat(token, F.lit(", "), caption)).otherwise(caption)


def clean_caption(caption: Column, labels: Column, token: Column, style_mode: bool = False) -> Column:
    """Boilerplate off, dropped labels back in, the concept token at the head (not in style mode)."""

    def finish(text: Column) -> Column:
        whole = enforce_region_labels(text, labels, token)
        return whole if style_mode else bound(whole, lambda t: with_token(t, token))

    return bound(strip_boilerplate(caption), finish)


def normalize_region_caption(caption: Column, token: Column) -> Column:
    """Cleaned, with the token in front; one that is there already stays, so that doing it again changes nothing."""
    mark = trimmed(F.coalesce(token, F.lit("")))

    def normal(text: Column) -> Column:
        starts = lambda sep: F.startswith(F.lower(text), F.lower(F.concat(mark, F.lit(sep))))
        cut = F.when(starts(", "), 2).when(starts(","), 1).when(starts(" "), 1).otherwise(0)
        led = (F.length(mark) > 0) & (cut > 0)
        rest = F.when(led, F.substr(text, F.length(mark) + cut + 1)).otherwise(text)
        return bound(
            strip_boilerplate(rest),
            lambda body: F.when(led, F.concat(mark, F.lit(", "), body)).when(F.length(body) > 0, with_token(body, F.coalesce(token, F.lit("")))).otherwise(body),
        )

    return bound(trimmed(caption), normal)


def compose_classic_caption(caption: Column, labels: Column, token: Column) -> Column:
    """A caption, `, with ` and the distinct labels."""
    named = F.array_distinct(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: trimmed(F.coalesce(x, F.lit("")))), lambda x: F.length(x) > 0))
    detail = F.array_join(named, ", ")

    def joined(base: Column) -> Column:
        return F.when(F.size(named) == 0, base).when(F.length(base) > 0, F.concat(base, F.lit(", with "), detail)).otherwise(detail)

    whole = bound(strip_boilerplate(caption), joined)
    return strip_boilerplate(bound(whole, lambda t: F.when(F.length(t) > 0, with_token(t, token)).otherwise(t)))


def first_string(json: Column) -> Column:
    """The first text in a model's answer in JSON, however deep, keys and empty texts aside; null if there is none."""
    token = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
    texts, keys = F.regexp_extract_all(json, token, F.lit(1)), F.regexp_extract_all(json, token, F.lit(2))
    values = F.filter(F.arrays_zip(texts.alias("text"), keys.alias("key")), lambda t: (F.length(t["key"]) == 0) & (F.length(t["text"]) > 0))
    return F.get_json_object(F.concat(F.lit('["'), F.get(values, F.lit(0))["text"], F.lit('"]')), "$[0]")


def initials(name: Column) -> Column:
    """Two capitals for a name: of its first two parts, or its first two letters; ?? if it has none."""
    parts = F.filter(F.split(F.translate(name, "- ", "__"), "_"), lambda p: F.length(p) > 0)
    return bound(
        parts,
        lambda ps: F.when(F.size(ps) >= 2, F.upper(F.concat(F.substring(ps[0], 1, 1), F.substring(ps[1], 1, 1)))).when(F.size(ps) == 1, F.upper(F.substring(ps[0], 1, 2))).otherwise("??"),
    )


def slug(name: Column) -> Column:
    """Lower case, blanks and hyphens as underscores, nothing but letters, digits and underscores."""
    return F.regexp_replace(F.translate(F.lower(trimmed(name)), "- ", "__"), r"[^\p{L}\p{N}_]", "")


def review_folder(stem: Column, path: Column) -> Column:
    """A name that is safe as a folder and differs by path: the stem's safe characters and 8 digits of the path's sha1."""
    safe = stripped_of(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), "._")
    return F.concat(F.when(F.length(safe) > 0, safe).otherwise("image"), F.lit("_"), F.left(F.sha1(path.cast("binary")), F.lit(8)))


def project_folder(name: Column) -> Column:
    """The folder of a project name, null for a name that isn't allowed."""
    clean = trimmed(F.coalesce(name, F.lit("")))
    return F.when(clean.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9_.-]*$"), F.replace(clean, F.lit("-"), F.lit("_")))


#: From where on the tenths of a number above 1 round up, with whether that very place does: halves that a double can be go to the even digit.
TENTHS = [((2 * i + 1) / 20, i % 2 == 1 if i in (2, 7) else Fraction((2 * i + 1) / 20) > Fraction(2 * i + 1, 20)) for i in range(10)]


def _one_decimal(x: Column) -> Column:
    """x with one decimal, rounded as it is in binary, and halves to the even digit; format_string rounds its decimal form, and halves up."""
    rest = x % 1.0
    tenths = sum((F.when(rest >= at if itself else rest > at, 1).otherwise(0) for at, itself in TENTHS), F.lit(0))
    exact = F.concat(F.format_string("%.0f", x - rest + F.when(tenths == 10, 1.0).otherwise(0.0)), F.lit("."), (tenths % 10).cast("string"))
    return F.when((x >= 1) & (x < 2.0**52), exact).otherwise(F.format_string("%.1f", x))


def human_bytes(size: Column, largest: str = "TB") -> Column:
    """12 KB, 3.4 MB and so on, up to the largest unit."""
    size = F.coalesce(size.cast("double"), F.lit(0.0))
    unit = F.when(size < 1024, F.format_string("%.0f B", F.rint(size))).when(size < 1024**2, F.format_string("%.0f KB", F.rint(size / 1024)))
    for power, name in ((2, "MB"), (3, "GB"), (4, "TB")):
        said = F.concat(_one_decimal(size / float(1024**power)), F.lit(f" {name}"))
        if name == largest:
            return unit.otherwise(said)
        unit = unit.when(size < float(1024 ** (power + 1)), said)
    raise ValueError(f"no unit {largest}")


def elapsed(seconds: Column) -> Column:
    """48s, or 10m 12s; nothing for null."""
    total = F.greatest(F.lit(0), seconds.cast("int"))
    minutes = F.floor(total / 60).cast("int")
    return F.when(seconds.isNull(), "").when(total < 60, F.concat(total.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm %02ds", minutes, (total % 60).cast("int")))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with its {placeholders} replaced; unknown braces stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def with_brief(prompt: Column, brief: Column) -> Column:
    """A prompt behind the project's domain brief, if it has one."""
    text = trimmed(F.coalesce(brief, F.lit("")))
    return F.when(F.length(text) > 0, F.concat(fill_template(F.lit(DOMAIN_BRIEF), {"domain_brief": text}), prompt)).otherwise(prompt)


def annotation_lines(labels: Column, places: Column) -> Column:
    """`  Region N (place): label` for each labelled region; N counts all of them."""
    zipped = F.arrays_zip(labels.alias("label"), places.alias("place"))
    lines = F.transform(zipped, lambda r, i: F.struct(trimmed(F.coalesce(r["label"], F.lit(""))).alias("label"), r["place"].alias("place"), (i + 1).alias("n")))
    kept = F.filter(lines, lambda r: F.length(r["label"]) > 0)
    return F.transform(kept, lambda r: F.concat(F.lit("  Region "), r["n"].cast("string"), F.lit(" ("), F.coalesce(r["place"], F.lit("")), F.lit("): "), r["label"]))


def point_label(name: Column, parent: Column, shared: Column, most: int = 24) -> Column:
    """A file's name, behind its folder's where several have it; of a long one the tail."""
    label = F.when(shared, F.concat(parent, F.lit("/"), name)).otherwise(name)
    return F.when(F.length(label) > most, F.concat(F.lit("…"), F.right(label, F.lit(most - 1)))).otherwise(label)


def annotations_suffice(labels: Sequence[str] | Column) -> Column:
    """Whether region labels can stand for an observation pass: two of them, or one of four content words."""
    named = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.length(trimmed(F.coalesce(x, F.lit("")))) > 0)
    return bound(named, lambda xs: (F.size(xs) >= 2) | ((F.size(xs) == 1) & (F.size(content_words(F.get(xs, F.lit(0)))) >= 4)))
