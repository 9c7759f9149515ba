"""Chat formatting from event logs.

A log holds a conversation's events by sequence number: whole messages, streamed deltas, edits and regenerations.
The events of a message fold into its final text; the messages of a conversation, by the place of their first
event, are rendered one segment each. Segments are rendered and parsed on their own, so a long conversation is spread
over tasks like any other rows, and no task holds more than one message in memory; joined in order they are its
formatted text. Only the digests of a conversation, which SHA-256 has to take in order, are one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: First characters and rests of the control strings of this and other common templates. A text that has one gets a
#: backslash after its first character (one more, if it has some already); reading takes one away again.
FIRST, REST = r"[<\[]", r"\|(?:turn|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE = rf"({FIRST})(\\*)({REST})"
UNESCAPE = rf"({FIRST})(\\*)\\({REST})"
#: A segment: role, text. The end of a text is the first control string that isn't escaped.
SEGMENT = r"(?s)\A<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n\z"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def escaped_role(role: Column) -> Column:
    """A role is a line of its own: backslashes and line feeds are written as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def unescaped_role(role: Column) -> Column:
    """Backwards: two backslashes are one, one and an n a line feed."""
    halves = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\n"), F.lit("\n"))), "\\")


def as_events(messages: DataFrame) -> DataFrame:
    """An event log (conv_id, message_id, seq, kind, role, text) that folds into the messages (conv_id, seq, role, text).

    By a hash of its place, a message comes whole, in streamed deltas, as a draft that is edited after the next message
    has begun, or as a draft that is generated again. Each row is a message of its own; null texts are empty, null places
    -1. The places of the log are 16 times those of the messages. An empty table gives no event, other columns are ignored.
    """
    rows = messages.select("conv_id", F.monotonically_increasing_id().alias("message_id"), (F.coalesce("seq", F.lit(-1)) * 16).alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    parts = [F.substring(F.col("text"), F.lit(1), third), F.substring(F.col("text"), third + 1, third), F.substring(F.col("text"), third * 2 + 1, F.length("text"))]
    draft = F.concat(F.reverse(parts[0]), F.lit("</s> draft"))
    event = lambda at, kind, text: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), text.alias("text"))
    deltas = lambda at: [event(at + i, "delta", x) for i, x in enumerate(parts)]
    none = F.lit(None).cast("string")
    history = F.pmod(F.xxhash64("conv_id", "seq", "text"), F.lit(4))
    log = (
        F.when(history == 0, F.array(event(0, "message", F.col("text"))))
        .when(history == 1, F.array(*deltas(0)))
        .when(history == 2, F.array(event(0, "message", draft), event(20, "edit", F.col("text"))))
        .otherwise(F.array(event(0, "delta", draft), event(1, "regenerate", none), *deltas(2)))
    )
    each = rows.withColumn("event", F.explode(log))
    return each.select("conv_id", "message_id", (F.col("seq") + F.col("event.at")).alias("seq"), "event.kind", F.when(F.col("event.at") == 0, F.col("role")).alias("role"), "event.text")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of each final message; events has conv_id, message_id, seq, kind, role, text.

    kind `message` and `delta` add their text to the message; `edit` replaces all before it by its own text;
    `regenerate` drops all before it, and its own text, if any, comes first. Other kinds add nothing. A message is
    placed by its first event and has the first role an event gives; null texts are empty. Events of one message
    with equal seq are taken by kind, then text. A log without events gives no message; other columns are ignored.
    """
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.struct("seq", "kind", "text")))
    pieces = F.array_sort(F.collect_list(F.when(F.col("kind").isin("message", "delta", "edit", "regenerate"), F.struct("seq", "kind", "text"))))
    folded = events.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        reset.alias("reset"),
        pieces.alias("pieces"),
    )
    live = F.filter("pieces", lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    return folded.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, part, segment, loss_start, loss_end: a segment for each message of (conv_id, seq, role, text).

    A conversation's formatted text is its segments by part (the message's seq), those of equal part by role, then text.
    loss_start and loss_end are code points within the segment, null where nothing is under the loss mask. Null
    conversation ids make one conversation; null roles and texts are empty. An empty table gives no segment, other
    columns are ignored. Nothing is shuffled.
    """
    head = F.concat(F.lit(TURN), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    trained = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    return (
        messages.select("conv_id", F.col("seq").alias("part"), head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), trained.alias("trained"))
        .withColumn("segment", F.concat("head", "body", F.lit(f"{END}\n")))
        .select("conv_id", "part", "segment", F.when(F.col("trained"), F.length("head")).alias("loss_start"), F.when(F.col("trained"), F.length("head") + F.length("body")).alias("loss_end"))
    )


def parsed(segments: DataFrame) -> DataFrame:
    """conv_id, part, role, text, chars, masked of segments: what each says when it is read, its length, and the unescaped text under its loss mask."""
    found = lambda group: F.regexp_extract("segment", SEGMENT, group)
    masked = unescaped(F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    return segments.select("conv_id", "part", unescaped_role(found(1)).alias("role"), unescaped(found(2)).alias("text"), F.length("segment").alias("chars"), masked.alias("masked"))


class _Reading:
    """What is known of a conversation after some of its segments."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, chars: int, masked: str | None) -> None:
        self.turns += 1
        self.chars += chars
        self.turn_digest.update(f"{role}\n{text}\n".encode())
        if masked is not None:
            self.loss += len(masked)
            self.loss_digest.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turn_digest.hexdigest(), self.loss, self.loss_digest.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from its segments and loss spans alone: what the formatted text says when it is parsed.

    Segments are parsed where they are; what they say is sorted within each conversation and goes to its digests. Null
    conversation ids are one conversation; no segment gives no row.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for batch in batches:
            done = []
            for conv, same, *said, masked in zip(*(batch.column(c) for c in ("conv_id", "same", "role", "text", "chars", "masked")), strict=True):
                conv_id = conv.as_py()
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(conv_id)
                role, text, chars = (x.as_py() for x in said)
                now.add(role, text, chars, text if same.as_py() else masked.as_py())
            if done:
                yield table(done)
        if now is not None:
            yield table([now.row()])

    # masked text that is the whole text isn't moved twice
    same = F.coalesce(F.col("masked") == F.col("text"), F.lit(False))
    said = parsed(segments).withColumn("same", same).withColumn("masked", F.when(~F.col("same"), F.col("masked")))
    ordered = said.repartition("conv_id").sortWithinPartitions("conv_id", "part", "role", "text")
    return ordered.mapInArrow(read, DIGEST)
