"""Conversation structure repair.

A conversation's roles should read `(s?(ua)+)?`, by their initials. A dynamic program over turns and grammar states gives the
least cost of what is still to come, backwards; a walk forwards then takes, among the edits that keep to that cost, the
ASCII-least one. Edits: Delete (3), Insert a user or assistant turn without text (2), Keep (0), Rerole (2); a truncated turn
that stays costs 1 more, blank and duplicate turns have to go.

Conversations are cut into chunks of turns, so that no task needs one whole. A chunk is a table of costs from each state to
each other for the walk backwards, and a map of states for the walk forwards. Both compose associatively: chunks are
composed level by level, many of a conversation at a time, and what comes to the top is handed down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import bounded, frozen, numbered

#: Turns of a chunk, and parts that one step of composition takes.
CHUNK, FAN = 4096, 256
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: The state after a kept turn by initial: the class of a turn (1 s, 2 u, 3 a, 0 other) is the state it leads to.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: What an inserted turn, or one that gets a new role, leads to.
FORCED = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults of a turn.
WHOLE, CUT_OFF, BLANK, DUPLICATE = range(4)
#: Cost of what is still to come after the last turn.
AT_END = [0, 2 * INSERT, INSERT, 0]


def _into(state: int, rest: list[int]) -> int:
    """The least cost from a state on before a turn, insertions first; rest: costs from each state on without insertions here."""
    cost = rest[state]
    for k in (1, 2):
        state = FORCED[state]
        cost = min(cost, k * INSERT + rest[state])
    return cost


def _turn(code: int, after: list[int]) -> list[int]:
    """The least cost from each state on, from the next turn's: the turn is kept, gets a role or goes."""
    kind, fault = code & 3, code >> 2
    out = []
    for state in range(4):
        cost = DELETE + after[state]
        if fault <= CUT_OFF:
            more = TRUNCATED if fault else 0
            cost = min(cost, REROLE + more + after[FORCED[state]])
            if kind in FOLLOWS[state]:
                cost = min(cost, more + after[kind])
        out.append(cost)
    return [_into(state, out) for state in range(4)]


def costs_before(codes: list[int], after: list[int]) -> list[list[int]]:
    """Backwards: the least cost from each state on, before each turn and, last, after them all (after)."""
    out = [after]
    for code in reversed(codes):
        out.append(_turn(code, out[-1]))
    return out[::-1]


def walk(codes: list[int], costs: list[list[int]], state: int, is_last: bool) -> tuple[str, int]:
    """Forwards from a state: the ASCII-least of the cheapest edits, and the state after them. Only the last chunk inserts after its last turn."""
    edits = []
    for i, code in enumerate(codes):
        kind, fault = code & 3, code >> 2
        more, after = (TRUNCATED if fault else 0), costs[i + 1]
        while True:
            cost = costs[i][state]
            if cost == DELETE + after[state]:
                edits.append("D")
                break
            forced = FORCED[state]
            # a turn inserted here comes before this turn: from the state after it on, the same costs hold
            if cost == INSERT + costs[i][forced]:
                edits.append("I")
                state = forced
                continue
            if fault <= CUT_OFF and kind in FOLLOWS[state] and cost == more + after[kind]:
                edits.append("K")
                state = kind
                break
            edits.append("R")
            state = forced
            break
    if is_last:
        while AT_END[state]:
            edits.append("I")
            state = FORCED[state]
    return "".join(edits), state


def chunk_costs(codes: list[int]) -> list[int]:
    """A chunk as a table, row by row: the least cost from each state before it to each state after it."""
    columns = [costs_before(codes, [0 if s == end else NEVER for s in range(4)])[0] for end in range(4)]
    return [min(NEVER, columns[end][start]) for start in range(4) for end in range(4)]


def compose_costs(a: list[int], b: list[int]) -> list[int]:
    """a, then b."""
    return [min(NEVER, min(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]


def apply_costs(table: list[int], after: list[int]) -> list[int]:
    """Costs before a chunk, from those after it."""
    return [min(table[4 * s + t] + after[t] for t in range(4)) for s in range(4)]


def compose_maps(a: list[int], b: list[int]) -> list[int]:
    """A map of states to states; a, then b."""
    return [b[s] for s in a]


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults: by the CRC-32 of `conv_id:turn` mod 20, 0 goes, 1 loses its text, 2 its full
    stops, exclamation and question marks, 3 comes twice, 4 has the role user. Nulls, in ids and turns too, read as one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(hit == 4, F.lit("user")).otherwise(said("role"))
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, n, role, text) with code: the class of the role's initial in two bits, then the first fault."""
    stripped = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    last = F.substring(F.rtrim(stripped), -1, 1)
    same = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    told = rows.select("conv_id", "turn", "n", "role", same.alias("same"), last.alias("last"))
    # only what a conversation says more than once is joined
    again = frozen(told.groupBy("same").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("n") > F.col("first"), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT_OFF).otherwise(WHOLE)
    kind = F.when(F.startswith("role", F.lit("s")), 1).when(F.startswith("role", F.lit("u")), 2).when(F.startswith("role", F.lit("a")), 3).otherwise(0)
    return told.join(bounded(again), "same", "left").select("conv_id", "turn", "n", (kind + 4 * fault).cast("int").alias("code"))


def _scan(parts: DataFrame, compose: Callable[[list[int], list[int]], list[int]], apply: Callable[[list[int], list[int]], list[int]], start: list[int]) -> DataFrame:
    """conv, place, got: what comes to each part of (conv, place, value), all parts of smaller place applied to start in turn.

    Up: FAN neighbours are composed into one part of the next level, until each conversation is one. Down: what comes to a part goes through
    its members one after the other. Each step is a groupBy with at most FAN members a group.
    """
    schema = "conv long, place long, value array<long>"

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column("members").to_pylist():
                value = members[0]["value"]
                for m in members[1:]:
                    value = compose(value, m["value"])
                out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), pa.array(out, pa.list_(pa.int64()))], names=["conv", "place", "value"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, members, got in zip(*(batch.column(c).to_pylist() for c in ("conv", "members", "got")), strict=True):
                for m in members:
                    rows.append((conv, m["place"], got))
                    got = apply(m["value"], got)
            convs, places, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(places, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["conv", "place", "got"])

    def grouped(level: DataFrame) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct("place", "value"))).alias("members")
        return level.groupBy("conv", F.floor(F.col("place") / FAN).alias("place")).agg(members)

    levels = [parts]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) > 0:
        levels.append(frozen(grouped(levels[-1]).mapInArrow(up, schema)))
    got = levels[-1].select("conv", "place", F.array(*[F.lit(x).cast("long") for x in start]).alias("got"))
    for level in reversed(levels[:-1]):
        got = frozen(grouped(level).join(got, ["conv", "place"]).mapInArrow(down, "conv long, place long, got array<long>"))
    return got


def _chunks(coded: DataFrame, chunk: int) -> DataFrame:
    """conv, place, n_chunks, codes: the turns of each conversation, chunk by chunk; conv is the number of its first turn."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("codes")
    return coded.groupBy("conv", F.floor((F.col("n") - F.col("conv")) / chunk).alias("place"), F.floor((F.col("size") - 1) / chunk).alias("last")).agg(codes)


def edits(coded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv, place, codes, cost (of all from this chunk on), audit of each chunk of turns (conv, n, size, code): conv is the number of the conversation's first turn, size its turns."""
    chunks = frozen(_chunks(coded, chunk))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [chunk_costs(codes) for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("last"), pa.array(values, pa.list_(pa.int64()))], names=["conv", "place", "value"])

    # backwards: places count from the end, and what comes before is composed on the other side
    backwards = chunks.filter("last > 0").select("conv", (F.col("last") - F.col("place")).alias("last"), "codes").mapInArrow(tables, "conv long, place long, value array<long>")
    after = _scan(frozen(backwards), lambda a, b: compose_costs(b, a), apply_costs, AT_END).withColumnRenamed("place", "back")
    ends = F.coalesce("got", F.array(*[F.lit(x).cast("long") for x in AT_END])).alias("after")
    known = chunks.withColumn("back", F.col("last") - F.col("place")).join(after, ["conv", "back"], "left").select("conv", "place", "last", "codes", ends)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, exits, costs = [], [], []
            for place, last, codes, end in zip(*(batch.column(c).to_pylist() for c in ("place", "last", "codes", "after")), strict=True):
                before = costs_before(codes, end)
                # only the first chunk's state is known beforehand
                found = [walk(codes, before, s, place == last) if place or not s else ("", 0) for s in range(4)]
                audits.append([f[0] for f in found])
                exits.append([f[1] for f in found])
                costs.append(before[0])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "place", "last", "codes")), pa.array(costs, longs), pa.array(exits, longs), pa.array(audits, pa.list_(pa.string()))], names=["conv", "place", "last", "codes", "costs", "exits", "audits"])

    walked = frozen(known.mapInArrow(walks, "conv long, place long, last long, codes array<int>, costs array<long>, exits array<long>, audits array<string>"))
    states = _scan(walked.filter("last > 0").select("conv", "place", F.col("exits").alias("value")), compose_maps, lambda m, s: [m[s[0]]], [START])
    state = F.coalesce(F.col("got")[0], F.lit(START)).cast("int")
    return walked.join(states, ["conv", "place"], "left").select("conv", "place", "codes", state.alias("state"), F.get("costs", state).alias("cost"), F.get("audits", state).alias("audit"))


CHANGES = "n long, before array<string>, stays boolean, role string, after array<string>"


def _changes(found: DataFrame, chunk: int) -> DataFrame:
    """CHANGES of each turn that isn't just kept: roles of the turns inserted before it, whether it stays, its new role, roles inserted after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for conv, place, codes, state, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "codes", "state", "audit")), strict=True):
                if "D" not in audit and "I" not in audit and "R" not in audit:
                    continue
                n, at, before = conv + place * chunk, 0, []
                for edit in audit:
                    if edit == "I":
                        state = FORCED[state]
                        before.append(NAMES[state])
                        continue
                    row = [n, before, edit != "D", None, []]
                    if edit == "K":
                        state = codes[at] & 3
                    elif edit == "R":
                        state = FORCED[state]
                        row[3] = NAMES[state]
                    if before or edit != "K":
                        out.append(row)
                    n, at, before = n + 1, at + 1, []
                if before:
                    # turns inserted after the last one
                    if not out or out[-1][0] != n - 1:
                        out.append([n - 1, [], True, None, []])
                    out[-1][4] = before
            columns = list(zip(*out, strict=True)) if out else [(), (), (), (), ()]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CHANGES.split(", ")])

    return found.select("conv", "place", "codes", "state", "audit").mapInArrow(run, CHANGES)


def repaired(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """conv_id, n, segment of each turn of rows (conv_id, n, role, text) that leaves something: `role:text` lines, inserted turns before and after it."""
    named = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda r: F.concat(r, F.lit(":")))
    both = rows.join(bounded(changes), "n", "left")
    own = F.when(F.coalesce("stays", F.lit(True)), F.array(F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(named(F.col("before")), own, named(F.col("after")))
    return both.select("conv_id", "n", lines.alias("lines")).filter(F.size("lines") > 0).select("conv_id", "n", F.array_join("lines", "\n").alias("segment"))


def _digests(segments: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the segments in order. SHA-256 takes them one after the other: a conversation is one task's work, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].hexdigest() for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])
        now: list | None = None
        for batch in batches:
            done = []
            for conv_id, segment in zip(batch.column("conv_id"), batch.column("segment"), strict=True):
                conv_id, segment = conv_id.as_py(), segment.as_py().encode()
                if now is None or now[0] != conv_id:
                    if now is not None:
                        done.append(now)
                    now = [conv_id, hashlib.sha256(segment)]
                else:
                    now[1].update(b"\n" + segment)
            if done:
                yield table(done)
        if now is not None:
            yield table([now])

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "n").select("conv_id", "segment").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _illegal(coded: DataFrame) -> DataFrame:
    """conv, illegal: neighbours that are neither system and user nor user and assistant, in either order. Each turn meets the one before it by number."""
    legal = [(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)]
    pair = lambda a, b: (F.col("kind") == a) & (F.col("kind_before") == b)
    bad = ~(pair(legal[0][1], legal[0][0]) | pair(legal[1][1], legal[1][0]) | pair(legal[2][1], legal[2][0]))
    kinds = coded.select("conv", "n", F.col("code").bitwiseAND(3).alias("kind"))
    before = kinds.select("conv", (F.col("n") + 1).alias("n"), F.col("kind").alias("kind_before"))
    return kinds.join(before, ["conv", "n"]).filter(bad).groupBy("conv").agg(F.count(F.lit(1)).alias("illegal"))


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """What rows (conv_id, turn, role, text) lack, and the conversations as they should be.

    First, for each conv_id of rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Second, conv_id, n, segment of
    the repaired conversations. Turns count by turn, nulls first, then role, then text; rows that repeat are turns of their own, the second of them
    a duplicate. Null roles and texts are one blank. Null ids are one conversation. Roles count by their first letter. An
    empty table gives empty results; other columns are ignored. No step needs a conversation in one task but its SHA-256.
    """
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    placed = numbered(said, [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")], "n")
    coded = frozen(_faults(placed))
    fault = F.shiftright("code", 2)
    turns = coded.groupBy("conv_id", "turn").agg(F.min("n").alias("conv"), F.count(F.lit(1)).alias("size"), *[F.sum((fault == k).cast("long")).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT_OFF, "truncated"))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    convs = frozen(turns.groupBy("conv_id").agg(F.min("conv").alias("conv"), F.sum("size").alias("size"), gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]))
    tagged = frozen(coded.join(bounded(convs.select(F.col("conv_id").alias("id"), "conv", "size")), F.col("conv_id").eqNullSafe(F.col("id"))).select("conv", "size", "n", "code"))
    found = frozen(edits(tagged, chunk))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "").alias("audit")
    audits = found.groupBy("conv").agg(F.max(F.when(F.col("place") == 0, F.col("cost"))).alias("cost"), pieces)
    segments = repaired(placed.select("conv_id", "n", "role", "text"), frozen(_changes(found, chunk).withColumnRenamed("role", "new_role")))
    digests = _digests(segments)
    told = convs.join(audits, "conv", "left").join(_illegal(tagged), "conv", "left").alias("told").join(digests.alias("digests"), F.col("told.conv_id").eqNullSafe(F.col("digests.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = told.select("told.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return report, segments


def with_lost(report: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """report, with a row for each conv_id of conv_ids that has no turn left: zeros, an empty audit, the digest of nothing."""
    ids = conv_ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    both = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select(F.col("id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
