"""Token alignment, line deduplication and conversation repair against plain versions in Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framesift.llm import line_dedup, structure_repair, token_alignment

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- token alignment


def plain_groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    """Whole texts through both libraries, cut where offsets agree."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    if not text:
        return []
    letters = token_alignment._byte_of_letter()
    a = [(i, bytes(letters[c] for c in a_side.id_to_token(i))) for i in a_side.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i in b_side.encode(text) for p in [b_side.id_to_piece(i)]]
    want = f" {text}".encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = []
    for side in (a, b):
        total, own = 0, []
        for _, said in side:
            total += len(said)
            own.append(total)
        ends.append(own)
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, i, j = [], 0, 0
    for end in both:
        left, right = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append(([x for x, _ in a[i:left]], [x for x, _ in b[j:right]]))
        i, j = left, right
    return groups


def plain_alignment(docs: list[tuple[int, str | None]]) -> list[tuple]:
    groups = [plain_groups(text) for _, text in docs]
    links = [Counter(pair for a, b in g for pair in product(a, b)) for g in groups]
    counts = Counter(pair for own in links for pair in own)
    highest: dict[int, int] = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc, _), g, own in zip(docs, groups, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for pair, n in own.items() if counts[pair] == highest[pair[0]])
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * counts[pair] for pair, n in own.items()), sha(said) if g else ""))
    return out


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "x\ny z", "don't we'll", "</s> <s> <|endoftext|> [INST]", "日本語 のテキスト です", "naïve  café ümlaut", "a▁b c", "c a▁", "▁", "😀 😀😀", "\x00 \x1f a", "tab\tand  more   blanks    here", "1234567890 12 ab12", "ab cd 　 e", "é e", "the the the The", "aaaa" * 40, "$$$ *** ???", "'s 's", "x 's y"]


@pytest.mark.parametrize("rows", [0, 10, 1_000_000])
def test_alignment_equals_plain_version(spark, rows):
    rng = random.Random(7)
    letters = ["a", "b", "the", "ing", "Ü", "é", "日", "😀", " ", "  ", "\n", "\t", "'s", ".", "12", " ", "\x1d", "#"]
    docs = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))) for i in range(60)] + [(3, "the the the The"), (None, "a  b")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, pair int")
    got = token_alignment.token_alignment(df, BYTE_LEVEL, PIECES, broadcast_rows=rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_alignment(docs), key=repr)


def test_alignment_of_an_empty_table_and_with_small_caches(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.token_alignment(empty, BYTE_LEVEL, PIECES).collect() == []
    for name, value in (("KEPT", 20), ("KEPT_STEPS", 10), ("RUN", 8), ("KEPT_PAIRS", 2)):
        monkeypatch.setattr(token_alignment, name, value)
    machine = token_alignment.Aligner(BYTE_LEVEL, PIECES)
    for _ in range(2):
        for text in ODD:
            counts, digests, _, _ = machine.align([text, "the end"])
            groups = plain_groups(text)
            assert counts[0, 2] == len(groups)
            assert digests[0] == (sha(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)) if groups else "")


def test_transducer_finds_differing_bytes():
    machine = token_alignment.DanglingSuffix([b"ab", b"c", b"abc"], [b"a", b"bc", b"x", b"abc"])
    assert machine.groups([0, 1], [0, 1]) == ([2], [2])
    assert machine.groups([2, 2], [3, 0, 1]) == ([1, 2], [1, 3])
    assert machine.groups([0, 1], [0, 2]) is None
    assert machine.groups([0], [0]) is None
    assert machine.groups([0], [0, 1]) is None
    assert machine.groups([2], [3, 0]) is None


# --- line deduplication


def plain_lines(docs: list[tuple[int | None, str | None]], least_chars: int, least_docs: int) -> list[tuple]:
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    cut = [(doc, (text or "").split("\n")) for doc, text in docs]
    holders = defaultdict(list)
    for doc, lines in cut:
        for k in {key(line) for line in lines}:
            holders[k].append(doc)
    low = lambda doc: (doc is not None, doc or 0)
    lost = {k: max(own, key=low) for k, own in holders.items() if len(k) >= least_chars and len(own) >= least_docs}
    out = []
    for doc, lines in cut:
        kept = [line for line in lines if key(line) not in lost or lost[key(line)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("batches", "fanout", "bound"), [(1, 2, 500_000), (5, 2, 500_000), (7, 3, 0)])
def test_line_dedup_equals_plain_version(spark, monkeypatch, batches, fanout, bound):
    monkeypatch.setattr("framesift.llm.common.BROADCAST_ROWS", bound)
    rng = random.Random(batches)
    pool = ["", "x", "Common LINE of words", " common line of words\t", "ÄÖ Common line of words", "ÄÖ common line of words", "äö common line of words", "a line that is long enough " + "y" * 30, "\x0b\x0crare line number\r"] + [f"line {i} of some length" for i in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    docs += [(None, pool[2]), (None, f"{pool[2]}\n{pool[2]}"), (200, None), (201, ""), (202, "\n"), (7, pool[2]), (7, f"{pool[3]}\nz"), (300, "\n".join(["Only here, many times over"] * 9)), (301, f"{pool[2]}\n{pool[2]}")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, key string, row long").repartition(3)
    got = line_dedup.deduplicated_lines(df, least_chars=10, least_docs=3, batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_lines(docs, 10, 3), key=repr)
    assert spark.sql("SHOW TABLES").filter("tableName LIKE 'line_runs%'").count() == 0


def test_line_dedup_of_an_empty_table_and_of_null_ids(spark):
    schema = "doc_id long, text string"
    assert line_dedup.deduplicated_lines(spark.createDataFrame([], schema)).collect() == []
    line = "a line of more than forty characters, said again and again"
    got = line_dedup.deduplicated_lines(spark.createDataFrame([(None, line)] * 6, schema)).collect()
    assert [tuple(r) for r in got] == [(None, 1, 0, line)] * 6


def test_runs_are_levelled(spark):
    """Nine batches in runs of three leave one run; only new lines name their keeper."""
    with line_dedup.line_runs(spark, 3) as runs:
        for i in range(9, 0, -1):
            runs.add(spark.createDataFrame([(i, f"the line of all of them\nthe line of number {i}")], "doc long, text string"), 10)
            assert all(len(level) < 3 for level in runs.levels)
        assert [len(level) for level in runs.levels] == [0, 0, 1]
        held = sorted((r["n"], r["keeper"]) for r in spark.table(runs.runs()[0]).collect())
        assert held == [(1, i) for i in range(1, 10)] + [(9, 9)]
        # bucketed alike: a run meets another without a shuffle
        runs.add(spark.createDataFrame([(0, "one more line of text")], "doc long, text string"), 10)
        a, b = map(spark.table, runs.runs())
        for plan in (runs.fresh_entries(a), line_dedup._merge(a, b)):
            assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


# --- conversation repair


def plain_repair(turns: list[tuple[str, str]]) -> tuple[int, str, str]:
    """The best of all edits by cost, then audit, over turns (role, text) in order: forwards, the best for each state."""
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    forced = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    best = {0: (0, "", ())}

    def insert() -> None:
        for _ in range(3):
            for s, (cost, audit, said) in list(best.items()):
                to = forced[s]
                way = (cost + 2, audit + "I", (*said, f"{names[to]}:"))
                if to not in best or way < best[to]:
                    best[to] = way

    seen = set()
    for role, text in turns:
        insert()
        stripped = text.strip(" \t\n\x0b\x0c\r")
        must_go = not stripped or (role, text) in seen
        more = 0 if must_go or stripped[-1] in ".!?" else 1
        seen.add((role, text))
        now: dict[int, tuple] = {}
        for s, (cost, audit, said) in best.items():
            ways = [(s, (cost + 3, audit + "D", said))]
            if not must_go:
                ways.append((forced[s], (cost + 2 + more, audit + "R", (*said, f"{names[forced[s]]}:{text}"))))
                if role[:1] in follows[s]:
                    ways.append((follows[s][role[:1]], (cost + more, audit + "K", (*said, f"{role}:{text}"))))
            for to, way in ways:
                if to not in now or way < now[to]:
                    now[to] = way
        best = now
    insert()
    cost, audit, said = min(best[s] for s in (0, 3) if s in best)
    return cost, audit, "\n".join(said)


def plain_report(rows: list[tuple]) -> dict:
    by: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        blank = duplicate = truncated = illegal = 0
        seen, last = set(), None
        for _, role, text in turns:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            if not stripped:
                blank += 1
            elif (role, text) in seen:
                duplicate += 1
            elif stripped[-1] not in ".!?":
                truncated += 1
            seen.add((role, text))
            illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
            last = role[:1]
        places = {t for t, _, _ in turns if t is not None}
        gaps = max(places) - min(places) + 1 - len(places) if places else 0
        cost, audit, said = plain_repair([t[1:] for t in turns])
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, sha(said))
    return out


def chats(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for i in range(rng.randint(1, 30) if conv != 3 else 200):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \t", None, "cut off", "Whole.", "Well! ", "so?\x0b", "ünd weiter", f"Turn {i}.", f"turn {i}"])
            rows.append((conv, rng.choice([i, i, i, i + 1, None]), role, text))
    return rows


@pytest.mark.parametrize(("chunk", "fan", "bound"), [(4096, 256, 500_000), (3, 2, 0)])
def test_repair_equals_plain_version(spark, monkeypatch, chunk, fan, bound):
    monkeypatch.setattr("framesift.llm.common.BROADCAST_ROWS", bound)
    monkeypatch.setattr(structure_repair, "FAN", fan)
    rows = chats(chunk, 40)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    report, _ = structure_repair.repair(df, chunk)
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    assert got == plain_report(rows)


def test_damage_and_lost_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", "One. Two! Three?") for c in range(40) for t in (0, 1, None)]
    crc = lambda c, t: zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
    want = []
    for c, t, role, text in rows:
        hit = crc(c, t)
        if hit:
            want += [(c, t, role, {1: "", 2: "One Two Three"}.get(hit, text))] * (2 if hit == 3 else 1)
    df = spark.createDataFrame(rows, schema)
    damaged = structure_repair.damage(df)
    assert sorted(map(tuple, damaged.collect()), key=repr) == sorted(want, key=repr)
    report, _ = structure_repair.repair(damaged.filter("conv_id <> 5"))
    whole = {r["conv_id"]: tuple(r)[1:] for r in structure_repair.with_lost(report, df).collect()}
    assert set(whole) == set(range(40))
    assert whole[5] == (0, 0, 0, 0, 0, 0, "", sha(""))
    empty, segments = structure_repair.repair(spark.createDataFrame([], schema))
    assert empty.collect() == [] and segments.collect() == []


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["", "a", "b", "A.", "B.", "C!"])), max_size=9), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_walk_is_the_least_of_the_cheapest(turns, chunk):
    """Chunks of any size, composed, give the plain version's edits."""
    codes, seen = [], set()
    for role, text in turns:
        fault = structure_repair.BLANK if not text else structure_repair.DUPLICATE if (role, text) in seen else structure_repair.WHOLE if text[-1] in ".!?" else structure_repair.CUT_OFF
        seen.add((role, text))
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[0], 0) + 4 * fault)
    parts = [codes[i : i + chunk] for i in range(0, len(codes), chunk)] or [[]]
    afters = [structure_repair.AT_END]
    for part in reversed(parts[1:]):
        afters.append(structure_repair.apply_costs(structure_repair.chunk_costs(part), afters[-1]))
    state, audit, cost = 0, "", None
    for i, (part, after) in enumerate(zip(parts, afters[::-1], strict=True)):
        before = structure_repair.costs_before(part, after)
        cost = before[0][0] if i == 0 else cost
        edits, state = structure_repair.walk(part, before, state, i == len(parts) - 1)
        audit += edits
    want = plain_repair(turns)
    assert (cost, audit) == want[:2]


# --- WARC beyond the broadcast bound


@pytest.mark.parametrize(("bound", "share"), [(500_000, 5_000), (0, 5_000), (0, 2)])
def test_revisits_of_a_hot_payload(spark, tmp_path, monkeypatch, bound, share):
    """One payload in a third of the pages; html meets nothing by its digest, whatever is broadcast."""
    from framesift.llm import warc

    monkeypatch.setattr("framesift.llm.common.BROADCAST_ROWS", bound)
    monkeypatch.setattr(warc, "HEAVY_SHARE", share)
    page = lambda i: "hot " * 60 if i % 3 == 0 else f"{i // 6} twice " * 20 if i % 3 == 1 else "short" if i % 2 else f"own {i} " * 40
    pages = [(i if i != 30 else None, f"http://{i}", page(i)) for i in range(90)] + [(6, "again", page(6))]
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3).write.parquet(str(tmp_path / "pages"))
    rows = warc.with_record_types(spark.read.parquet(str(tmp_path / "pages")))
    first: dict[str, int] = {}
    for i, _, html in pages:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    want = [(i, url, first[html] if i is not None and len(html) >= 100 and first[html] != i else None) for i, url, html in pages]
    assert sorted(((r.id, r.url, r.refers_to) for r in rows.collect()), key=repr) == sorted(want, key=repr)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "digest" not in plan.split("Join", 1)[-1].split("\n")[0]
