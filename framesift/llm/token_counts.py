"""Token counts by a compiled tokenizer.

A byte-level BPE file is compiled into two deterministic transducers, one after the other. The first cuts a text into
pieces; it looks at the classes of neighbouring characters only. The second reads a piece byte by byte, and each of its
transitions says how many tokens it adds to the count. It is built state by state as texts ask for it: a state is the
longest end of what was read that some token begins with, with the last token and the count at each place in it. That
is all that what follows can depend on. Short pieces that aren't known yet are read many at a time: each step reads one
byte of all of them by array operations, with the last tokens and counts as columns, and no state is kept.

Where the class of characters changes, the first transducer is mostly in one known state whatever came before. So a
chunk of a text is a map of states: what stands before its first such place goes to whatever state comes in, then
follows a fixed count, and a fixed state goes out, named by what stands after the last such place. Such maps compose
associatively. The chunks of long texts are rows of their own, mapped in parallel and composed two by two, level by
level, as in a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import frozen

#: Characters of a chunk, pieces whose counts and transducer states that a worker keeps.
CHUNK, KEPT, KEPT_STATES = 1 << 16, 200_000, 100_000
#: Pieces of more bytes are counted by the transducer one by one, each time; their counts aren't kept.
KEPT_BYTES = 64
#: Characters of texts whose new pieces wait for each other, bytes that are read together, pieces that aren't worth arrays.
WAITING, TOGETHER, FEW = 1 << 21, 1 << 18, 300
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
BYTES = 256
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def _byte_of_letter() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means: itself where it prints, else the next free code point from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {chr(b) if b in prints else chr(next(free)): b for b in range(BYTES)}


class Lookup:
    """Numbers by numbers, looked up by array operations; what isn't there is -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        # a last key beyond all others, so that each search ends at one
        self.keys, self.values = np.append(keys[order], 1 << 62), np.append(values[order], -1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class State:
    """A state of the merge transducer. end: the longest end of what was read that some token begins with; lasts, counts: the last token, and the count
    from the start of end on, at each place in it; next: transitions known so far, by byte, with the tokens they add."""

    __slots__ = ("end", "lasts", "counts", "next")

    def __init__(self, end: bytes, lasts: tuple[int | None, ...], counts: tuple[int, ...]) -> None:
        self.end, self.lasts, self.counts = end, lasts, counts
        self.next: dict[int, tuple[State, int]] = {}


class MergeTransducer:
    """Counts the tokens of a piece as merges in order of rank make them.

    Tokens are numbered by rank, single bytes first. A sequence of tokens is what the merges make of its bytes if
    each two neighbours are, so a prefix has one last token: the one that goes with the last token before it.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(BYTES)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(BYTES)]
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            if left + right in self.ids:
                raise ValueError("several merges make one token")
            both = self.ids[left], self.ids[right]
            self.pairs[both] = self.ids[left + right] = len(self.halves)
            self.halves.append(both)
        self.prefixes = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        self.reached: dict[int, bool] = {}
        #: Tokens that end where a prefix does, with their sizes; as many as there are prefixes at most.
        self.ending: dict[bytes, list[tuple[int, int]]] = {}
        self.clear()

    def clear(self) -> None:
        self.start = State(b"", (None,), (0,))
        self.states: dict[tuple, State] = {}
        self.beside: dict[int, bool] = {}

    def neighbours(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether merges leave a before b: none over the seam, of rank below limit, comes before those that make a and b."""
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if max(a, b) < BYTES:
                return True
            # undo the later one; of one merge the left is done first
            if a > b:
                limit, a = a, self.halves[a][1]
            else:
                limit, b = b + 1, self.halves[b][0]

    def made(self, token: int) -> bool:
        """Whether merges make the token of its own bytes."""
        if token < BYTES:
            return True
        if token not in self.reached:
            left, right = self.halves[token]
            self.reached[token] = self.made(left) and self.made(right) and self.neighbours(left, right, token)
        return self.reached[token]

    def _step(self, state: State, byte: int) -> tuple[State, int]:
        read, lasts, counts = state.end + bytes((byte,)), state.lasts, state.counts
        prefixes, ids, beside = self.prefixes, self.ids, self.beside
        begin = 0
        while (end := read[begin:] if begin else read) not in prefixes:
            begin += 1
        if (ending := self.ending.get(end)) is None:
            tokens = ((size, ids.get(end[-size:])) for size in range(len(end), 0, -1))
            ending = self.ending[end] = [(size, token) for size, token in tokens if token is not None and self.made(token)]
        # of the tokens that end here, the longest first, the one that goes with the token before it
        n = len(read)
        for size, token in ending:
            k = n - size
            last = lasts[k]
            if last is None:
                break
            if (fits := beside.get(both := last << 32 | token)) is None:
                fits = beside[both] = self.neighbours(last, token)
            if fits:
                break
        count = counts[k] + 1
        added = count - counts[-1]
        if begin:
            base = counts[begin]
            key = end, (*lasts[begin:], token), tuple([c - base for c in counts[begin:]] + [count - base])
        else:
            key = end, (*lasts, token), (*counts, count)
        if (to := self.states.get(key)) is None:
            to = self.states[key] = State(*key)
        return to, added

    def count(self, piece: bytes) -> int:
        token = self.ids.get(piece)
        if token is not None and self.made(token):
            return 1
        if max(len(self.states), len(self.beside) // 4) > KEPT_STATES:
            self.clear()
        state, total = self.start, 0
        for byte in piece:
            found = state.next.get(byte)
            if found is None:
                found = state.next[byte] = self._step(state, byte)
            state, added = found
            total += added
        return total

    @cached_property
    def arrays(self) -> tuple[Lookup, np.ndarray, Lookup, np.ndarray]:
        """Edges from a prefix by a byte, the token that a prefix is, if merges make it, the rank of a pair, the halves of a token."""
        number = {p: i for i, p in enumerate(sorted(self.prefixes), 1)}
        edges = np.fromiter((number.get(p[:-1], 0) * BYTES + p[-1] for p in number), np.int64, len(number))
        tokens = np.full(len(number) + 1, -1, np.int32)
        for raw, token in self.ids.items():
            if self.made(token):
                tokens[number[raw]] = token
        pairs = np.fromiter((a * len(self.halves) + b for a, b in self.pairs), np.int64, len(self.pairs))
        ranks = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        return Lookup(edges, np.arange(1, len(number) + 1)), tokens, Lookup(pairs, ranks), np.array(self.halves, np.int64)

    def _all_neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """neighbours() of many pairs."""
        _, _, ranks, halves = self.arrays
        fits, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 60)
        while len(at):
            rank = ranks.get(a * len(halves) + b)
            over = (rank >= 0) & (rank < limit)
            fits[at[over]] = False
            on = ~over & (np.maximum(a, b) >= BYTES)
            at, a, b = at[on], a[on], b[on]
            later = a > b
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, halves[a, 1], a), np.where(later, b, halves[b, 0])
        return fits

    def counts(self, pieces: list[bytes]) -> list[int]:
        """count() of many pieces. Short ones are read together, from the longest to the shortest."""
        out = [0] * len(pieces)
        short = sorted((i for i, p in enumerate(pieces) if len(p) <= KEPT_BYTES), key=lambda i: -len(pieces[i])) if len(pieces) > FEW else []
        ends = np.cumsum([len(pieces[i]) for i in short])
        begin = 0
        while begin < len(short):
            end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOGETHER, "right"))
            for i, n in zip(short[begin:end], self._read_together([pieces[i] for i in short[begin:end]]), strict=True):
                out[i] = n
            begin = end
        for i, n in enumerate(out):
            # each piece has a token at least
            if not n:
                out[i] = self.count(pieces[i])
        return out

    def _read_together(self, pieces: list[bytes]) -> list[int]:
        """Counts of pieces from the longest to the shortest. Their bytes lie one column after the other, so that a column has the first so many pieces."""
        edges, token_of, _, _ = self.arrays
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        width = int(sizes[0])
        rows = [int(x) for x in np.searchsorted(-sizes, -np.arange(width), "left")]
        starts = np.concatenate([[0], np.cumsum(rows)])
        read = np.concatenate([joined[begins[:n] + j] for j, n in enumerate(rows)])
        # tokens by their size and the place that they end at: from all places at once, as far as prefixes go
        place = np.arange(len(read))
        column = np.repeat(np.arange(width), rows)
        row = place - starts[column]
        heights = np.array([*rows, 0])
        prefix = np.zeros(len(read), np.int64)
        endings: list[np.ndarray] = []
        while len(row):
            prefix = edges.get(prefix * BYTES + read[place])
            on = prefix > 0
            row, column, place, prefix = row[on], column[on], place[on], prefix[on].astype(np.int64)
            endings.append(ends := np.full(len(read), -1, np.int32))
            ends[place] = token_of[prefix]
            column = column + 1
            on = row < heights[column]
            row, column, prefix = row[on], column[on], prefix[on]
            place = starts[column] + row
        last, count = np.empty(len(read), np.int64), np.empty(len(read), np.int64)
        for j, n in enumerate(rows):
            here = slice(int(starts[j]), int(starts[j + 1]))
            lasts, counts = last[here], count[here]
            rest = np.arange(n)
            # of the tokens that end here, the longest first, the one that goes with the token before it
            for size in range(min(j + 1, len(endings)), 0, -1):
                token = endings[size - 1][here][rest]
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                at, token = rest[some], token[some].astype(np.int64)
                if size == j + 1:
                    lasts[at], counts[at] = token, 1
                else:
                    before = starts[j - size] + at
                    fits = self._all_neighbours(last[before], token) if size > 1 else np.ones(len(at), bool)
                    at, some = at[fits], some[fits]
                    lasts[at], counts[at] = token[fits], count[before[fits]] + 1
                rest = np.delete(rest, some)
                if not len(rest):
                    break
        return count[starts[sizes - 1] + np.arange(len(pieces))].tolist()


class StateMap(NamedTuple):
    """What a stretch of text does to the state before it: head goes on from there, count tokens follow, tail names the state after it.
    Without a place where the state is known, all is head, and the state after it is the one before it with the head read."""

    head: str
    count: int
    tail: str
    known: bool


class CompiledTokenizer:
    """Counts tokens as the library does for a byte-level BPE file without normaliser, prefix space or dropout."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or odd or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        letters = _byte_of_letter()
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = MergeTransducer([(raw(a), raw(b)) for a, b in merges])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.emits: dict[str, int] = {}
        self.classes = _classes()

    def _typed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return points, self.classes[points]

    def starts(self, text: str) -> np.ndarray:
        """Where pieces of a text begin. Each place depends on the class of its neighbours, three characters at most."""
        points, kind = self._typed(text)
        n = len(points)
        is_space = kind == SPACE
        start = np.empty(n, bool)
        start[0] = True
        # a change of class begins a piece, but for a blank that belongs to what follows it
        start[1:] = kind[1:] != kind[:-1]
        start[1:] &= ~((points[:-1] == 32) & ~is_space[1:])
        # the last of white space before anything else stands by itself or goes with it
        start[:-1] |= is_space[:-1] & ~is_space[1:]
        # 's 't 'm 'd 're 've 'll where an apostrophe begins a piece
        marks = np.flatnonzero(points == 39)
        if len(marks):
            pad = np.concatenate([points, np.zeros(2, np.uint32)])
            one, two = pad[marks + 1], pad[marks + 2]
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            first = start[marks] & (short | long)
            ends = (marks + np.where(short, 2, 3))[first]
            start[marks[first] + 1] = False
            start[ends[ends < n]] = True
        return np.flatnonzero(start)

    def count(self, text: str) -> int:
        """Tokens of a text that is whole, or stands between places where the state is known."""
        return self.counts([text])[0]

    def counts(self, texts: Iterable[str]) -> list[int]:
        """count() of many texts. New pieces wait for others, to be read together."""
        totals: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for text in texts:
            at = self.starts(text).tolist() if text else []
            pieces = [text[a:b] for a, b in zip(at, at[1:] + [len(text)], strict=False)]
            found = list(map(self.emits.get, pieces))
            if None in found:
                waiting.append((len(totals), [p for p, x in zip(pieces, found, strict=True) if x is None]))
                size += len(text)
                found = filter(None, found)
            totals.append(sum(found))
            if size > WAITING:
                self._settle(waiting, totals)
                waiting, size = [], 0
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: list[tuple[int, list[str]]], totals: list[int]) -> None:
        new = list({piece for _, pieces in waiting for piece in pieces})
        raw = [piece.encode() for piece in new]
        counted = dict(zip(new, self.merges.counts(raw), strict=True))
        for i, pieces in waiting:
            totals[i] += sum(map(counted.__getitem__, pieces))
        if len(self.emits) + len(new) > KEPT:
            self.emits.clear()
        self.emits.update((piece, counted[piece]) for piece, r in islice(zip(new, raw, strict=True), KEPT) if len(r) <= KEPT_BYTES)

    def map_of(self, chunk: str) -> StateMap:
        """The state is known where the class changes, but for what follows white space, and for a letter after another sign, which may be 's and the like."""
        _, kind = self._typed(chunk)
        before, after = kind[:-1], kind[1:]
        places = np.flatnonzero((before != after) & (before != SPACE) & ~((before == OTHER) & (after == LETTER))) + 1
        if not len(places):
            return StateMap(chunk, 0, "", False)
        first, last = int(places[0]), int(places[-1])
        return StateMap(chunk[:first], self.count(chunk[first:last]), chunk[last:], True)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """a, then b. Between them is either a stretch with known states on both sides, or what has none yet."""
        if not a.known:
            return self._apart(a.head + b.head, b) if b.known else self.map_of(a.head + b.head)
        if not b.known:
            inner = self.map_of(a.tail + b.head)
            return StateMap(a.head, a.count + self.count(inner.head) + inner.count, inner.tail, True) if inner.known else StateMap(a.head, a.count, inner.head, True)
        return StateMap(a.head, a.count + self.count(a.tail + b.head) + b.count, b.tail, True)

    def _apart(self, head: str, b: StateMap) -> StateMap:
        """A map whose head may have known states within."""
        inner = self.map_of(head)
        return StateMap(inner.head, inner.count + self.count(inner.tail) + b.count, b.tail, True) if inner.known else StateMap(head, b.count, b.tail, True)

    def total(self, whole: StateMap) -> int:
        """Tokens of a text that the map is of, with nothing before it."""
        return self.count(whole.head) + whole.count + self.count(whole.tail)

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if not any(s in text for s in self.specials):
            return self._chunked(text, chunk)
        parts = re.split(special_pattern(self.specials), text)
        return len(parts) - 1 + sum(self._chunked(part, chunk) for part in parts)

    def tokens_of(self, texts: Iterable[str]) -> list[int]:
        """tokens() of many texts of a chunk at most."""
        sizes: list[int] = []

        def parts() -> Iterator[str]:
            for text in texts:
                cut = re.split(special_pattern(self.specials), text) if any(s in text for s in self.specials) else [text]
                sizes.append(len(cut))
                yield from cut

        counted = iter(self.counts(parts()))
        return [n - 1 + sum(islice(counted, n)) for n in sizes]

    def _chunked(self, text: str, chunk: int) -> int:
        if len(text) <= chunk:
            return self.count(text)
        maps = [self.map_of(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.total(maps[0])


def special_pattern(specials: list[str]) -> str:
    """Matches special strings, of several at a place the longest. Java and Python read it alike."""
    return "|".join(re.sub(r"([^\w])", r"\\\1", s) for s in sorted(specials, key=len, reverse=True))


@lru_cache(maxsize=2)
def compiled(path: str) -> CompiledTokenizer:
    """Compiled once in each Python worker."""
    return CompiledTokenizer(path)


MAPS = "row long, part int, level int, place long, head string, n long, tail string, known boolean"


def _composed(maps: DataFrame, tokenizer: str, levels: int) -> DataFrame:
    """row, n_tokens of the rows that maps (MAPS) of chunks are of: neighbours are composed two by two, in as many levels as the longest text needs."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            out = []
            for maps_ in batch.column("maps"):
                both = [StateMap(m["head"], m["n"], m["tail"], m["known"]) for m in maps_.as_py()]
                out.append(machine.compose(*both) if len(both) > 1 else both[0])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array([0] * len(out), pa.int32()), batch.column("place"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=[x.split()[0] for x in MAPS.split(", ")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            n = [machine.total(StateMap(*(x.as_py() for x in m))) for m in zip(*(batch.column(c) for c in ("head", "n", "tail", "known")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64())], names=["row", "n"])

    for _ in range(levels):
        pairs = maps.groupBy("row", "part", F.floor(F.col("place") / 2).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "head", "n", "tail", "known"))).alias("maps"))
        maps = frozen(pairs.mapInArrow(compose, MAPS))
    return maps.mapInArrow(finish, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).select("row", (F.col("n") + F.col("parts") - 1).alias("n_tokens"))


def _long_counts(rows: DataFrame, tokenizer: str, specials: list[str], chunk: int) -> DataFrame:
    """row, n_tokens of rows (row, text), by the chunks of the texts."""

    def chunks(part: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(part) - 1) / chunk).cast("int")))
        return F.transform(places, lambda i: F.substring(part, i * chunk + 1, F.lit(chunk)))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            maps = [machine.map_of(c.as_py()) for c in batch.column("chunk")]
            n = len(maps)
            columns = zip(*maps, strict=True) if maps else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array([0] * n, pa.int32()), batch.column("place"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=[x.split()[0] for x in MAPS.split(", ")])

    parts = F.split("text", special_pattern(specials), -1) if specials else F.array("text")
    dealt = rows.select("row", F.posexplode(parts).alias("part", "piece")).select("row", "part", F.posexplode(chunks(F.col("piece"))).alias("place", "chunk"))
    # the chunks of one text go to several tasks
    dealt = dealt.withColumn("place", F.col("place").cast("long")).repartition("row", "part", "place")
    maps = frozen(dealt.mapInArrow(summarise, MAPS))
    most = maps.agg(F.max("place")).first()[0]
    return _composed(maps, tokenizer, int(most or 0).bit_length())


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a byte-level BPE file, readable on all executors. A null text is empty and has no token; ids are
    of any type; repeated rows each have a row, an empty table gives an empty result, other columns are ignored. Only
    texts of more than chunk characters are shuffled, by chunk.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    long = frozen(texts.filter(is_long).withColumn("row", F.monotonically_increasing_id()))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = texts.filter(~is_long).select("doc_id", "text", n_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            n = pa.array(machine.tokens_of(t.as_py() for t in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    schema = short.select("doc_id", "n_bytes").withColumn("n_tokens", F.lit(0).cast("long")).schema
    counted = short.mapInArrow(run, schema)
    if not long.isEmpty():
        specials = compiled(tokenizer).specials
        counted = counted.unionByName(long.select("row", "doc_id", n_bytes).join(_long_counts(long.select("row", "text"), tokenizer, specials, chunk), "row").select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
