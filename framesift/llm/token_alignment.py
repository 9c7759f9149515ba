"""Alignment of two tokenizers by a dangling-suffix transducer.

Both token streams spell the same bytes. The transducer's state is which side leads and its bytes that the other side has not
matched yet, always a suffix of one token; from it and the next token of the side that lags follows the next state. Such
transitions are kept. When nothing is left over, both sides end at one byte, and a group of tokens closes.

A text is cut at single blanks between other characters. No token of either kind crosses such a place from the left, so
both sides end there and the tokens after it don't depend on what was before: a word is encoded and aligned once in a worker,
however often it comes. Counts over the corpus are aggregations: each document hands on its distinct id pairs, with their links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import BROADCAST_ROWS, arrow_batches, bounded, frozen, stored
from framesift.llm.token_counts import _byte_of_letter

#: More than any token's number.
TOKENS = 1 << 24
#: Where a text is cut: a single blank between characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words (about 600 bytes each) and transitions that a worker keeps; characters that are encoded at once, and characters of texts that are worked on together.
KEPT, KEPT_STEPS, RUN, TOGETHER = 600_000, 2_000_000, 50_000, 2_000_000
#: Id pairs of a group that is kept; larger ones are made anew.
KEPT_PAIRS = 64
#: Texts that Python gets at a time.
BATCH = 500


class Alphabet:
    """The two tokenizers, and the bytes that each of their tokens stands for."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_of_letter()
        special = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                self.a_bytes[i] = bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError(f"{pieces} has a piece that goes on after a blank, so words can't be encoded by themselves")
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))

    def encode_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def encode_b(self, text: str) -> list[int]:
        return self.b.encode(text)


class DanglingSuffix:
    """The transducer. State 0: nothing is left over; else (whether a leads, its unmatched bytes). In states where a leads the next token is one of b, else one of a."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.sides = a_bytes, b_bytes
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.number: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        #: By state and token (state * TOKENS + token): the state that follows, or -1 where the bytes differ.
        self.steps: dict[int, int] = {}
        self.leads = [False]

    def _step(self, state: int, token: int) -> int:
        a_leads, left = self.states[state]
        said = self.sides[a_leads][token]
        if left.startswith(said):
            to = a_leads, left[len(said) :]
        elif said.startswith(left):
            to = not a_leads, said[len(left) :]
        else:
            return -1
        if not to[1]:
            return 0
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
            self.leads.append(to[0])
        return self.number[to]

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of a and of b there are up to the end of each group, or None if the bytes differ."""
        if len(self.steps) > KEPT_STEPS:
            self.clear()
        steps, leads = self.steps, self.leads
        i = j = state = 0
        n = len(a)
        a_ends, b_ends = [], []
        try:
            while i < n or state:
                if leads[state]:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                key = state * TOKENS + token
                if (state := steps.get(key)) is None:
                    state = steps[key] = self._step(*divmod(key, TOKENS))
                if not state:
                    a_ends.append(i)
                    b_ends.append(j)
                elif state < 0:
                    return None
        except IndexError:
            return None
        return (a_ends, b_ends) if j == len(b) else None


class Aligner:
    """Aligns texts word by word; keeps what it found of a word, up to a bound, and then of those that came more than once."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.alphabet = Alphabet(byte_level, pieces)
        self.machine = DanglingSuffix(self.alphabet.a_bytes, self.alphabet.b_bytes)
        self.pieces = len(self.alphabet.b_bytes)
        self.names = [str(i) for i in range(max(len(self.alphabet.a_bytes), self.pieces))]
        #: Text, links and id pairs of groups, by their tokens.
        self.groups: dict[tuple, tuple[str, int, list[int], list[int]]] = {}
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        #: n_a, n_b, n_groups, n_links of each word (n_a 0 if the sides differ), where its links begin, and how often it came.
        self.counts = np.zeros((0, 4), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets words that came once, and of the others the rarest, until half of what may be kept is free."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > KEPT // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: KEPT // 2]])
        words = list(self.known)
        self.known = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.texts = [self.texts[k] for k in keep.tolist()]
        at, held = self._spans(keep)
        self.pairs, self.times = self.pairs[at], self.times[at]
        self.starts = np.concatenate([[0], np.cumsum(held)])
        self.counts, self.uses = self.counts[keep], self.uses[keep] // 2

    def _spans(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the links of words are, one word after the other, and how many each has."""
        held = self.starts[numbers + 1] - self.starts[numbers]
        return np.repeat(self.starts[numbers] - (np.cumsum(held) - held), held) + np.arange(int(held.sum())), held

    def _group(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[str, int, list[int], list[int]]:
        """A group's text, its number of links, its id pairs and how often each is linked. Ids that come again count as often as they come."""
        text = f"{','.join([self.names[i] for i in a])}|{','.join([self.names[i] for i in b])}"
        ids_a, n_a = np.unique(a, return_counts=True)
        ids_b, n_b = np.unique(b, return_counts=True)
        pairs = np.add.outer(ids_a * self.pieces, ids_b).ravel().tolist()
        found = text, len(a) * len(b), pairs, np.multiply.outer(n_a, n_b).ravel().tolist()
        if len(pairs) <= KEPT_PAIRS:
            if len(self.groups) >= KEPT:
                self.groups.clear()
            self.groups[a, b] = found
        return found

    def _words(self, a: list[int], b: list[int], a_ends: list[int], b_ends: list[int], cuts: list[int], out: _Learned) -> None:
        """Adds words to out: of the groups that end at a_ends and b_ends, each has those up to its cut."""
        groups, i, j, first = self.groups, 0, 0, 0
        for cut in cuts:
            texts, n_links, held, a_from, b_from = [], 0, 0, i, j
            for k in range(first, cut):
                i_end, j_end = a_ends[k], b_ends[k]
                key = tuple(a[i:i_end]), tuple(b[j:j_end])
                text, n, pairs, times = groups.get(key) or self._group(*key)
                texts.append(text)
                n_links += n
                held += len(pairs)
                out.pairs += pairs
                out.times += times
                i, j = i_end, j_end
            out.texts.append(";".join(texts).encode())
            out.counts.append((i - a_from, j - b_from, cut - first, n_links))
            out.held.append(held)
            first = cut

    def _spelt(self, text: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """Tokens of both sides, and where groups end, or None if either side doesn't spell the text."""
        a, b = self.alphabet.encode_a(f" {text}"), self.alphabet.encode_b(text)
        same = b"".join([self.alphabet.a_bytes[i] for i in a]) == f" {text}".encode()
        found = self.machine.groups(a, b) if same else None
        return None if found is None else (a, b, *found)

    def _alone(self, word: str, out: _Learned) -> None:
        found = self._spelt(word)
        if found is None:
            out.texts.append(b"")
            out.counts.append((0, 0, 0, 0))
            out.held.append(0)
        else:
            self._words(*found, [len(found[2])], out)

    def _together(self, words: list[str], out: _Learned) -> None:
        """Words that neither begin nor end with white space are encoded as one text, and cut apart by their sizes."""
        found = self._spelt(" ".join(words))
        if found is None:
            for word in words:
                self._alone(word, out)
            return
        a, _, a_ends, _ = found
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(np.cumsum(self.alphabet.a_sizes[a])[np.array(a_ends) - 1], ends, side="right")
        self._words(*found, cuts.tolist(), out)

    def learn(self, words: list[str]) -> None:
        """Words that aren't known yet, each once."""
        odd = {w for w in words if not w or w[0].isspace() or w[-1].isspace()}
        order, run, size, out = list(odd), [], 0, _Learned()
        for word in order:
            self._alone(word, out)
        for word in words:
            if word in odd:
                continue
            run.append(word)
            size += len(word)
            if size >= RUN:
                self._together(run, out)
                order += run
                run, size = [], 0
        if run:
            self._together(run, out)
            order += run
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
        self.texts += out.texts
        self.counts = np.concatenate([self.counts, np.array(out.counts, np.int64).reshape(-1, 4)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(out.held, dtype=np.int64)])
        self.pairs, self.times = np.concatenate([self.pairs, np.array(out.pairs, np.int64)]), np.concatenate([self.times, np.array(out.times, np.int64)])
        self.uses = np.concatenate([self.uses, np.zeros(len(order), np.int64)])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Of each text: n_a, n_b, n_groups, n_links; the digest of its groups; its distinct id pairs (a * pieces + b, ascending); how often each is linked."""
        cut = [CUT.split(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if self.known and len(self.known) + len(new) > KEPT:
            self.shrink()
            new = set().union(*cut).difference(self.known)
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(words) for words in cut])
        ends = np.cumsum(sizes)
        each = [self.known[w] for words in cut for w in words]
        numbers, doc = np.array(each, np.int64), np.repeat(np.arange(len(texts)), sizes)
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        counts = np.stack([np.bincount(doc, self.counts[numbers, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
        # a text with one word that differs has no tokens
        bad = np.zeros(len(texts), bool)
        bad[doc[self.counts[numbers, 0] == 0]] = True
        counts[bad] = 0
        said = self.texts
        digests = [hashlib.sha256(b";".join([said[k] for k in each[end - size : end]])).hexdigest() if n else "" for end, size, n in zip(ends.tolist(), sizes.tolist(), counts[:, 0].tolist(), strict=True)]
        good = ~bad[doc]
        pairs, times = self._links(doc[good], numbers[good], len(texts))
        return counts, digests, pairs, times

    def _links(self, doc: np.ndarray, numbers: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        span = len(self.known) + 1
        words, often = np.unique(doc * span + numbers, return_counts=True)
        doc, numbers = words // span, words % span
        at, held = self._spans(numbers)
        pairs, times, doc = self.pairs[at], self.times[at] * np.repeat(often, held), np.repeat(doc, held)
        cuts = np.cumsum(np.bincount(doc, minlength=n))[:-1]
        out_pairs, out_times = [], []
        for own, many in zip(np.split(pairs, cuts), np.split(times, cuts), strict=True):
            order = np.argsort(own)
            own, many = own[order], many[order]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            out_pairs.append(own[heads])
            out_times.append(np.add.reduceat(many, heads) if len(own) else many)
        return out_pairs, out_times


class _Learned:
    """What is found of words, one after the other: their groups' text, counts, number of links, and the links."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.counts: list[tuple[int, int, int, int]] = []
        self.held: list[int] = []
        self.pairs: list[int] = []
        self.times: list[int] = []


@lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One in each Python worker."""
    return Aligner(byte_level, pieces)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ALIGNED of each row of docs, written to the shared folder: what the corpus-wide counts need. pairs are a * (pieces of b) + b, ascending."""

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))

    def together(texts: pa.Array) -> Iterator[tuple[int, int]]:
        first = size = 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_pylist()):
            if size and size + n > TOGETHER:
                yield first, i
                first, size = i, 0
            size += n
        yield first, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = aligner(byte_level, pieces)
        for batch in batches:
            for first, end in together(batch.column("text")) if batch.num_rows else ():
                part = batch.slice(first, end - first)
                counts, digests, pairs, times = machine.align(part.column("text").to_pylist())
                columns = [part.column("row"), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.T), pa.array(digests, pa.string()), lists(pairs), lists(times)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ALIGNED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH):
        return stored(rows.mapInArrow(run, ALIGNED), "aligned", **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"})


def pair_counts(found: DataFrame, pieces: int) -> DataFrame:
    """pair, count (documents that hold it linked), best (whether no pair of the same a is held by more), over all rows of found (ALIGNED)."""
    counts = frozen(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
    a = F.floor(F.col("pair") / pieces).alias("a")
    highest = frozen(counts.groupBy(a).agg(F.max("count").alias("highest")))
    return counts.withColumn("a", a).join(bounded(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _frequent(counts: DataFrame, rows: int) -> int:
    """The least count so that no more than so many pairs have it or a greater one."""
    held = 0
    least = 1 << 62
    # a row for each different count, few beside the pairs
    for r in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).toLocalIterator():
        held += r["n"]
        if held > rows:
            return least
        least = r["count"]
    return least


def token_alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_level and pieces: paths of a byte-level BPE file (a: blank + text) and of a sentencepiece model (b: text), readable on
    all executors. A text that is null or empty, or that either side doesn't spell byte for byte, has no tokens: zeros and
    an empty digest. Each row is a document of its own, whatever its id; an empty table gives an empty result; other
    columns are ignored. Texts are read once; the pairs are kept in the shared folder. Counts of the most frequent pairs
    are broadcast, those of all others meet the documents that hold them by a shuffle.
    """
    n_pieces = len(aligner(byte_level, pieces).alphabet.b_bytes)
    found = aligned(docs, byte_level, pieces, id_col, text_col)
    counts = frozen(pair_counts(found, n_pieces))
    least = _frequent(counts, broadcast_rows)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times").withColumnRenamed("pairs", "pair")
    frequent, rare = counts.filter(F.col("count") >= least), counts.filter(F.col("count") < least)
    met = each.join(F.broadcast(frequent), "pair")
    if not rare.isEmpty():
        met = met.unionByName(each.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair"))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = met.groupBy("row").agg(best, F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    whole = found.drop("pairs", "times").join(sums, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
