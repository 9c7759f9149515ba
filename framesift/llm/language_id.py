"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum
over all ways to cut it into pieces (a forward pass); expectation maximisation over labelled words fits the piece
probabilities (forward and backward passes). Pieces never cross words, so a text is the product of its words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_batches, frozen, shuffle_partitions, stored

WORDS = re.compile(r"[^\W\d_]+")
#: Longer words are summed in logarithms, as their products fall below the least double; those of more than KEPT_CHARS are scored each time they come.
LONGEST, KEPT_CHARS = 24, 64
#: Labelled documents of a language that the fit takes, about (chosen by hash).
SAMPLE_DOCS = 400
ROUNDS, SMOOTHING = 3, 0.05
#: Words whose scores a worker keeps, words that are scored at a time (two such runs have to fit), and texts that Python gets at a time.
KEPT, RUN, BATCH = 100_000, 30_000, 500
UNKNOWN = "und"
#: Bits of a code point, and words whose segmentations are summed together.
POINT_BITS, TOGETHER = 21, 8192
#: How likely a text of no learned language is beforehand, to one of a given learned language; matters for short texts only.
OUTSIDE_PRIOR = 0.01


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Lower-case letter pieces of a sentencepiece model, numbered; '▁' marks the start of a word. Number 0 is any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    kept = sorted({p.lower() for p in pieces if p.lstrip("▁").isalpha() and p.count("▁") <= 1 and "▁" not in p[1:]})
    return {p: i + 1 for i, p in enumerate(["▁", *kept])}


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def edges(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end in '▁' + word: the starts and numbers of the pieces that end there."""
    marked = "▁" + word
    return [[], *(_ends(marked, end, pieces, longest) for end in range(1, len(marked) + 1))]


class Trie:
    """The pieces as transitions between nodes, in arrays, so that many places are followed at once."""

    def __init__(self, pieces: dict[str, int]) -> None:
        children: dict[int, int] = {}
        number: list[int] = [-1]
        for piece, n in pieces.items():
            node = 0
            for c in piece:
                key = node << POINT_BITS | ord(c)
                if (node := children.get(key, -1)) < 0:
                    node = children[key] = len(number)
                    number.append(-1)
            number[node] = n
        self.number = np.array(number)
        self.keys = np.array(sorted(children), np.int64)
        self.to = np.array([children[k] for k in self.keys.tolist()], np.int64)

    def step(self, nodes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where code points lead from nodes, and whether they lead anywhere."""
        keys = nodes << POINT_BITS | points
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.to[at], self.keys[at] == keys


def forward(words: list[str], probs: np.ndarray, pieces: dict[str, int], longest: int, trie: Trie | None = None) -> np.ndarray:
    """The probability of each word in each language, summed over all its segmentations. probs: pieces x languages."""
    trie = trie or Trie(pieces)
    parts = [_forward(words[i : i + TOGETHER], probs, longest, trie) for i in range(0, len(words), TOGETHER)]
    return np.concatenate(parts) if parts else np.empty((0, probs.shape[1]))


def _forward(words: list[str], probs: np.ndarray, longest: int, trie: Trie) -> np.ndarray:
    """Words are worked through together: first the pieces that begin at each place, then the sums, by the place where pieces end."""
    n, marked = len(words), ["▁" + w for w in words]
    lengths = np.array([len(m) for m in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    word = np.repeat(np.arange(n), lengths)
    left = np.repeat(lengths + first, lengths) - np.arange(len(points))
    at, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
    starts, ends, numbers = [], [], []
    for size in range(1, longest + 1):
        nodes, there = trie.step(nodes, points[at + size - 1])
        number = np.where(there, trie.number[nodes], -1)
        if size == 1:
            number[number < 0] = 0  # a single character is always a piece, number 0 if the vocabulary is without it
        held = number >= 0
        # a word of so many characters has one place more
        starts.append(at[held] + word[at[held]])
        ends.append(starts[-1] + size)
        numbers.append(number[held])
        on = there & (left[at] > size)
        at, nodes = at[on], nodes[on]
        if not len(at):
            break
    begin = first + np.arange(n)
    start, end, number = (np.concatenate(x) for x in (starts, ends, numbers))
    place = end - begin[np.searchsorted(begin, end, side="right") - 1]
    order = np.lexsort((end, place))
    start, end, number, place = start[order], end[order], number[order], place[order]
    alpha = np.zeros((len(points) + n, probs.shape[1]))
    alpha[begin] = 1.0
    bounds = np.searchsorted(place, np.arange(1, int(lengths.max()) + 2))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        here = end[low:high]
        heads = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        alpha[here[heads]] = np.add.reduceat(alpha[start[low:high]] * probs[number[low:high]], heads, axis=0)
    return alpha[begin + lengths]


def log_forward(words: list[str], probs: np.ndarray, pieces: dict[str, int], longest: int, trie: Trie | None = None) -> np.ndarray:
    """The logarithms of forward(), for words of any length."""
    out = np.empty((len(words), probs.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
    out[short] = np.log(np.maximum(forward([words[i] for i in short], probs, pieces, longest, trie), 1e-300))
    logs = np.log(probs) if len(short) < len(words) else probs
    for i, word in enumerate(words):
        if len(word) > LONGEST:
            out[i] = _long_forward(word, logs, pieces, longest)
    return out


def _ends(marked: str, end: int, pieces: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """Starts and numbers of the pieces of a marked word that end at a place; a single character is always one."""
    here = [(start, n) for start in range(max(0, end - longest), end) if (n := pieces.get(marked[start:end])) is not None]
    if not any(start == end - 1 for start, _ in here):
        here.append((end - 1, 0))
    return here


def _long_forward(word: str, logs: np.ndarray, pieces: dict[str, int], longest: int) -> np.ndarray:
    """A word of any length, place by place; only as many places are held as a piece can reach back."""
    marked = "▁" + word
    held = np.zeros((longest + 1, logs.shape[1]))
    for end in range(1, len(marked) + 1):
        starts, numbers = zip(*_ends(marked, end, pieces, longest), strict=True)
        ways = held[[s % (longest + 1) for s in starts]] + logs[list(numbers)]
        most = ways.max(axis=0)
        held[end % (longest + 1)] = most + np.log(np.exp(ways - most).sum(axis=0))
    return held[len(marked) % (longest + 1)]


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def expected_counts(word: str, language: int, probs: np.ndarray, pieces: dict[str, int], longest: int) -> list[tuple[int, float]]:
    """Expected uses of each piece in a word, over all its segmentations. A long word is summed in logarithms."""
    lattice, p = edges(word, pieces, longest), probs[:, language]
    if len(word) > LONGEST:
        return _long_counts(lattice, np.log(p).tolist())
    alpha = [1.0]
    for here in lattice[1:]:
        alpha.append(sum(alpha[start] * p[n] for start, n in here))
    beta = [0.0] * len(alpha)
    beta[-1] = 1.0
    out = []
    for end in range(len(alpha) - 1, 0, -1):
        for start, n in lattice[end]:
            share = p[n] * beta[end]
            beta[start] += share
            out.append((n, alpha[start] * share / alpha[-1]))
    return out


def _long_counts(lattice: list[list[tuple[int, int]]], logs: list[float]) -> list[tuple[int, float]]:
    alpha = [0.0]
    for here in lattice[1:]:
        alpha.append(_log_sum([alpha[start] + logs[n] for start, n in here]))
    # what comes after each place: its ends are gathered before it is passed
    after: list[list[float]] = [[] for _ in alpha]
    after[-1].append(0.0)
    out = []
    for end in range(len(alpha) - 1, 0, -1):
        beta = _log_sum(after[end])
        for start, n in lattice[end]:
            after[start].append(logs[n] + beta)
            out.append((n, math.exp(alpha[start] + logs[n] + beta - alpha[-1])))
        after[end] = []
    return out


class Model:
    """Piece probabilities of each language; small: pieces of the vocabulary x languages."""

    def __init__(self, languages: list[str], probs: np.ndarray, path: str) -> None:
        self.languages, self.probs, self.path = languages, probs, path
        #: Tells models apart within a worker.
        self.name = uuid.uuid4().hex

    def outside(self) -> np.ndarray:
        """Piece probabilities of writing in no learned language: half of it any piece of the vocabulary, half single letters.

        Letters are as frequent as in the learned languages on average, so that their letters in another order, or in
        the words of another language, are better explained here than there.
        """
        pieces = vocabulary(self.path)
        letters: dict[int, float] = {}
        means = self.probs.mean(axis=1)
        for piece, n in pieces.items():
            for c in piece:
                at = pieces.get(c, 0)
                letters[at] = letters.get(at, 0.0) + means[n]
        out, total = np.full(len(means), 0.5 / len(means)), sum(letters.values())
        for at, share in letters.items():
            out[at] += 0.5 * share / total
        return out

    @staticmethod
    def start(languages: list[str], path: str) -> Model:
        n = len(vocabulary(path)) + 1
        return Model(languages, np.full((n, len(languages)), 1.0 / n), path)


def held_out(id_col: Column) -> Column:
    """Documents that the fit never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from text and label of documents that aren't held out, about sample_docs of each language, chosen by a hash of id and text.

    Rows with a null text or label teach nothing; null ids are no special case. Repeated rows count each. Without a labelled row, as in an
    empty table, there is no language, and all texts are `und`. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0)), vocabulary_path)
    million = 1_000_000
    shares = spark.createDataFrame([(k, min(million, -(-million * sample_docs // n))) for k, n in sizes.items()], "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text")), F.lit(29)), F.lit(million)) < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                counts.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a number given keeps the few words that there are spread over the cluster
    counted = frozen(counted.repartition(shuffle_partitions(spark), "word"))
    model = Model.start(languages, vocabulary_path)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            now = sent.value
            pieces = vocabulary(now.path)
            longest, number = max(map(len, pieces)), {k: i for i, k in enumerate(now.languages)}
            sums: Counter = Counter()
            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                    k = number[lang]
                    for piece, share in expected_counts(word, k, now.probs, pieces, longest):
                        sums[k, piece] += n * share
            yield pd.DataFrame([(*k, x) for k, x in sums.items()], columns=["k", "piece", "x"])

        sums = counted.mapInPandas(expect, "k int, piece int, x double").groupBy("k", "piece").agg(F.sum("x").alias("x")).collect()
        counts = np.full_like(model.probs, SMOOTHING)
        for k, piece, x in sums:
            counts[piece, k] += x
        model = Model(languages, counts / counts.sum(axis=0), vocabulary_path)
    return model


class _Scorer:
    """Scores texts by their words; keeps the scores of words that came up, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, vocabulary(model.path)
        self.longest, self.trie = max(map(len, self.pieces)), Trie(self.pieces)
        self.known: dict[str, int] = {}
        # the last column is the alternative to all languages learned
        self.probs = np.column_stack([model.probs, model.outside()]) if model.languages else model.probs
        self.scores = np.empty((KEPT, self.probs.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, list(words)
        if new:
            at = len(self.known)
            self.scores[at : at + len(new)] = log_forward(new, self.probs, self.pieces, self.longest, self.trie)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, list[bool]]:
        """The log likelihood of each text, and whether it has a letter. Runs of words are scored together, those of a long text one after the other."""
        sums, letters = np.zeros((len(texts), self.probs.shape[1])), []
        waiting: list[tuple[int, list[str]]] = []
        n = 0

        def score() -> None:
            self.learn(set().union(*(words for _, words in waiting)))
            for i, words in waiting:
                sums[i] += self.scores[list(map(self.known.__getitem__, words))].sum(axis=0)
            waiting.clear()

        def scored_alone(i: int, words: list[str]) -> list[str]:
            long = [w for w in words if len(w) > KEPT_CHARS]
            for word in long:
                sums[i] += log_forward([word], self.probs, self.pieces, self.longest, self.trie)[0]
            return [w for w in words if len(w) <= KEPT_CHARS] if long else words

        for i, text in enumerate(texts):
            words = words_of(text or "")
            letters.append(bool(words) and (words[0].isalpha() or any(c.isalpha() for w in words for c in w)))
            if max(map(len, words), default=0) > KEPT_CHARS:
                words = scored_alone(i, words)
            for at in range(0, len(words), RUN):
                waiting.append((i, words[at : at + RUN]))
                n += len(waiting[-1][1])
                if n >= RUN:
                    score()
                    n = 0
        if waiting:
            score()
        return sums, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        return list(self._each(texts))

    def _each(self, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
        if not self.model.languages:
            yield from [(UNKNOWN, 0.0, 0.0)] * len(texts)
            return
        for (*total, outside), has_letter in zip(*self.totals(texts), strict=True):
            if not has_letter:
                yield UNKNOWN, 0.0, 0.0
                continue
            odds = np.exp(np.array(total) - max(total))
            best = int(odds.argmax())
            against = OUTSIDE_PRIOR * np.exp(min(outside - total[best], 700.0))
            yield self.model.languages[best], float(odds[best] / odds.sum()), float(odds.sum() / (odds.sum() + against))


_latest: list[_Scorer] = []


def _scorer(model: Model) -> _Scorer:
    """A scorer for the model, the same for all tasks that a worker runs one after the other, so that each worker learns a word once."""
    if not _latest or _latest[0].model.name != model.name:
        _latest[:] = [_Scorer(model)]
    return _latest[0]


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "learned")) -> DataFrame:
    """Columns keep of each row of docs, then the language, the score (its probability among the languages learned) and
    the probability that the text is of a language learned at all, against Model.outside().

    Only the text is looked at, all of it. A text that is null or has no letter is `und` with 0 and 0, as is any text
    if no language was learned. names must not clash with keep. Nothing is shuffled; the result is written to the shared
    folder, so keep should be ids rather than texts. An empty table gives an empty result, repeated rows each have a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).withColumn(names[2], F.lit(0.0)).schema
    # the text comes first: by place, it can't clash with a kept column
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("_0"), *[F.col(f"`{c}`").alias(f"_{i + 1}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in batches:
            found = scorer.predict(batch.column(0).to_pylist())
            added = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], names=[*keep, *names])

    with arrow_batches(docs.sparkSession, BATCH):
        return stored(source.mapInArrow(run, schema), "languages")


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score. Fits on the labelled documents that aren't held out, then predicts all."""
    model = fit(docs, vocabulary_path, id_col, text_col, lang_col)
    found = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
