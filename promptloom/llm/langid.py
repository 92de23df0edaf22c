"""Language of documents by a linear-chain conditional random field over their words.

Every word gets a label. Its features are its affixes, its character n-grams, the word
itself, and what a lexicon says about it; transitions between labels are learned with them.
Forward-backward gives the probability of each label at each word, also where a text changes
its language. A document's language is the label with the largest mean probability, and its
score is that mean.

Training. The lexicon has the shares of every word of every labelled text, counted by Spark and
stored as a table. Up to ``LEXICON`` words, the most frequent ones of each language, are sent to
the tasks as 12 bytes each; if there are more, the others are joined with the words of the
texts, so that number decides costs only. In
training a word's shares leave out the segments themselves. The field is fitted to segments of labelled
texts, drawn by a hash at a rate that gives about ``SEGMENTS`` per language. A part of them
is spliced with segments of other languages, so that transitions see changes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import ODD, add_columns, mix, table
from promptloom.llm.registry import query
from promptloom.session import materialise, ship_package

LEXICON, SEGMENTS, SEGMENT_WORDS, ROUNDS = 3_000_000, 600, 48, 40
BUCKETS = 1 << 17
UNKNOWN = "und"
LEAST_SCORE = 0.35  # below it a document is rejected: no language has a clear share

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
_MOST_WORDS = 150_000  # words whose scores a task remembers
_LEARNED = 10_000  # words whose features a task holds at once
_CELLS = 500_000  # (word, label) cells that are decoded at once
_WORDS = 200_000  # words of texts that are decoded together; a longer text is decoded alone
_RESCALE = 8


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z and non-ASCII characters of the lower-cased text; none without a letter."""
    if not text:
        return []
    words = text.lower().encode().translate(_LETTERS).split()
    return words if any(w.isalpha() for w in words) or any(c.isalpha() for c in text) else []


_WORD, _START, _END, _GRAM, _LEXICON = (zlib.crc32(kind) for kind in (b"word", b"start", b"end", b"gram", b"lexicon"))
_AFFIX = 5  # characters of the longest affix


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(kind)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@cache
def _lexicon_buckets(code: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(b"%d %s" % (label, share.encode()), _LEXICON) % BUCKETS for label, share in enumerate(code))


def features(words: list[bytes], codes: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, and which word each belongs to.

    Features are affixes and n-grams (both in characters), the word, and its shares in the
    lexicon (one digit per label). They are hashed for all words at once.
    """
    texts = [w.decode("utf-8", "replace") for w in words]
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[owner] - place  # characters from this one to the word's end
    flat = [np.array([zlib.crc32(w, _WORD) % BUCKETS for w in words], np.int64)]
    owners = [np.arange(len(words))]
    hashes = np.zeros(len(chars), np.uint64)
    for n in range(1, _AFFIX + 1):
        # The n characters that start at each place; those beyond the word's end are not used.
        hashes[: len(chars) - n + 1] = hashes[: len(chars) - n + 1] * ODD + chars[n - 1 :] + np.uint64(1)
        for kind, at in ((_START, (place == 0) & (left >= n)), (_END, left == n), (_GRAM, (left >= n) if n in (2, 3) else None)):
            if at is not None:
                flat.append(_buckets(hashes[at], kind + n))
                owners.append(owner[at])
    known = [(i, _lexicon_buckets(code)) for i, code in enumerate(codes) if code]
    flat.append(np.array([x for _, found in known for x in found], np.int64))
    owners.append(np.repeat(np.array([i for i, _ in known], np.int64), [len(found) for _, found in known]))
    return np.concatenate(flat), np.concatenate(owners)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities for a block of sequences.

    ``scores`` is (time, sequence, label) of exponentiated scores, ``moves`` the
    exponentiated transitions; times from a sequence's length on are left out.
    """
    steps, _, labels = scores.shape
    order = np.argsort(lengths, kind="stable")
    if (order[1:] < order[:-1]).any():
        found = np.empty_like(scores)
        found[:, order] = forward_backward(scores[:, order], lengths[order], moves)
        return found
    # Shorter sequences come first, so those that reach a time are the last columns. The best
    # label of a word has the score 1, so sums shrink by a bounded factor at each time and
    # are brought back to 1 every _RESCALE times only.
    first = np.searchsorted(lengths, np.arange(steps + 1), "right")
    ahead = np.full_like(scores, 1.0 / labels)
    np.multiply(ahead[0], scores[0], out=ahead[0])
    for t in range(1, steps):
        state = ahead[t, first[t] :]
        np.matmul(ahead[t - 1, first[t] :], moves, out=state)
        state *= scores[t, first[t] :]
        if t % _RESCALE == 0:
            state /= state.sum(1, keepdims=True)
    behind, back = np.ones(scores.shape[1:]), np.ascontiguousarray(moves.T)
    for t in range(steps - 2, -1, -1):
        state = behind[first[t + 1] :]
        state[:] = (state * scores[t + 1, first[t + 1] :]) @ back
        if t % _RESCALE == 0:
            state /= state.sum(1, keepdims=True)
        ahead[t, first[t + 1] :] *= state
    ahead /= ahead.sum(2, keepdims=True)
    return ahead


@dataclass
class Lexicon:
    """Words, named by 64-bit hashes, and their shares by label (one digit each): 12 bytes a word."""

    hashes: np.ndarray = field(repr=False)  # sorted
    kinds: np.ndarray = field(repr=False)  # places in ``codes``
    codes: list[str] = field(repr=False)

    @classmethod
    def of(cls, hashes: np.ndarray, codes: list[str]) -> Lexicon:
        names = sorted(set(codes))
        place = {name: i for i, name in enumerate(names)}
        order = np.argsort(hashes)
        return cls(hashes[order], np.array([place[c] for c in codes], np.int32)[order], names)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: list[bytes]) -> list[str | None]:
        if not len(self.hashes):
            return [None] * len(words)
        asked = word_keys(words)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        kinds = np.where(self.hashes[at] == asked, self.kinds[at], -1)
        return [self.codes[k] if k >= 0 else None for k in kinds.tolist()]


def word_keys(words: list[bytes]) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for the words."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


@dataclass
class Field:
    """A fitted conditional random field."""

    labels: list[str]
    weights: np.ndarray = field(repr=False)
    moves: np.ndarray = field(repr=False)
    lexicon: Lexicon = field(repr=False)
    rest: DataFrame | None = field(default=None, repr=False)  # word, code: all words, also those not in the lexicon

    def word_scores(self, words: list[bytes], more: dict[bytes, str] | None = None) -> np.ndarray:
        more = more or {}
        flat, owner = features(words, [code or more.get(w) for w, code in zip(words, self.lexicon.find(words), strict=True)])
        return np.stack([np.bincount(owner, self.weights[flat, k], len(words)) for k in range(len(self.labels))], 1)


class Labeller:
    """Labels the words of texts; remembers the scores of words it has seen."""

    def __init__(self, model: Field):
        self.model, self.numbers = model, {}
        self.scores = np.empty((0, len(model.labels)))

    def _learn(self, words: set[bytes], more: dict[bytes, str] | None) -> None:
        numbers = self.numbers
        unknown = [w for w in words if w not in numbers]
        for at in range(0, len(unknown), _LEARNED):
            fresh = unknown[at : at + _LEARNED]
            scores = self.model.word_scores(fresh, more)
            scores = np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0))
            if len(numbers) + len(fresh) > len(self.scores):
                grown = np.empty((3 * (len(numbers) + len(fresh)) // 2, scores.shape[1]))
                grown[: len(numbers)] = self.scores[: len(numbers)]
                self.scores = grown
            self.scores[len(numbers) : len(numbers) + len(fresh)] = scores
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))

    def _numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def shares(self, texts: list[list[bytes]], more: dict[bytes, str] | None = None) -> np.ndarray:
        """Mean label probabilities of each text; zeros for one without words.

        ``more`` has the shares of all words of the texts that only the stored lexicon has.
        """
        labels = len(self.model.labels)
        result = np.zeros((len(texts), labels))
        if not labels:
            return result
        moves = np.exp(self.model.moves)
        order = sorted((i for i, words in enumerate(texts) if words), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(texts[order[stop]]) * labels <= _CELLS:
                stop += 1
            block = order[at:stop]
            at = stop
            if len(self.numbers) > _MOST_WORDS:
                self.numbers.clear()
            self._learn(set().union(*(texts[i] for i in block)), more)
            numbers = [self._numbered(texts[i]) for i in block]
            lengths = np.array([len(n) for n in numbers])
            scores = np.ones((lengths.max(), len(block), labels))
            for column, own in enumerate(numbers):
                scores[: len(own), column] = self.scores[own]
            chances = forward_backward(scores, lengths, moves)
            for column, i in enumerate(block):
                result[i] = chances[: lengths[column], column].mean(0)
        return result


def _counted(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, Counter()).update(words_of(text.as_py()))
            for label, own in counts.items():
                words = list(own)
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(part)), pa.array(part, pa.binary()), pa.array([own[w] for w in part], pa.int64())],
                        ["label", "word", "n"],
                    )

    return labelled.mapInArrow(run, "label string, word binary, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))


def _segments(labelled: DataFrame, rates: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Copies of a passage are drawn or left together; the caller keeps one of them.
            found: list[tuple[str, bytes]] = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words, most = words_of(text.as_py()), rates.get(label, 0.0) * 2.0**64
                for at in range(0, len(words), SEGMENT_WORDS):
                    segment = b" ".join(words[at : at + SEGMENT_WORDS])
                    if xxhash.xxh64_intdigest(segment, at) < most:
                        found.append((label, segment))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], ["label", "words"]
            )

    return labelled.mapInArrow(run, "label string, words binary")


def _splice(segments: list[tuple[int, list[bytes]]], seed: int = 0) -> list[tuple[list[bytes], list[int]]]:
    """Segments with their labels; every second one holds a stretch of the next one in a shuffled order."""
    order = np.random.default_rng(seed).permutation(len(segments))
    draw = np.random.default_rng(seed + 1)
    made = []
    for place, number in enumerate(order):
        label, words = segments[number]
        labels = [label] * len(words)
        if place % 2:
            other, more = segments[order[place - 1]]
            start = int(draw.integers(0, len(words) + 1))
            piece = more[: int(draw.integers(1, 1 + max(1, len(more) // 2)))]
            words = words[:start] + piece + words[start:]
            labels = labels[:start] + [other] * len(piece) + labels[start:]
        made.append((words, labels))
    return made


def fit(labels: list[str], segments: list[tuple[int, list[bytes]]], lexicon: dict[bytes, str], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a quadratic penalty, by adaptive gradient steps over all segments."""
    size = len(labels)
    model = Field(labels, np.zeros((BUCKETS, size)), np.zeros((size, size)), Lexicon.of(word_keys(list(lexicon)), list(lexicon.values())))
    made = _splice(segments)
    if not made or size < 2:
        return model
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in made for w in words))}
    flat, owner = features(list(vocabulary), [lexicon.get(w) for w in vocabulary])
    used, flat = np.unique(flat, return_inverse=True)
    lengths = np.array([len(words) for words, _ in made])
    steps = lengths.max()
    numbers, truth = np.zeros((steps, len(made)), np.int64), np.zeros((steps, len(made)), np.int64)
    for column, (words, given) in enumerate(made):
        numbers[: len(words), column] = [vocabulary[w] for w in words]
        truth[: len(words), column] = given
    real = np.arange(steps)[:, None] < lengths
    total = float(lengths.sum())
    seen_words = np.stack([np.bincount(numbers[real & (truth == k)], minlength=len(vocabulary)) for k in range(size)], 1)
    both = real[1:]
    seen_moves = np.bincount(truth[:-1][both] * size + truth[1:][both], minlength=size * size).reshape(size, size)
    weights, moves = np.zeros((len(used), size)), np.zeros((size, size))
    past_w, past_m = np.full_like(weights, 1e-12), np.full_like(moves, 1e-12)
    for _ in range(rounds):
        scores = np.stack([np.bincount(owner, weights[flat, k], len(vocabulary)) for k in range(size)], 1)
        scores = np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0))
        block = np.where(real[:, :, None], scores[numbers], 1.0)
        chances = forward_backward(block, lengths, np.exp(moves))
        hoped = np.stack([np.bincount(numbers[real], chances[:, :, k][real], len(vocabulary)) for k in range(size)], 1)
        # Expected moves from neighbouring marginals and the learned transitions.
        near = chances[:-1, :, :, None] * np.exp(moves) * chances[1:, :, None, :]
        near /= near.sum((2, 3), keepdims=True)
        hoped_moves = near[both].sum(0)
        step = (seen_words - hoped) / total
        up_w = np.stack([np.bincount(flat, step[owner, k], len(used)) for k in range(size)], 1) - 1e-6 * weights
        up_m = (seen_moves - hoped_moves) / total - 1e-6 * moves
        past_w += up_w**2
        past_m += up_m**2
        weights += 0.3 * up_w / np.sqrt(past_w)
        moves += 0.3 * up_m / np.sqrt(past_m)
    model.weights[used], model.moves = weights, moves
    return model


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> Field:
    """A field for the non-null labels of ``labelled``; without any it knows no language."""
    ship_package(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(text_col), F.col(label_col))
    counts = _counted(rows)
    counts = materialise(counts, "words")
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    labels = sorted(totals)
    share = {label: min(1.0, SEGMENTS * SEGMENT_WORDS / max(1, n)) for label, n in totals.items()}
    drawn = sorted((labels.index(r["label"]), bytes(r["words"])) for r in _segments(rows, share).distinct().collect())
    segments = [(label, words.split()) for label, words in drawn]
    own: dict[bytes, list[int]] = {}
    for label, words in segments:
        for word in words:
            own.setdefault(word, [0] * len(labels))[label] += 1
    asked = labelled.sparkSession.createDataFrame([(w,) for w in own], "word binary")
    left = {w: [-n for n in ns] for w, ns in own.items()}
    for row in counts.join(F.broadcast(asked), "word").toLocalIterator():
        left[bytes(row["word"])][labels.index(row["label"])] += row["n"]
    rates = {w: [max(n, 0) / totals[labels[i]] for i, n in enumerate(ns)] for w, ns in left.items()}
    model = fit(labels, segments, {w: _code(found) for w, found in rates.items() if any(found)})
    if not labels:
        return model
    rate = [F.sum(F.when(F.col("label") == label, F.col("n") / F.lit(float(totals[label]))).otherwise(0.0)).alias(f"r{i}") for i, label in enumerate(labels)]
    whole = sum((F.col(f"r{i}") for i in range(len(labels))), F.lit(0.0))
    digits = [F.rint(F.col(f"r{i}") / whole * 5).cast("int").cast("string") for i in range(len(labels))]
    lexicon = materialise(counts.groupBy("word").agg(*rate).select("word", F.concat(*digits).alias("code")), "lexicon")
    sent = lexicon
    if lexicon.count() > LEXICON:
        ranked = Window.partitionBy("label").orderBy(F.desc("n"), "word")
        often = counts.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= max(1, LEXICON // len(labels)))
        sent, model.rest = lexicon.join(often.select("word").distinct(), "word"), lexicon
    found = sent.select(F.xxhash64("word").alias("key"), "code").toArrow()
    model.lexicon = Lexicon.of(found["key"].to_numpy(), found["code"].to_pylist())
    return model


def _code(rates: list[float]) -> str:
    """A word's shares by label in fifths, one digit each."""
    total = sum(rates)
    return "".join(str(round(x / total * 5)) for x in rates)


def _with_rest(docs: DataFrame, model: Field, sent, text_col: str) -> DataFrame:
    """``docs`` with ``__rest``: the words of each text that only the stored lexicon has, and their codes.

    Texts are named by a 64-bit hash: texts that share it get the words of both, which does no
    harm. A task asks once for the words of equal texts.
    """
    key = F.xxhash64(F.col(f"`{text_col}`").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value.lexicon, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if len(seen) > _MOST_WORDS:
                    seen.clear()
                keys, words = [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if name not in seen:
                        seen.add(name)
                        own = list(set(words_of(text.as_py())))
                        fresh = [w for w, code in zip(own, known.find(own), strict=True) if code is None]
                        keys += [name] * len(fresh)
                        words += fresh
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.binary())], ["__key", "word"])

    asked = docs.select(key.alias("__key"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    pairs = asked.mapInArrow(run, "__key long, word binary")
    found = pairs.join(model.rest, "word").groupBy("__key").agg(F.collect_set(F.struct("word", "code")).alias("__rest"))
    # Stored, so that Spark can split the join where very many texts are equal.
    return docs.withColumn("__key", key).join(materialise(found, "rest"), "__key", "left").drop("__key")


def _together(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of texts in parts of about ``_WORDS``, with the place of each part's first text."""
    first, texts, held = 0, [], 0
    for place, text in enumerate(column):
        words = words_of(text.as_py())
        if texts and held + len(words) > _WORDS:
            yield first, texts
            first, texts, held = place, [], 0
        texts.append(words)
        held += len(words)
    if texts:
        yield first, texts


def predict(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; whole texts are read.

    A null text and one without a letter get ``und`` and 0, as does any text if no language
    was learned. Equal shares go to the first label by code point. Columns of ``docs`` with
    the new names are replaced; others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    columns, inputs = docs.columns, [text_col]
    if model.rest is not None:
        docs, inputs = _with_rest(docs, model, sent, text_col), [text_col, "__rest"]
    fields = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def make():
        labeller = Labeller(sent.value)
        labels = sent.value.labels

        def step(batch: pa.RecordBatch) -> list:
            names, scores = [], []
            for at, texts in _together(batch.column(0)):
                more = {}
                for found in batch.column(1)[at : at + len(texts)].to_pylist() if len(inputs) > 1 else ():
                    more.update((r["word"], r["code"]) for r in found or ())
                for words, share in zip(texts, labeller.shares(texts, more), strict=True):
                    known = bool(words) and bool(labels)
                    best = int(share.argmax()) if known else 0
                    names.append(labels[best] if known else UNKNOWN)
                    scores.append(min(1.0, float(share[best])) if known else 0.0)
            return [names, scores]

        return step

    return add_columns(docs, inputs, fields, make, columns)


def _remainder(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


@query()
def op3_language_id(spark, sf_dir):
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(_remainder("doc_id") != 1))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def drop_unclear_languages(docs: DataFrame, id_col: str = "doc_id", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a learned language and a score of at least ``least``."""
    model = train(docs.where(_remainder(id_col) != 1))
    fresh = {name: f"__own_{name}" for name in ("lang_pred", "score") if name in docs.columns}
    found = predict(docs.withColumnsRenamed(fresh), model)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in fresh.items()}).select(*[f"`{c}`" for c in docs.columns])
