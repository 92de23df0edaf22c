"""Toxicity behind obfuscation: a noisy channel, then a score of the restored text.

A disguised word is read as a lattice of characters: a sign or digit stands for the letters it
resembles, a repeated letter for one or two, letters set apart for a word or for several. The
Viterbi path of highest probability under a character language model, times the channel's, is
the restored word. A word whose lattice has one path only is its own restoration.

The language model has the counts of all character trigrams of all words of all documents, made
by Spark. The score is a logistic regression on the words and beginnings of words that a text
holds. Which of these count for anything is decided from counts over all labelled training
texts, with no limit to their number; the weights are fitted to a sample of ``SAMPLE``
labelled texts per label, drawn by a hash. A feature too rare to stand in the sample has the
lower bound of its log ratio in the counts as its weight. Both models are sent to the tasks
whole, so their memory grows with the numbers of trigrams and of features with evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import add_columns, table
from promptloom.llm.registry import query
from promptloom.session import materialise, ship_package

SAMPLE, LEAST_TEXTS = 2500, 3
LEAST_EVIDENCE = 3.0  # standard errors by which a feature's shares must differ: many features are looked at

PENALTY = 1e-4

# What a sign may stand for, besides itself.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou",
}
_DISGUISED, _SAME, _BREAK = math.log(0.3), math.log(0.02), math.log(0.05)

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
_SIGN = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$")
# Four letters or more, each set apart by the same kind of sign.
_APART = re.compile(
    rb"(?<![a-z0-9\x80-\xff])(?:(?:[a-z0-9@$]|[\xc3-\xc5][\x80-\xbf])[ ._*-]){3,}(?:[a-z0-9@$]|[\xc3-\xc5][\x80-\xbf])(?![a-z0-9\x80-\xff])"
)
_MOST_TOKENS = 300_000  # tokens whose features a task remembers


@dataclass
class CharModel:
    """Log probabilities of a character after two others; a blank stands for the edge of a word."""

    trigrams: dict[str, float] = field(repr=False)
    bigrams: dict[str, float] = field(repr=False)
    least: float

    def __call__(self, before: str, char: str) -> float:
        value = self.trigrams.get(before + char)
        if value is None:
            value = self.bigrams.get(before[1] + char, self.least) - 1.5
        return value


def char_model(counts: dict[str, int]) -> CharModel:
    after, pairs, firsts = Counter(), Counter(), Counter()
    for gram, n in counts.items():
        after[gram[:2]] += n
        pairs[gram[1:]] += n
        firsts[gram[1]] += n
    trigrams = {g: math.log(n / after[g[:2]]) for g, n in counts.items()}
    bigrams = {g: math.log(n / firsts[g[0]]) for g, n in pairs.items()}
    return CharModel(trigrams, bigrams, math.log(1.0 / (10 + sum(firsts.values()))))


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """Per place of a disguised word the strings it may stand for, with the channel's log probability.

    A string of letters set apart has the places of its signs in between: nothing, or a break.
    """
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(text):
        char, stop = text[at], at + 1
        while stop < len(text) and text[stop] == char:
            stop += 1
        looks = [(c, _DISGUISED) for c in LOOKS_LIKE.get(char, "")]
        if char == " ":
            places.append([("", 0.0), (" ", _BREAK)])
        elif stop - at >= 3:
            single = looks or [(char, 0.0)]
            places.append([(c * n, p + math.log(0.5)) for c, p in single for n in (1, 2)])
        else:
            options = looks + [(char, _SAME if looks else 0.0)]
            places += [options] * (stop - at)
        at = stop
    return places


def viterbi(places: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The most probable string through the lattice."""
    # The state is the last two characters; each keeps its best score and the string so far.
    states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    for options in places:
        reached: dict[str, tuple[float, str]] = {}
        for before, (score, text) in states.items():
            for piece, channel in options:
                value, context = score + channel, before
                for char in piece:
                    if char == " ":
                        value += model(context, " ")
                        context = "  "
                    else:
                        value += model(context, char)
                        context = context[1] + char
                if context not in reached or value > reached[context][0]:
                    reached[context] = (value, text + piece)
        states = reached
    return max(((score + model(before, " "), text) for before, (score, text) in states.items()), default=(0.0, ""))[1]


def restore(token: str, model: CharModel) -> str | None:
    """The restored form of one lower-cased token, or None if it is not disguised."""
    core = token.strip(_EDGES)
    signs = _SIGN.search(core) and _LETTER.search(core)
    if not signs and not _REPEAT.search(core):
        return None
    return viterbi(lattice(core), model)


def _trigram_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Counter()
            for value in batch.column(0):
                words.update((value.as_py() or "").lower().encode().translate(_LETTERS).split())
            grams = Counter()
            for word, n in words.items():
                padded = "  " + word.decode("utf-8", "replace") + " "
                for at in range(len(padded) - 2):
                    grams[padded[at : at + 3]] += n
            keys = list(grams)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([grams[k] for k in keys], pa.int64())], ["gram", "n"])

    return docs.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train_char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts of all trigrams over all texts."""
    ship_package(docs.sparkSession)
    counts = _trigram_counts(docs.select(text_col)).toArrow()
    return char_model(dict(sorted(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True))))


class Reader:
    """Features of restored texts: numbers of words and of beginnings of words.

    With ``wanted`` only those of them; most tokens then have none and cost a look-up.
    """

    def __init__(self, model: CharModel, wanted: set[int] | None = None):
        self.model, self.wanted = model, wanted
        self.known: set[bytes] = set()
        self.telling: set[bytes] = set()  # the known tokens that have features
        self.own: dict[bytes, tuple[int, ...]] = {}

    def _of(self, words: Iterable[str]) -> tuple[int, ...]:
        found = set()
        for word in words:
            found.add(xxhash.xxh64_intdigest(word) >> 1)
            for n in (4, 5):
                if len(word) > n:
                    found.add(xxhash.xxh64_intdigest(word[:n], n) >> 1)
        return tuple(found if self.wanted is None else found & self.wanted)

    def _token(self, token: bytes) -> tuple[int, ...]:
        text = token.decode("utf-8", "replace")
        words = token.translate(_LETTERS).decode("utf-8", "replace").split()
        restored = restore(text, self.model)
        return self._of(words if restored is None else [*words, *restored.split()])

    def features(self, text: str | None) -> set[int]:
        lower = (text or "").lower().encode()
        found: set[int] = set()
        if len(self.known) > _MOST_TOKENS:
            for kept in (self.known, self.telling, self.own):
                kept.clear()
        tokens = set(lower.split())
        for token in tokens - self.known:
            self.known.add(token)
            if own := self._token(token):
                self.telling.add(token)
                self.own[token] = own
        for token in tokens & self.telling:
            found.update(self.own[token])
        for match in _APART.finditer(lower):
            letters = re.sub(r"[ ._*-]", " ", match.group().decode("utf-8", "replace"))
            found.update(self._of(viterbi(lattice(letters), self.model).split()))
        return found


@dataclass
class ToxicModel:
    chars: CharModel = field(repr=False)
    weights: dict[int, float] = field(repr=False)
    bias: float = -30.0

    def score(self, features: set[int]) -> float:
        total = self.bias + sum(self.weights[f] for f in features & self.weights.keys())
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))


def _feature_counts(labelled: DataFrame, chars) -> DataFrame:
    """``feature, toxic, clean``: texts of each label that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars.value)
        for batch in batches:
            counts = (Counter(), Counter())
            for value, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label].update(reader.features(value.as_py()))
            keys = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                arrays = [pa.array(part, pa.int64()), *(pa.array([c[k] for k in part], pa.int64()) for c in (counts[1], counts[0]))]
                yield pa.RecordBatch.from_arrays(arrays, ["feature", "toxic", "clean"])

    parts = labelled.select("text", "label").mapInArrow(run, "feature long, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _sampled(labelled: DataFrame, chars, features) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars.value, features.value)
        for batch in batches:
            held = [sorted(reader.features(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(held, pa.list_(pa.int64()))], ["label", "features"])

    return labelled.select("text", "label").mapInArrow(run, "label int, features array<long>")


def _fit(rows: list[tuple[int, list[int]]], chosen: list[int], share: float, rounds: int = 300) -> tuple[dict[int, float], float]:
    """Logistic regression with an absolute penalty; each label has the weight of its share."""
    names = {f: i for i, f in enumerate(chosen)}
    flat = np.array([names[f] for _, fs in rows for f in fs], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(fs) for _, fs in rows])
    label = np.array([x for x, _ in rows], float)
    even = np.where(label == 1, share / max(label.sum(), 1), (1 - share) / max((1 - label).sum(), 1))
    weights, bias = np.zeros(len(chosen)), math.log(share / (1 - share))
    past_w, past_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(rounds):
        total = bias + np.bincount(owner, weights[flat], len(rows))
        gap = even * (label - 1 / (1 + np.exp(-np.clip(total, -50, 50))))
        up = np.bincount(flat, gap[owner], len(chosen))
        past_w += up**2
        past_b += gap.sum() ** 2
        step = 0.2 / np.sqrt(past_w)
        weights += step * up
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * PENALTY, 0)
        bias += 0.2 * gap.sum() / math.sqrt(past_b)
    return {f: w for f, w in zip(chosen, weights.tolist(), strict=True) if w}, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A model from all texts of ``docs`` and the labels 0 and 1 of some of them.

    Other labels and null are left out; of several labels for one id the largest counts.
    Without texts of both labels every score is next to 0 (or to 1 if all are toxic).
    """
    spark = docs.sparkSession
    chars = train_char_model(docs, text_col)
    sent = spark.sparkContext.broadcast(chars)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Texts and labels are dealt by id at any size, so the plan for few labels is that for many.
    counts = materialise(_feature_counts(texts.join(marks.hint("merge"), "id"), sent).where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS), "features")
    number = {r["label"]: r["count"] for r in marks.join(texts.select("id"), "id").groupBy("label").count().collect()}
    toxic, clean = number.get(1, 0), number.get(0, 0)
    if not toxic or not clean:
        return ToxicModel(chars, {}, 30.0 if toxic else -30.0)
    p, q = F.col("toxic") / F.lit(toxic), F.col("clean") / F.lit(clean)
    both = (F.col("toxic") + F.col("clean")) / F.lit(toxic + clean)
    spread = F.sqrt(both * (1 - both) * F.lit(1 / toxic + 1 / clean) + 1e-12)
    evidence = (p - q) / spread
    kept = counts.where(evidence >= LEAST_EVIDENCE).select("feature", "toxic", "clean").toArrow()
    held = sorted(zip(*(kept.column(i).to_pylist() for i in range(3)), strict=True))
    chosen = spark.sparkContext.broadcast({f for f, _, _ in held})
    hashed = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    rate = F.when(F.col("label") == 1, min(1.0, SAMPLE / toxic)).otherwise(min(1.0, SAMPLE / clean))
    most = min(1.0, SAMPLE / min(toxic, clean))
    drawn = texts.where(hashed < most).join(marks.where(hashed < rate).hint("merge"), "id")
    rows = sorted((r["label"], list(r["features"])) for r in _sampled(drawn, sent, chosen).collect())
    seen = sorted({f for _, fs in rows for f in fs})
    weights, bias = _fit(rows, seen, toxic / (toxic + clean))
    own = set(seen)
    for feature, with_toxic, with_clean in held:
        if feature not in own and (weight := _ratio(with_toxic, with_clean, toxic, clean)) > 0:
            weights[feature] = weight
    return ToxicModel(chars, weights, bias)


def _ratio(with_toxic: int, with_clean: int, toxic: int, clean: int) -> float:
    """Lower bound (one side, 95 %) of the log ratio of a feature's shares among toxic and clean texts."""
    p, q = with_toxic + 0.5, with_clean + 0.5
    return math.log(p / (toxic + 1) * (clean + 1) / q) - 1.64 * math.sqrt(1 / p + 1 / q)


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); whole texts are read.

    A null or empty text has the score of a text without features. Every row is judged for
    itself. Columns of ``docs`` with the new names are replaced; others stay.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def make():
        model = sent.value
        reader = Reader(model.chars, set(model.weights))

        def step(batch: pa.RecordBatch) -> list:
            scores = [model.score(reader.features(x.as_py())) for x in batch.column(0)]
            return [scores, [int(s >= 0.5) for s in scores]]

        return step

    return add_columns(docs, [text_col], fields, make)


def _remainder(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


@query()
def op10_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from four fifths of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(_remainder("doc_id") != 0))
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder("doc_id") == 0).alias("held_out"), "score", "predicted")
