"""Personal data by a semi-Markov conditional random field, besides fixed patterns.

A segment is a run of tokens with one type: email, ip, card, phone, or other. Its features are
those of the whole span: its shape, lengths, digit counts, check digits, separators, and what
stands left and right of it. Dynamic programming over segments chooses boundaries and types
together. A segment is what its kinds can hold: 19 digits and any signs between them, or an
address of at most ``MOST_TOKENS`` tokens, where a mark such as ``(at)`` or ``[.]`` is one token.
Only stretches of text with digits or at-signs are decoded, as no segment lies elsewhere.

Training. Stretches are drawn by a hash from all documents: for each kind the ``STRETCHES`` of
smallest hashes among those with a match of its fixed pattern, and as many without any match,
so a kind that is rare beside others has its own share. Matches are the segments to learn. Each also teaches its
usual spellings that the patterns miss (``name (at) host (dot) com``, numbers with other
separators or without a plus sign), so the field adds such spans. What overlaps a match of a
pattern is never added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import table
from promptloom.llm.registry import query
from promptloom.llm.spans import Span, digest_columns, find_spans, overlaps
from promptloom.session import materialise, ship_package

KINDS = ("email", "ip", "card", "phone")
MOST_BYTES = 400  # longer stretches are not drawn for training
MOST_TOKENS = MOST_BYTES  # so no match that is drawn has more, nor has any spelling of it
STRETCHES, ROUNDS, BUCKETS = 250, 25, 1 << 15
_NEVER = -1e6
_SPACED = 16  # tokens of an address with blanks at other places than beside its marks

# An address in two parts, and numbers from their first digit on, so that a long run is read once.
_NAME = re.compile(rb"[A-Za-z0-9._%+-]++@")
_NEXT_NAME = re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_HOST = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(rb"[0-9]+|[A-Za-z]+|[\x80-\xff]+|[(\[{](?:at|dot|\.)[)\]}]|[^\sA-Za-z0-9\x80-\xff]", re.I)
_AT = re.compile(rb"@|[(\[{]at[)\]}]", re.I)
_CHUNK = re.compile(rb"\S+")
_MARK = re.compile(rb"[(\[{](?:at|dot)[)\]}]", re.I)
_SEED = re.compile(rb"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.I)
_DIGITS = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    """Whether the check digit is right; ``digits`` are ASCII digits."""
    values = [d - 48 for d in reversed(digits)]
    return sum(values[::2] + [2 * d - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _emails(text: bytes) -> Iterator[Span]:
    """Leftmost addresses that do not overlap. A name may begin where the match before it ended."""
    at = 0
    while name := _NAME.match(text, at) or _NEXT_NAME.search(text, at):
        host = _HOST.match(text, name.end())
        if host:
            yield "email", name.start(), host.end()
        at = host.end() if host else name.end()


def base_spans(text: bytes) -> list[Span]:
    """Matches of the fixed patterns that pass their checks, by kind."""
    found: list[Span] = []
    if b"@" in text:
        found += _emails(text)
    for m in _IP.finditer(text):
        if all(len(part := x.lstrip(b"0")) < 4 and int(part or 0) <= 255 for x in m.group().split(b".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(b" ", b"").replace(b"-", b"")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if b"+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m.group())) <= 15]
    return found


def stretches(text: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring chunks with digits, at-signs or marks; marks take their neighbours in."""
    if not _SEED.search(text):
        return
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    inside = [bool(_SEED.search(text, a, b)) for a, b in chunks]
    marks = [bool(flag and _MARK.search(text, a, b)) for flag, (a, b) in zip(inside, chunks, strict=True)]
    start = None
    for i, (a, b) in enumerate(chunks):
        near = inside[i] or i and marks[i - 1] or i + 1 < len(chunks) and marks[i + 1]
        if near and start is None:
            start = a
        if near:
            stop = b
        elif start is not None:
            yield start, stop
            start = None
    if start is not None:
        yield start, stop


def _code(*parts) -> int:
    return zlib.crc32(repr(parts).encode()) % BUCKETS


def _shape(span: bytes) -> bytes:
    return re.sub(rb"[A-Za-z\x80-\xff]+", b"a", re.sub(rb"[0-9]+", b"0", re.sub(rb"\s+", b" ", span)))


def span_features(text: bytes, start: int, stop: int) -> list[int]:
    """Buckets of the features of one span of ``text``."""
    span = text[start:stop]
    digits = b"".join(_DIGITS.findall(span))
    groups = re.findall(rb"[0-9]+", span)
    shape = _shape(span)
    byte_groups = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    at_mark = span.count(b"@") + len(re.findall(rb"[(\[{]at[)\]}]", span, re.I))
    dots = span.count(b".") + len(re.findall(rb"[(\[{]dot[)\]}]", span, re.I))
    left, right = text[max(0, start - 1) : start], text[stop : stop + 1]
    return [
        _code("shape", shape[:40]),
        _code("digits", min(len(digits), 20)),
        _code("groups", tuple(len(g) for g in groups)[:8]),
        _code("bytes", byte_groups, bool(re.search(rb"[A-Za-z]", span)), len(groups)),
        _code("check", 13 <= len(digits) <= 19 and luhn(digits), 13 <= len(digits) <= 19, b"a" in shape),
        _code("at", min(at_mark, 2), min(dots, 4), bool(digits)),
        _code("plus", span[:1] == b"+", 10 <= len(digits) <= 15, b"a" in shape, at_mark > 0),
        _code("ends", _shape(span[:1]), _shape(span[-1:])),
        _code("left", _shape(left) if left.strip() else b"", _shape(span[:1])),
        _code("right", _shape(right) if right.strip() else b"", _shape(span[-1:])),
        _code("signs", bytes(sorted(set(re.sub(rb"[0-9A-Za-z\x80-\xff\s]", b"", span))))[:8]),
        _code("bias"),
    ]


def _possible(span: bytes) -> list[bool]:
    """Kinds that the digits and signs of a span do not rule out."""
    digits, letters = b"".join(_DIGITS.findall(span)), bool(re.search(rb"[A-Za-z\x80-\xff]", span))
    groups = re.findall(rb"[0-9]+", span)
    return [
        letters and bool(_AT.search(span)),
        not letters and len(groups) == 4 and all(len(part := g.lstrip(b"0")) < 4 and int(part or 0) < 256 for g in groups),
        not letters and 13 <= len(digits) <= 19 and luhn(digits),
        not letters and (10 <= len(digits) <= 15 or 15 < len(digits) <= 17 and digits[:2] == b"00"),
    ]


def _segments(
    text: bytes, start: int, stop: int, taken: Sequence[tuple[int, int]] = ()
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens of a stretch, and the runs of tokens (first, one past the last) that may be entities.

    A run of digits and signs ends with a group of digits and holds up to 19 digits or four
    groups. Others hold one at-sign or mark of it, and no sign that addresses do not have. No
    run has a token in the ``taken`` ranges, which are sorted and apart.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, start, stop)]
    count = len(tokens)
    wall, number = [], 0
    for a, b in tokens:
        while number < len(taken) and taken[number][1] <= a:
            number += 1
        wall.append(number < len(taken) and taken[number][0] < b)
    heads = [text[a] for a, _ in tokens]
    digit = [48 <= h <= 57 for h in heads]
    at = [bool(_AT.match(text, a)) for a, _ in tokens]
    mark = [at[i] or b - a > 1 and text[a : a + 1] in b"([{" for i, (a, b) in enumerate(tokens)]
    word = [h >= 128 or chr(h).isalpha() or mark[i] and text[tokens[i][0] + 1 : tokens[i][0] + 2].isalpha() for i, h in enumerate(heads)]
    glued = [i > 0 and (tokens[i - 1][1] == tokens[i][0] or mark[i - 1] or mark[i]) for i in range(count)]
    runs = []
    following = [count] * (count + 1)  # the next group of digits, or a letter
    next_at = [count] * (count + 2)
    next_wall = [count] * (count + 1)
    no_address = [count] * (count + 1)  # the next token that is in no address
    for i in range(count - 1, -1, -1):
        following[i] = i if digit[i] or word[i] else following[i + 1]
        next_at[i] = i if at[i] else next_at[i + 1]
        next_wall[i] = i if wall[i] else next_wall[i + 1]
        fits = digit[i] or word[i] or mark[i] or heads[i] in b"@._%+-()[]{}"
        no_address[i] = no_address[i + 1] if fits and not wall[i] else i
    for i in range(count):
        if wall[i]:
            continue
        if digit[i] or heads[i] in b"+(" and not mark[i] and following[i] - i <= 2:
            digits = groups = 0
            j, limit = following[i], next_wall[i]
            while j < limit and digit[j]:
                digits, groups = digits + tokens[j][1] - tokens[j][0], groups + 1
                if digits > 19 and groups > 4:
                    break
                if j > i or digits >= 7:
                    runs.append((i, j + 1))
                j = following[j + 1]
        limit = min(no_address[i], next_at[next_at[i] + 1], i + MOST_TOKENS)
        if next_at[i] < limit and not mark[i] and (digit[i] or word[i] or heads[i] in b"._%+-("):
            whole = True
            for j in range(i + 1, limit):
                whole = whole and glued[j]
                if not whole and (j >= i + _SPACED or next_at[i] >= i + _SPACED):
                    break
                if j > next_at[i] and (digit[j] or heads[j] < 128 and word[j] and not mark[j] or heads[j] == 45):
                    runs.append((i, j + 1))
    return tokens, sorted(set(runs))


@dataclass
class SpanField:
    """A fitted semi-Markov field: weights by feature and kind, and moves between segment types."""

    weights: np.ndarray = field(repr=False)  # BUCKETS x kinds
    moves: np.ndarray = field(repr=False)  # types x types, the last type is "other"
    skipped: int = 0  # training cases with a span that is no segment

    def scores(self, text: bytes, places: list[tuple[int, int]]) -> np.ndarray:
        """Scores of the spans at ``places`` by kind; impossible kinds are out of reach."""
        lists = [span_features(text, a, b) for a, b in places]
        starts = np.cumsum([0, *map(len, lists[:-1])])
        found = np.add.reduceat(self.weights[list(chain.from_iterable(lists))], starts, axis=0)
        return np.where([_possible(text[a:b]) for a, b in places], found, _NEVER)

    def decode(self, count: int, runs: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """Best segmentation of ``count`` tokens: ``(first, stop, kind)`` of its entities.

        ``runs`` are sorted. Tokens outside of them are no entities, so what lies between such
        tokens is decoded for itself, and the work grows with the runs and not with the tokens.
        """
        found, begin = [], 0
        while begin < len(runs):
            low, high = runs[begin]
            end = begin + 1
            while end < len(runs) and runs[end][0] <= high:
                high, end = max(high, runs[end][1]), end + 1
            part = [(a - low, b - low) for a, b in runs[begin:end]]
            for first, stop, kind in self._decode_part(high - low, part, scores[begin:end], high < count):
                found.append((first + low, stop + low, kind))
            begin = end
        return found

    def _decode_part(self, count: int, runs: list[tuple[int, int]], scores: np.ndarray, more: bool) -> list[tuple[int, int, int]]:
        """``decode`` of all tokens together; with ``more``, a token that is no entity follows."""
        other = len(KINDS)
        ending: dict[int, list[int]] = {}
        for number, (_, stop) in enumerate(runs):
            ending.setdefault(stop, []).append(number)
        best = np.full((count + 1, other + 1), -np.inf)
        best[0, other] = 0.0
        back: list[list] = [[None] * (other + 1) for _ in range(count + 1)]
        for at in range(1, count + 1):
            step = best[at - 1] + self.moves[:, other]
            before = int(step.argmax())
            best[at, other], back[at][other] = step[before], (at - 1, before)
            for number in ending.get(at, ()):
                first = runs[number][0]
                step = best[first][:, None] + self.moves[:, :other] + scores[number]
                befores = step.argmax(0)
                for kind in range(other):
                    value = step[befores[kind], kind]
                    if value > best[at, kind]:
                        best[at, kind], back[at][kind] = value, (first, int(befores[kind]))
        found, at, kind = [], count, int((best[count] + self.moves[:, other] * more).argmax())
        while at:
            first, before = back[at][kind]
            if kind != other:
                found.append((first, at, kind))
            at, kind = first, before
        return found[::-1]


def _expected(
    counts: np.ndarray, owner: np.ndarray, places: np.ndarray, scores: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each run and kind, and expected moves, by forward-backward over all cases at once.

    ``counts`` are the tokens of the cases and fall from case to case; ``owner`` is the case of
    each run and ``places`` its first token and the one past its last.
    """
    other, most = len(KINDS), int(counts.max(initial=0))
    firsts, stops = places[:, 0], places[:, 1]
    active = np.searchsorted(-counts, -np.arange(most + 2), side="right")  # cases of so many tokens or more
    by_stop, by_first = np.lexsort((owner, stops)), np.lexsort((owner, firsts))
    stop_at = np.searchsorted(stops[by_stop], np.arange(most + 2))
    first_at = np.searchsorted(firsts[by_first], np.arange(most + 2))
    ahead = np.full((most + 1, len(counts), other + 1), -np.inf)
    ahead[0, :, other] = 0.0
    for at in range(1, most + 1):
        now = active[at]
        ahead[at, :now, other] = np.logaddexp.reduce(ahead[at - 1, :now] + moves[:, other], axis=1)
        own = by_stop[stop_at[at] : stop_at[at + 1]]
        if len(own):
            value = np.logaddexp.reduce(ahead[firsts[own], owner[own]][:, :, None] + moves[:, :other], axis=1) + scores[own]
            cases, starts = np.unique(owner[own], return_index=True)
            ahead[at, cases, :other] = np.logaddexp.reduceat(value, starts, axis=0)
    behind = np.full_like(ahead, -np.inf)
    behind[counts, np.arange(len(counts))] = 0.0
    whole = np.logaddexp.reduce(ahead[counts, np.arange(len(counts))], axis=1)
    chances, steps = np.zeros_like(scores), np.zeros_like(moves)
    for at in range(most - 1, -1, -1):
        now = active[at + 1]
        total = moves[:, other] + behind[at + 1, :now, other][:, None]
        steps[:, other] += np.exp(ahead[at, :now] + total - whole[:now, None]).sum(0)
        own = by_first[first_at[at] : first_at[at + 1]]
        if len(own):
            value = moves[:, :other] + (scores[own] + behind[stops[own], owner[own], :other])[:, None, :]
            joint = np.exp(ahead[at, owner[own]][:, :, None] + value - whole[owner[own]][:, None, None])
            chances[own] = joint.sum(1)
            steps[:, :other] += joint.sum(0)
            cases, starts = np.unique(owner[own], return_index=True)
            more = np.logaddexp.reduceat(np.logaddexp.reduce(value, axis=2), starts, axis=0)
            total[cases] = np.logaddexp(total[cases], more)
        behind[at, :now] = total
    return chances, steps


def _spellings(kind: str, span: bytes) -> list[bytes]:
    """Other ways to write a match, as people do to get past patterns."""
    if kind == "email":
        name, _, host = span.partition(b"@")
        return [
            name + b" (at) " + host.replace(b".", b" (dot) "),
            name + b"[at]" + host.replace(b".", b"[dot]"),
            name + b" [at] " + host,
        ]
    if kind == "ip":
        return [span.replace(b".", b"[.]"), span.replace(b".", b"(.)")]
    digits = b"".join(_DIGITS.findall(span))
    if kind == "card":
        return [sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sign in (b".", b"/", b"  ")]
    return [span[1:], span[1:].replace(b" ", b"-"), b"00" + span[1:], span.replace(b" ", b"/")]


def _spelled(kind: str, span: bytes) -> Iterator[tuple[bytes, int, int, list[Span]]]:
    """Cases of other spellings of a match, each in the stretch that is decoded around it."""
    for other in _spellings(kind, span):
        text, stop = b"x " + other + b" x", 2 + len(other)
        around = next((s for s in stretches(text) if s[0] <= 2 and s[1] >= stop), (2, stop))
        yield text, *around, [(kind, 2, stop)]


def training_cases(drawn: list[tuple[bytes, int, int]], plain: bool = True) -> list[tuple[bytes, int, int, list[Span]]]:
    """``text, start, stop, spans`` of other spellings, and with ``plain`` of the stretches with their matches."""
    cases = []
    for text, start, stop in drawn:
        spans: list[Span] = []
        for span in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
            if span[1] >= start and span[2] <= stop and not overlaps(span[1], span[2], spans):
                spans.append(span)
        if plain:
            cases.append((text, start, stop, spans))
        for kind, a, b in spans:
            cases += _spelled(kind, text[a:b])
    return cases


def fit(drawn: list[tuple[bytes, int, int]], rounds: int = ROUNDS) -> SpanField:
    """Maximum likelihood with a quadratic penalty, by adaptive gradient steps over all stretches."""
    kinds, other = len(KINDS), len(KINDS)
    model = SpanField(np.zeros((BUCKETS, kinds)), np.zeros((kinds + 1, kinds + 1)))
    made = []
    for text, start, stop, spans in training_cases(drawn):
        tokens, runs = _segments(text, start, stop)
        places = {(tokens[i][0], tokens[j - 1][1]): n for n, (i, j) in enumerate(runs)}
        truth = np.zeros((len(runs), kinds))
        path, at = np.zeros_like(model.moves), 0
        before = other
        if any((a, b) not in places for _, a, b in spans):
            model.skipped += 1
            continue
        for kind, a, b in spans:
            number = places[a, b]
            truth[number, KINDS.index(kind)] = 1
            for now in [other] * (runs[number][0] - at) + [KINDS.index(kind)]:
                path[before, now] += 1
                before = now
            at = runs[number][1]
        for now in [other] * (len(tokens) - at):
            path[before, now] += 1
            before = now
        lists = [span_features(text, tokens[i][0], tokens[j - 1][1]) for i, j in runs]
        possible = np.array([_possible(text[tokens[i][0] : tokens[j - 1][1]]) for i, j in runs]).reshape(-1, kinds)
        made.append((len(tokens), runs, lists, truth, path, possible))
    if not any(case[3].any() for case in made):
        model.weights[_code("bias")] = -30.0  # nothing to learn from: nothing is added
        return model
    made.sort(key=lambda case: -case[0])
    flat = np.fromiter(chain.from_iterable(f for case in made for f in case[2]), np.int64)
    owner = np.repeat(np.arange(sum(len(c[1]) for c in made)), [len(f) for case in made for f in case[2]])
    truth, possible = (np.concatenate([case[i] for case in made]) for i in (3, 5))
    counts, cases = np.array([case[0] for case in made]), np.repeat(np.arange(len(made)), [len(case[1]) for case in made])
    runs = np.array([run for case in made for run in case[1]], np.int64).reshape(-1, 2)
    seen = sum(case[4] for case in made)
    past_w, past_m = np.full_like(model.weights, 1e-8), np.full_like(model.moves, 1e-8)
    for _ in range(rounds):
        scores = np.stack([np.bincount(owner, model.weights[flat, k], len(truth)) for k in range(kinds)], 1)
        scores = np.where(possible, scores, _NEVER)
        chances, steps = _expected(counts, cases, runs, scores, model.moves)
        gap = truth - chances
        up_w = np.stack([np.bincount(flat, gap[owner, k], BUCKETS) for k in range(kinds)], 1) - 0.02 * model.weights
        up_m = seen - steps - 0.02 * model.moves
        past_w += up_w**2
        past_m += up_m**2
        model.weights += 0.5 * up_w / np.sqrt(past_w)
        model.moves += 0.5 * up_m / np.sqrt(past_m)
    return model


def _drawn(docs: DataFrame, text_col: str, many: int) -> list[tuple[bytes, int, int]]:
    """Stretches with a little text around them: those of the smallest hashes for each kind and without matches."""
    groups = range(len(KINDS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[set[tuple[int, bytes, int, int]]] = [set() for _ in groups]
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or b""
                spans = None
                for a, b in stretches(text):
                    if b - a > MOST_BYTES:
                        continue
                    spans = base_spans(text) if spans is None else spans
                    low, high = max(0, a - 20), min(len(text), b + 20)
                    part = text[low:high]
                    row = (xxhash.xxh64_intdigest(part) >> 1, part, a - low, b - low)
                    for group in {KINDS.index(k) for k, x, y in spans if x >= a and y <= b} or {len(KINDS)} - {
                        len(KINDS) for _, x, y in spans if x < b and a < y
                    }:
                        best[group].add(row)
                        if len(best[group]) > 4 * many:
                            best[group] = set(sorted(best[group])[:many])
        rows = [(group, *row) for group in groups for row in sorted(best[group])[:many]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
            ["group", "hash", "part", "start", "stop"],
        )

    texts = docs.where(F.col(text_col).rlike(r"[0-9@(\[{]")).select(F.col(text_col).cast("binary"))
    found = materialise(texts.mapInArrow(run, "group long, hash long, part binary, start long, stop long"), "stretches")
    rows = {}
    for group in groups:
        part = found.where(F.col("group") == group).distinct().orderBy("hash", "part", "start", "stop").limit(many)
        rows.update(dict.fromkeys((bytes(r["part"]), r["start"], r["stop"]) for r in part.collect()))
    return list(rows)


def recall(model: SpanField, drawn: list[tuple[bytes, int, int]]) -> dict[str, tuple[int, int]]:
    """By kind, how many other spellings of the matches in ``drawn`` are found with their ends, and of how many.

    Spellings that a fixed pattern matches are not counted.
    """
    find, result = Finder(model), {kind: (0, 0) for kind in KINDS}
    for text, _, _, spans in training_cases(drawn, plain=False):
        base, added = find(text)
        if not base:
            right, total = result[spans[0][0]]
            result[spans[0][0]] = right + (spans[0] in added), total + 1
    return result


def train(docs: DataFrame, text_col: str = "text", many: int = STRETCHES) -> SpanField:
    """A field fitted to stretches of all documents; it adds nothing if no pattern matches anywhere."""
    ship_package(docs.sparkSession)
    return fit(_drawn(docs, text_col, many))


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """The ranges that spans cover, sorted and apart."""
    ranges: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=itemgetter(1)):
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
        else:
            ranges.append((a, b))
    return ranges


class Finder:
    """Finds the fixed patterns and what the field adds in one text."""

    def __init__(self, model: SpanField):
        self.model = model

    def __call__(self, text: bytes) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        added: list[Span] = []
        taken = _union(base)
        for start, stop in stretches(text):
            near = taken[bisect_right(taken, start, key=itemgetter(1)) : bisect_left(taken, stop, key=itemgetter(0))]
            tokens, runs = _segments(text, start, stop, near)
            runs = [r for r in runs if any(_possible(text[tokens[r[0]][0] : tokens[r[1] - 1][1]]))]
            if runs:
                scores = self.model.scores(text, [(tokens[i][0], tokens[j - 1][1]) for i, j in runs])
                for first, last, kind in self.model.decode(len(tokens), runs, scores):
                    added.append((KINDS[kind], tokens[first][0], tokens[last - 1][1]))
        return base, added


def find_personal_data(docs: DataFrame, model: SpanField, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (kind, start, stop in code points).

    A null or empty text has none. Matches of the fixed patterns are always there and may
    overlap each other; added spans overlap nothing. Every row is judged for itself, so
    repeated rows get equal spans. Columns with the new names are replaced; others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return find_spans(docs, text_col, KINDS, lambda: Finder(sent.value))


@query()
def op4_personal_data(spark, sf_dir):
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_columns(find_personal_data(docs, train(docs)), KINDS)
