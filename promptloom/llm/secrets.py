"""Secret scans: sliding-window Shannon entropy per character class, besides fixed patterns.

Candidate strings are long runs of letters, digits and ``+/_=-``. In each candidate, runs of a
character class are read with a window of ``WINDOW`` characters; the counts of the characters
in the window change by one character in and one out, and the entropy with them. Windows above
the threshold of the class, joined where they overlap, are a secret. What the allow-list
matches, what has no digit or no letter, and what overlaps a fixed pattern is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from promptloom.llm.common import table
from promptloom.llm.registry import query
from promptloom.llm.spans import Span, digest_columns, find_spans, overlaps

KINDS = ("assign", "access", "hex")
ADDED = "entropy"
WINDOW = 20

# Fixed patterns: what is matched, the group that is measured, and its least length.
PATTERNS = (
    ("assign", re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 8),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(rb"[0-9a-f]{32,}"), 0, 32),
)
# Character classes with the entropy in bits that a window must reach. A random window of 20
# characters has about 3.4 bits over 16 characters and 4.1 over 64; prose stays below 3.7.
CLASSES = (
    ("hex", re.compile(rb"[0-9a-f]{20,}|[0-9A-F]{20,}"), 3.0),
    ("base64", re.compile(rb"[A-Za-z0-9+/_=-]{20,}"), 3.85),
)
# Long strings that are no secrets: numbers in groups, identifiers in the usual 8-4-4-4-12
# form, checksums named as such, paths and names made of words.
ALLOWED = (
    rb"[0-9=_/+-]+",
    rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    rb"(sha(1|224|256|384|512)|md5)[-=_].*",
    rb"[A-Za-z]{2,}([/_=+-][A-Za-z]{2,}|[/_=+-][0-9]{1,4})+",
)

_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def window_entropies(run: bytes, window: int = WINDOW) -> Iterator[float]:
    """Entropy in bits of each window of ``run``, by counts that change by one at each step."""
    term = _TERM if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts = [0] * 256
    total = 0.0  # sum of n log n over the window's characters
    for at, char in enumerate(run):
        if at >= window:
            gone = run[at - window]
            total += term[counts[gone] - 1] - term[counts[gone]]
            counts[gone] -= 1
        total += term[counts[char] + 1] - term[counts[char]]
        counts[char] += 1
        if at >= window - 1:
            yield math.log2(window) - total / window


class Scanner:
    """Finds fixed patterns and high-entropy strings in one text."""

    def __init__(self, allowed: Sequence[bytes] = ALLOWED):
        self.allowed = re.compile(b"|".join(b"(?:%s)" % x for x in allowed)) if allowed else None

    def base(self, text: bytes) -> list[Span]:
        return [
            (kind, m.start(), m.end())
            for kind, pattern, group, least in PATTERNS
            for m in pattern.finditer(text)
            if m.end(group) - m.start(group) >= least
        ]

    def entropy(self, text: bytes, base: list[Span]) -> list[Span]:
        found: list[Span] = []
        for candidate in CLASSES[-1][1].finditer(text):
            value, offset = candidate.group(), candidate.start()
            if not re.search(rb"[0-9]", value) or not re.search(rb"[A-Za-z]", value):
                continue
            if self.allowed and self.allowed.fullmatch(value):
                continue
            for _, pattern, least in CLASSES:
                for run in pattern.finditer(value):
                    for start, stop in _high(run.group(), least):
                        part = run.group()[start:stop]
                        a, b = offset + run.start() + start, offset + run.start() + stop
                        mixed = re.search(rb"[0-9]", part) and re.search(rb"[A-Za-z]", part)
                        if mixed and not overlaps(a, b, base) and not overlaps(a, b, found):
                            found.append((ADDED, a, b))
        return found

    def __call__(self, text: bytes) -> tuple[list[Span], list[Span]]:
        base = self.base(text)
        return base, self.entropy(text, base)


def _high(run: bytes, least: float) -> list[list[int]]:
    """Ranges of ``run`` that windows of at least that entropy cover."""
    ranges: list[list[int]] = []
    for start, bits in enumerate(window_entropies(run)):
        if bits >= least:
            if ranges and start <= ranges[-1][1]:
                ranges[-1][1] = start + WINDOW
            else:
                ranges.append([start, start + WINDOW])
    return ranges


def find_secrets(docs: DataFrame, text_col: str = "text", allowed: Sequence[bytes] = ALLOWED) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (kind, start, stop in code points).

    A null or empty text has none. Spans of the fixed patterns are always there; they may
    overlap each other, entropy spans overlap nothing. Every row is judged for itself, so
    repeated rows get equal spans. Columns with the new names are replaced; others stay.
    """
    return find_spans(docs, text_col, (*KINDS, ADDED), lambda: Scanner(allowed))


@query()
def op8_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    return digest_columns(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), KINDS)
