"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, {extra} string"
WORDS = "the of and to in that with for from this words over stone river cloud green seven morning table window".split()


def prose(seed: int, count: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (draw.choice("abcdefg") * (draw.random() < 0.3)) for _ in range(count))


def documents(spark, extra: str = "extra"):
    """Nulls in every column, empty, blank and very long texts, copies, ties and repeated rows."""
    passage = prose(900, 60)
    rows = [
        (1, prose(1, 80), "en", "a", 1, "x"),
        (2, prose(1, 80), "en", "a", 1, "x"),  # a copy
        (3, prose(1, 80) + " end", "en", None, 1, None),  # a near copy
        (4, prose(4, 30) + " " + passage + " " + prose(5, 30), "en", "b", 1, "x"),
        (5, prose(6, 50) + " " + passage, "en", "b", 1, "x"),
        (6, passage, None, "b", None, "x"),
        (7, "", "en", "c", 0, "x"),
        (8, None, None, None, None, None),
        (9, " \t\n\x0b\x0c\r ", "en", "c", 0, "x"),
        (10, "one two", "en", "c", 1, "x"),
        (11, "One TWO", "en", "c", 1, "x"),
        (12, "\n".join([prose(12, 4)] * 30), "en", "c", 1, "x"),
        (13, prose(13, 30_000), "en", "long", 1, "x"),
        (14, "é ü ñ ß " + prose(14, 40), "fr", "d", 1, "x"),
        (15, "12345 --- 67", "en", "d", 1, "x"),
        (16, prose(16, 40), "en", "d", 1, "x"),
        (16, prose(16, 40), "en", "d", 1, "x"),  # a repeated row
        (16, prose(17, 40), "en", "d", 1, "x"),  # an id with another text
        (None, prose(1, 80), "en", "e", 1, "x"),
        (20, prose(20, 13), "en", "e", 1, "x"),
        (21, prose(20, 12), "en", "e", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS.format(extra=extra)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS.format(extra="extra"))


def benchmark(spark):
    rows = [(1, prose(900, 60)), (2, "One two"), (None, prose(14, 40)), (3, None), (4, ""), (5, "..."), (1, prose(4, 30)), (12, "67")]
    return spark.createDataFrame(rows, "item_id long, text string")
