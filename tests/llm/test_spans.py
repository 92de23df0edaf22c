import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from promptloom.llm import personal, secrets
from promptloom.llm.registry import QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15],
    ]


def secret_spans(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    return [
        [m.span() for m in re.finditer(assign, text, re.I | re.A) if len(m.group(2)) >= 8],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16],
        [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32],
    ]


@pytest.mark.parametrize(("name", "kinds", "spans"), [("op4_personal_data", personal.KINDS, personal_spans), ("op8_secret_scan", secrets.KINDS, secret_spans)])
def test_base_spans_of_documents(spark, name, kinds, spans):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        found = spans(texts[row["doc_id"]] or "")
        named = [x for _, _, x in sorted((a, i, f"{kinds[i]}:{a}:{b}") for i, own in enumerate(found) for a, b in own)]
        assert [row[f"n_{k}"] for k in kinds] == [len(x) for x in found]
        assert row["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(row["spans"].split(",")) | {""}


def finder(texts):
    drawn = [(t, a, b) for t in (x.encode() for x in texts) for a, b in personal.stretches(t)]
    return personal.Finder(personal.fit(drawn))


def test_other_spellings_are_added_and_lookalikes_are_not():
    known = [f"mail to user{i}.x@host{i}.example.org today or call +1 (55{i % 10}) 555-12{10 + i} and" for i in range(20)]
    known += [f"the address 10.{i}.{2 * i}.7 and card 4111 1111 1111 1111 there in 20{10 + i} with {i} items" for i in range(20)]
    known += [f"built 20{10 + i}-0{1 + i % 9}-11 as v{i}.2 key AKIAQ{i}XYZ with part 12{i}-77 and {i * 997}" for i in range(20)]
    find = finder(known)
    text = b"\xc3\xa9 ask joe.doe (at) example (dot) com, or 10[.]0[.]0[.]12 in 2031-02-04 with 4111.1111.1111.1111 now"
    base, added = find(text)
    assert not base
    assert {(k, text[a:b]) for k, a, b in added} == {
        ("email", b"joe.doe (at) example (dot) com"),
        ("ip", b"10[.]0[.]0[.]12"),
        ("card", b"4111.1111.1111.1111"),
    }
    assert find(b"in 2024 the 17 of 300 items at v1.2.3")[1] == []
    assert finder(["no numbers here"])(b"4111.1111.1111.1111 joe (at) x (dot) com")[1] == []


def test_segmentation_is_the_best_of_all():
    import itertools

    import numpy as np

    draw = np.random.default_rng(2)
    model = personal.SpanField(np.zeros((1, 4)), draw.normal(size=(5, 5)))
    runs = [(0, 1), (0, 2), (1, 3), (2, 4), (3, 4)]
    scores = draw.normal(size=(5, 4)) * 2
    best = (-math.inf, None)
    for size in range(4):
        for chosen in itertools.combinations(range(5), size):
            order = sorted(chosen, key=lambda n: runs[n])
            if any(runs[a][1] > runs[b][0] for a, b in itertools.pairwise(order)):
                continue
            for kinds in itertools.product(range(4), repeat=size):
                total, before, at = 0.0, 4, 0
                for n, kind in zip(order, kinds, strict=True):
                    for now in [4] * (runs[n][0] - at) + [kind]:
                        total += model.moves[before, now]
                        before = now
                    total += scores[n, kind]
                    at = runs[n][1]
                for _ in range(4 - at):
                    total += model.moves[before, 4]
                    before = 4
                if total > best[0]:
                    best = (total, [(*runs[n], k) for n, k in zip(order, kinds, strict=True)])
    assert model.decode(4, runs, scores) == best[1]


def test_window_entropies_follow_the_counts():
    run = b"aabbccdd0123456789abcdefABCDEF+/aaaaaaaaaaaaaaaaaaaaaaaaa"
    for start, bits in enumerate(secrets.window_entropies(run)):
        part = run[start : start + secrets.WINDOW]
        expected = -sum(part.count(c) / len(part) * math.log2(part.count(c) / len(part)) for c in set(part))
        assert bits == pytest.approx(expected, abs=1e-9)


def test_entropy_spans_and_the_allow_list():
    key = b"xK9mQ2vL8pR4tW7zB3nY6hJ1"
    scan = secrets.Scanner()
    text = "é ".encode() + key + b" und " + b"123e4567-e89b-12d3-a456-426614174000 verylongordinarywordsinarow 20240101-20241231-20251231"
    base, added = scan(text)
    assert base == [] and [text[a:b] for _, a, b in added] == [key]
    assert scan(b"token = " + key)[1] == []  # a fixed pattern covers it
    assert secrets.Scanner(allowed=[key])(text)[1] == []


def test_awkward_rows(spark):
    docs = cases.documents(spark, extra="all_spans")
    found = secrets.find_secrets(docs)
    assert found.count() == docs.count() and found.columns[-2:] == ["base_spans", "all_spans"]
    assert found.agg(F.sum(F.size("all_spans"))).first()[0] == 0
    assert secrets.find_secrets(cases.empty(spark)).count() == 0
    model = personal.train(docs)
    assert personal.find_personal_data(docs, model).agg(F.sum(F.size("all_spans"))).first()[0] == 0
    assert personal.find_personal_data(cases.empty(spark), personal.train(cases.empty(spark))).count() == 0
    text = "ñé joe@x.example.com ñ token=abcdefgh1"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (mail,) = personal.find_personal_data(row, model).first()["base_spans"]
    assert text[mail["start"] : mail["stop"]] == "joe@x.example.com"
    (token,) = secrets.find_secrets(row).first()["base_spans"]
    assert text[token["start"] : token["stop"]] == "token=abcdefgh1"


def test_no_spelling_of_a_match_is_too_long_for_a_segment():
    long_name = ".".join(["ab"] * 60)
    texts = [
        "to first.last@mail.example.co.uk now",
        f"to {long_name}@{'x-1.' * 30}example.org now",
        "to _a.b%c+d@x-y.example.com- now",
        "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 or 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 there",
        "call +1 (5)(5)(5) 5-5-5-1-2-3-4 or +49--30--((1234))--567890 or +123456789012345 today",
        "host 192.168.100.200 and 0010.000000000.0000000000000.1 up",
    ]
    drawn = [(t, a, b) for t in (x.encode() for x in texts) for a, b in personal.stretches(t)]
    cases_made = personal.training_cases(drawn)
    assert {k for _, _, _, spans in cases_made for k, _, _ in spans} == set(personal.KINDS)
    for text, start, stop, spans in cases_made:
        tokens, runs = personal._segments(text, start, stop)
        places = {(tokens[i][0], tokens[j - 1][1]) for i, j in runs}
        for kind, a, b in spans:
            assert (a, b) in places, text[a:b]
            assert personal._possible(text[a:b])[personal.KINDS.index(kind)], text[a:b]
    assert personal.fit(drawn, rounds=1).skipped == 0


def test_long_spellings_are_found_whole():
    known = [f"mail to user{i}.x@host{i}.example.org today or to a.b{i}@mail.example.co.uk" for i in range(20)]
    known += [f"card 4111 1111 1111 1111 there in 20{10 + i} with {i} items and 10.{i}.{2 * i}.7" for i in range(20)]
    text = b"ask first.last (at) mail (dot) example (dot) co (dot) uk in 2024"
    assert [(k, text[a:b]) for k, a, b in finder(known)(text)[1]] == [("email", b"first.last (at) mail (dot) example (dot) co (dot) uk")]


def test_every_kind_has_its_share_of_the_drawn_stretches(spark):
    rows = [f"mail to user{i}.x@host{i}.example.org" for i in range(900)]
    rows += [f"host 10.{i}.{2 * i}.7 here" for i in range(20)] + [f"call +1 (55{i % 10}) 555-12{10 + i} and" for i in range(20)]
    rows += [f"card 4111 1111 1111 1111 in room {i}" for i in range(20)] + [f"the {i} of 20{10 + i}" for i in range(20)]
    docs = spark.createDataFrame([(x,) for x in rows], "text string").repartition(3)
    drawn = personal._drawn(docs, "text", 15)
    kinds = [{k for k, _, _ in personal.base_spans(t)} for t, _, _ in drawn]
    assert [sum(k in own for own in kinds) for k in personal.KINDS] == [15] * 4 and kinds.count(set()) == 15
    found = personal.recall(personal.train(docs), personal._drawn(docs, "text", 200))
    assert all(total and right / total > 0.9 for right, total in found.values()), found


def test_expected_segments_agree_with_all_segmentations():
    import itertools

    import numpy as np

    draw = np.random.default_rng(3)
    moves = draw.normal(size=(5, 5))
    counts = np.array([4, 3, 2])
    own_runs = [[(0, 1), (0, 2), (1, 3), (2, 4)], [(0, 3), (1, 2)], []]
    own_scores = [draw.normal(size=(len(r), 4)) for r in own_runs]
    chances, steps, whole = [], np.zeros((5, 5)), []
    for count, runs, scores in zip(counts, own_runs, own_scores, strict=True):
        held, moved, total = np.zeros((len(runs), 4)), np.zeros((5, 5)), 0.0
        for size in range(len(runs) + 1):
            for chosen in itertools.combinations(range(len(runs)), size):
                order = sorted(chosen, key=lambda n: runs[n])
                if any(runs[a][1] > runs[b][0] for a, b in itertools.pairwise(order)):
                    continue
                for kinds in itertools.product(range(4), repeat=size):
                    path, at = [4], 0
                    for n, kind in zip(order, kinds, strict=True):
                        path += [4] * (runs[n][0] - at) + [kind]
                        at = runs[n][1]
                    path += [4] * (int(count) - at)
                    pairs = list(itertools.pairwise(path))
                    value = math.exp(sum(moves[p] for p in pairs) + sum(scores[n, k] for n, k in zip(order, kinds, strict=True)))
                    total += value
                    for n, kind in zip(order, kinds, strict=True):
                        held[n, kind] += value
                    for p in pairs:
                        moved[p] += value
        chances.append(held / total)
        steps += moved / total
    owner = np.repeat(np.arange(3), [len(r) for r in own_runs])
    places = np.array([r for runs in own_runs for r in runs])
    found, found_steps = personal._expected(counts, owner, places, np.concatenate(own_scores), moves)
    assert np.allclose(found, np.concatenate(chances)) and np.allclose(found_steps, steps)


@pytest.mark.parametrize(
    "text",
    [
        "7" * 1_000_000,
        "x" * 500_000 + "@" + "y" * 500_000,
        ",".join(f"user{i}.x@host{i}.example.org" for i in range(20_000)),
        "a@" * 20_000,
        "(" * 200_000 + "1 2 3 4" + "+" * 200_000 + "1" + "1.2.3 " * 1000,
        "a@b.c%d@e.f.@g.h" * 5000,
    ],
    ids=["digits", "letters", "addresses", "at-signs", "brackets", "chained"],
)
def test_long_texts_without_blanks_take_linear_time(text):
    import time

    plain = finder([f"mail to user{i}.x@host{i}.example.org and 10.{i}.{2 * i}.7 now" for i in range(20)])
    start = time.monotonic()
    base, added = plain(text.encode())
    assert time.monotonic() - start < 60
    taken = sorted((a, b) for _, a, b in base)
    # The patterns as given are quadratic here, so they are compared on a part of the text.
    part = text[:2000] + text[-2000:]
    expected = personal_spans(part)
    found = personal.base_spans(part.encode())
    assert [[(a, b) for k, a, b in found if k == kind] for kind in personal.KINDS] == expected
    for _, a, b in added:
        assert not any(a < y and x < b for x, y in taken[:1000])


def test_addresses_and_numbers_agree_with_the_plain_patterns():
    import random

    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice("aZ0019.@@-+%_ (),é") for _ in range(draw.randrange(60)))
        found = personal.base_spans(text.encode())
        if text.isascii():
            assert [[(a, b) for k, a, b in found if k == kind] for kind in personal.KINDS] == personal_spans(text), text
