import tracemalloc

import numpy as np

from promptloom import session
from promptloom.llm import jaccard
from promptloom.llm.components import components
from promptloom.llm.jaccard import _outer_grams, _packed, jaccard_components, keep_one_of_each
from tests.llm import cases


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_force(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    reach = {d: {d} for d, _ in sets if d is not None}
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                joined = reach[a] | reach[b]
                for d in joined:
                    reach[d] = joined
    return [(d, len(s), None if d is None else min(reach[d])) for d, s in sets]


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = [tuple(r) for r in jaccard_components(docs).collect()]
    assert sorted(found, key=str) == sorted(brute_force(rows), key=str)


def test_awkward_rows(spark):
    docs = cases.documents(spark, extra="component_id")
    check(docs)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 7, 8, 9, 10, None} <= set(ids) and not {2, 3, 11} & set(ids)
    assert keep_one_of_each(cases.empty(spark)).count() == 0


def test_chains_of_near_copies(spark):
    base = cases.prose(7, 120).split()
    rows = []
    for d in range(60):
        words = list(base)
        for k in range(d % 12):
            words[(k * 9 + d // 12) % 120] = f"w{d % 5}x{k}"
        rows.append((d, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_passage_that_every_document_holds(spark):
    passage = cases.prose(5, 60)
    rows = [(d, f"{passage} {cases.prose(1000 + d, 4 + 3 * (d % 23))}") for d in range(90)]
    rows += [(200 + d, f"{passage} {cases.prose(1000 + d, 4 + 3 * (d % 23))} more{d}") for d in range(0, 90, 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_copies_on_both_sides_of_the_threshold(spark, monkeypatch):
    base = cases.prose(11, 140).split()
    rows = []
    for d in range(120):
        words = list(base)
        for k in range(1 + d % 7):
            at = (d * 37 + k * 19) % 137
            words[at : at + 1] = [f"odd{(d + k) % 4}"] if d % 3 else [words[at], f"new{d}x{k}"]
        rows.append((d, " ".join(words[: 140 - d % 5])))
    rows += [(7, " ".join(base[:60])), (500, " ".join(base[2:])), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for crowd in (3, 1000):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        check(docs)


def test_columns_of_rows_that_meet_few_others_are_not_moved(spark, monkeypatch):
    passage, counted, outer_grams = cases.prose(17, 12), [], jaccard._outer_grams

    def noted(rows, texts, width):
        counted.append(rows.count())
        return outer_grams(rows, texts, width)

    monkeypatch.setattr(jaccard, "CROWD", 10)
    monkeypatch.setattr(jaccard, "_outer_grams", noted)
    rows = [(d, f"{passage} {cases.prose(3000 + d, 150)}") for d in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert counted == [0]


def test_postings_are_deleted_once_the_shared_ones_are_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(d, cases.prose(60 + d // 2, 20)) for d in range(10)], "doc_id long, text string")
    check(docs)
    labels = {path.name.split("-")[0] for path in (tmp_path / "promptloom").iterdir()}
    assert "shared" in labels and "postings" not in labels


def test_columns_that_other_labels_hold(spark):
    texts = {1: "a b c d", 2: "a b c e", 3: "a b x y", 4: "c d"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    packed = _packed(docs.withColumn("text", docs.text.cast("binary")))
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "row long, label long")
    found = {r["row"]: r["outer"] for r in _outer_grams(rows, packed, 2).collect()}
    assert found == {1: 2, 2: 1, 3: 1, 4: 1}


def test_each_set_of_links_is_merged_once(spark, tmp_path, monkeypatch):
    """Rounds cost the driver jobs: finished stars are stored once, and later merges start from them."""
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    links = [(1, 1 + n) for n in range(1, 30)] + [(50, 60)]
    assert components(spark.createDataFrame(links, "a long, b long")).count() == 30
    assert len(list((tmp_path / "promptloom").glob("stars-*"))) == 1
    docs = spark.createDataFrame([(d, cases.prose(60 + d // 2, 20)) for d in range(10)], "doc_id long, text string")
    check(docs)
    assert len(list((tmp_path / "promptloom").glob("stars-*"))) == 1 + 3
    assert not list((tmp_path / "promptloom").glob("sized-*"))  # sizes come with the first block


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 3), (2, 3), (9, 7), (8, 9), (20, 19)] + [(100 + i, 101 + i) for i in range(30)]
    found = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(2, 1), (3, 1), (9, 7), (8, 7), (20, 19)} | {(101 + i, 100) for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frequent_grams_of_a_batch_are_counted_in_bounded_memory():
    draw = np.random.default_rng(6)
    common = draw.integers(0, 1 << 63, 40, np.uint64)
    sets = [np.unique(np.concatenate([draw.integers(0, 1 << 63, 400, np.uint64), common[: n % 41]])) for n in range(3000)]
    grams, counts = np.unique(np.concatenate(sets), return_counts=True)
    size = sum(x.nbytes for x in sets)
    tracemalloc.start()
    found, times = jaccard._often(sets, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == grams[counts >= 5]).all() and (times == counts[counts >= 5]).all()
    assert peak < 1.5 * size
    assert [len(x) for x in jaccard._often([], 5)] == [0, 0]
    assert [len(x) for x in jaccard._often([common[:3]], 5)] == [0, 0]
