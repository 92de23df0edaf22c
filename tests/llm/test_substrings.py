import random

from promptloom.llm import substrings
from promptloom.llm.substrings import SuffixAutomaton, remove_repeated_words
from tests.llm import cases


def brute_force(rows, window=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, d), d)
    found = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone |= set(range(i, i + window))
        found.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return found


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    done = remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, done), key=str) == sorted(brute_force(rows), key=str)


def test_awkward_rows(spark):
    docs = cases.documents(spark, extra="n_removed")
    check(docs)
    assert remove_repeated_words(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text"]
    assert remove_repeated_words(cases.empty(spark)).count() == 0


def test_overlapping_copies_agree_with_brute_force(spark):
    draw = random.Random(3)
    passages = [cases.prose(100 + i, draw.randint(10, 40)) for i in range(8)]
    rows = [(d, " ".join(draw.choice(passages) if draw.random() < 0.6 else cases.prose(500 + d * 10 + k, 9) for k in range(4))) for d in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_shuffles_of_runs_are_over_before_texts_are_shuffled(spark, monkeypatch):
    plans, store = {}, substrings.stored

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, label)

    monkeypatch.setattr(substrings, "stored", noted)
    shared = cases.prose(9, 30)
    check(spark.createDataFrame([(d, f"{cases.prose(40 + d, 20)} {shared}") for d in range(20)], "doc_id long, text string"))
    assert "Aggregate" in plans["led"] and "Aggregate" not in plans["routed"]


def test_matching_statistics():
    draw = random.Random(1)
    for _ in range(30):
        passages = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 12))] for _ in range(3)]
        query = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(15)]
        automaton = SuffixAutomaton()
        for passage in passages:
            automaton.add(passage)
        runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        expected = [max([n for n in range(1, at + 2) if tuple(query[at + 1 - n : at + 1]) in runs], default=0) for at in range(len(query))]
        assert list(automaton.statistics(query)) == expected
