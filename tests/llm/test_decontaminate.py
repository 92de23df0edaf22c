from promptloom.llm.decontaminate import drop_contaminated, find_benchmark_words, words_of
from tests.llm import cases


def brute_force(docs, items, window=10):
    patterns = []
    for item, text in items:
        words = words_of((text or "").encode())
        size = min(window, len(words))
        patterns += [(words[i : i + size], item) for i in range(len(words) - size + 1) if size]
    found = []
    for number, text in docs:
        words = words_of((text or "").encode())
        hit, ids = set(), set()
        for pattern, item in patterns:
            for i in range(len(words) - len(pattern) + 1):
                if words[i : i + len(pattern)] == pattern:
                    hit |= set(range(i, i + len(pattern)))
                    ids |= {str(item)} - {"None"}
        found.append((number, len(words), len(hit), sorted(ids)))
    return found


def test_agrees_with_brute_force_in_one_and_in_many_shards(spark):
    docs, items = cases.documents(spark), cases.benchmark(spark)
    expected = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    for shard_bytes in (1 << 20, 4000):
        rows = find_benchmark_words(docs, items, shard_bytes=shard_bytes).collect()
        found = [(r["doc_id"], r["n_words"], sum(b - a for a, b in r["hits"]), r["item_ids"]) for r in rows]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_awkward_rows(spark):
    docs = cases.documents(spark, extra="hits")
    kept = drop_contaminated(docs, cases.benchmark(spark))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {4, 5, 6, 10, 11, 14, 15} and {1, 2, 3, 7, 8, 9, 16, None} <= ids
    assert drop_contaminated(cases.empty(spark), cases.benchmark(spark)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(docs, none).count() == docs.count()


def test_only_ascii_letters_are_folded():
    assert words_of("ÀB-c\x7fd".encode()) == ["Àb".encode(), b"c", b"d"]
