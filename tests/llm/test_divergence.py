from collections import Counter, defaultdict

import pytest

from promptloom.llm import divergence
from promptloom.llm.divergence import source_divergences, terms_of
from tests.llm import cases


def brute_force(rows, least_docs, top):
    """Everything by its definition, with Python's integers."""
    found, docs = set(), defaultdict(Counter)
    counts = defaultdict(lambda: defaultdict(Counter))
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", terms_of((text or "").encode())
        docs[lang].update(set(terms))
        counts[lang][source].update(terms)

    def distance(p, q):
        return (p - q) * (p - q) // (p + q)

    for lang, own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {**own, None: sum(own.values(), Counter())}
        total = {s: sum(c[t] for t in kept) for s, c in own.items()}
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s, c in own.items()}
        for source in own:
            if source is None:
                continue
            pairs = [(-sum(distance(share[source][t], share[o][t]) for t in kept), o.encode()) for o in own if o not in (None, source)]
            terms = [(-distance(share[source][t], share[None][t]), t) for t in kept if own[source][t] and share[source][t] > share[None][t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found |= {(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return found


@pytest.mark.parametrize("cells", [7, 400_000])
def test_awkward_rows_agree_with_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "MOST_CELLS", cells)
    monkeypatch.setattr(divergence, "_PAIRS", cells)
    docs = cases.documents(spark, extra="value")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least, top in ((1, 3), (4, 10), (1000, 10)):
        result = source_divergences(docs, least_docs=least, top=top).collect()
        assert len(result) == len(set(map(tuple, result)))
        assert set(map(tuple, result)) == brute_force(rows, least, top)


def test_ties_hot_sources_and_other_scripts(spark):
    words = ["alpha", "ALPHA", "Élan", "élan", "слово", "字", "a1b", "x_y"]
    rows = [("en", f"s{k % 3 if k % 2 else 0}", " ".join(words[j % len(words)] for j in range(k, k + k % 5))) for k in range(200)]
    rows += [("", "", "alpha beta")] * 12 + [(None, None, "beta")] * 3 + [("de", "only", "eins")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert set(map(tuple, source_divergences(docs).collect())) == brute_force(rows, 10, 10)


def test_shares_are_exact():
    import numpy as np

    counts = np.array([0, 1, 10**12, 9 * 10**14], np.int64)
    whole = np.array([3, 7, 3 * 10**12 + 1, 9 * 10**15], np.int64)
    expected = [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(counts, whole, strict=True)]
    assert divergence._shares(counts, whole).tolist() == expected


def test_empty_table(spark):
    assert source_divergences(cases.empty(spark)).collect() == []
