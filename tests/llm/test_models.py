import itertools
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from promptloom.llm import langid, toxicity
from tests.llm import cases


def test_forward_backward_agrees_with_all_paths():
    draw = np.random.default_rng(1)
    scores, moves = np.exp(draw.normal(size=(5, 2, 3))), np.exp(draw.normal(size=(3, 3)))
    lengths = np.array([5, 3])
    scores[3:, 1] = 1.0
    found = langid.forward_backward(scores, lengths, moves)
    for column, length in enumerate(lengths):
        chances = np.zeros((length, 3))
        for path in itertools.product(range(3), repeat=int(length)):
            value = scores[0, column, path[0]]
            for t in range(1, length):
                value *= moves[path[t - 1], path[t]] * scores[t, column, path[t]]
            for t, label in enumerate(path):
                chances[t, label] += value
        assert np.allclose(found[:length, column], chances / chances.sum(1, keepdims=True))


def test_language_of_awkward_rows(spark):
    docs = cases.documents(spark, extra="score")
    model = langid.train(docs)
    assert model.labels == ["en", "fr"]
    found = langid.predict(docs, model)
    assert found.columns[-2:] == ["lang_pred", "score"]
    rows = {r["doc_id"]: r for r in found.collect()}
    for number in (7, 8, 9, 15):
        assert (rows[number]["lang_pred"], rows[number]["score"]) == ("und", 0.0)
    assert rows[1]["lang_pred"] == "en" and 0 < rows[1]["score"] <= 1
    kept = langid.drop_unclear_languages(docs)
    assert kept.columns == docs.columns and not {7, 8, 9, 15} & {r["doc_id"] for r in kept.collect()}
    assert langid.drop_unclear_languages(cases.empty(spark)).count() == 0
    unlabelled = langid.train(docs.where("lang IS NULL"))
    assert langid.predict(docs, unlabelled).where("lang_pred <> 'und' OR score <> 0").count() == 0


def test_code_switched_text_is_labelled_word_by_word():
    draw = np.random.default_rng(4)
    syllables = {"x": ["ba", "bo", "bi", "bu"], "y": ["ze", "zo", "za", "zu"]}

    def words(kind, count):
        return ["".join(draw.choice(syllables[kind], 3)).encode() for _ in range(count)]

    segments = [(i, words(k, 40)) for i, k in enumerate("xy") for _ in range(40)]
    model = langid.fit(["x", "y"], segments, {})
    text = words("x", 12) + words("y", 8)
    scores = np.exp(model.word_scores(text))[:, None]
    chances = langid.forward_backward(scores / scores.max(2, keepdims=True), np.array([20]), np.exp(model.moves))[:, 0]
    assert (chances.argmax(1) == [0] * 12 + [1] * 8).all()
    assert model.moves[0, 0] > model.moves[0, 1]


def char_counts(words):
    counts = {}
    for word, n in words.items():
        padded = f"  {word} "
        for i in range(len(padded) - 2):
            counts[padded[i : i + 3]] = counts.get(padded[i : i + 3], 0) + n
    return counts


def test_disguised_words_are_restored():
    model = toxicity.char_model(char_counts({"idiot": 20, "stupid": 20, "the": 50, "you": 30, "are": 30, "balloon": 5, "cool": 9}))
    assert toxicity.restore("1d10t", model) == "idiot"
    assert toxicity.restore("$tup1d!", model) == "stupid"
    assert toxicity.restore("idiooooot", model) == "idiot"
    assert toxicity.restore("coooool", model) == "cool"
    assert toxicity.restore("stupid,", model) is None
    assert toxicity.viterbi(toxicity.lattice("i d i o t"), model) == "idiot"
    assert toxicity.viterbi(toxicity.lattice("y o u i d i o t"), model).replace(" ", "") == "youidiot"


def test_disguised_texts_get_the_score_of_plain_ones(spark):
    rows, labels = [], []
    for d in range(120):
        toxic = d % 3 == 0
        rows.append((d, cases.prose(d, 30) + (" you stupid idiot" if toxic else "") + " " + cases.prose(d + 500, 10)))
        labels.append((d, int(toxic)))
    labels += [(3, None), (None, 1), (5, 7), (999, 1)]
    rows += [(200, "so $tup1d you 1d10t"), (201, "s t u p i d people"), (202, "a table in the morning"), (203, None), (204, ""), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    scored = toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), model)
    found = {r["doc_id"]: r for r in scored.collect()}
    assert all(found[d]["predicted"] == label for d, label in labels[:120])
    assert [found[d]["predicted"] for d in (200, 201, 202, 203, 204)] == [1, 1, 0, 0, 0]
    assert found[203]["score"] == found[204]["score"] < 0.5


def test_toxicity_without_labels_or_rows(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, none)).where("score > 0.001").count() == 0
    assert toxicity.score_toxicity(cases.empty(spark), toxicity.train(cases.empty(spark), none)).count() == 0


def test_affixes_and_grams_are_characters():
    def bucket(text, kind):
        value = 0
        for c in text:
            value = (value * int(langid.ODD) + ord(c) + 1) % 2**64
        return int(langid._buckets(np.array([value], np.uint64), kind + len(text))[0])

    words = ["привет", "a", "é", "privet", "слово", "ab"]
    flat, owner = langid.features([w.encode() for w in words], [None, "05", None, None, "50", None])
    for i, word in enumerate(words):
        expected = [langid.zlib.crc32(word.encode(), langid._WORD) % langid.BUCKETS]
        expected += [bucket(word[:n], langid._START) for n in range(1, min(5, len(word)) + 1)]
        expected += [bucket(word[-n:], langid._END) for n in range(1, min(5, len(word)) + 1)]
        expected += [bucket(word[j : j + n], langid._GRAM) for n in (2, 3) for j in range(len(word) - n + 1)]
        expected += {1: langid._lexicon_buckets("05"), 4: langid._lexicon_buckets("50")}.get(i, ())
        assert sorted(flat[owner == i]) == sorted(expected)


def test_words_of_rare_languages_keep_their_shares_at_any_size_of_the_cache(spark, monkeypatch):
    draw = np.random.default_rng(6)
    syllables = {"x": ["ba", "bo", "bi", "bu", "ka", "ko"], "y": ["ba", "bo", "ze", "zo", "za", "zu"]}
    rows = [(d, " ".join("".join(draw.choice(syllables[k], 3)) for _ in range(30)), k) for d in range(90) for k in ["y" if d % 10 == 0 else "x"]]
    docs = spark.createDataFrame(rows + [(90, rows[0][1], None), (91, None, "x")], "doc_id long, text string, lang string").repartition(3)
    whole = langid.train(docs)
    words = {w for _, text, _ in rows for w in langid.words_of(text)}
    assert whole.rest is None and len(whole.lexicon) == len(words) and all(whole.lexicon.find(list(words)))
    monkeypatch.setattr(langid, "LEXICON", 8)
    small = langid.train(docs)
    assert 0 < len(small.lexicon) <= 8
    assert {bytes(r["word"]) for r in small.rest.collect()} == words
    found = [sorted(map(str, langid.predict(docs, m).collect())) for m in (whole, small)]
    assert found[0] == found[1] and len(found[0]) == len(rows) + 2


def test_all_trigrams_are_kept(spark):
    draw = np.random.default_rng(8)
    texts = ["".join(map(chr, draw.integers(0x4E00, 0x9000, 80_000))) for _ in range(3)]
    grams = {g for t in texts for g in (f"  {t} "[i : i + 3] for i in range(len(t) + 1))}
    model = toxicity.train_char_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(grams) > 200_000 and model.trigrams.keys() == grams


def test_words_too_rare_for_the_sample_make_a_text_toxic(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 12)
    rows, labels = [], []
    for d in range(600):
        toxic = d % 4 == 0
        word = f"{'qvxzjk'[d // 4 % 6]}orgblat" if d < 192 else "idiot"
        rows.append((d, cases.prose(d, 30) + (f" {word}" if toxic else "")))
        labels.append((d, int(toxic)))
    rows += [(1000 + k, cases.prose(2000 + k, 30) + f" {c}orgblat") for k, c in enumerate("qvxzjk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert [found[1000 + k] for k in range(6)] == [1] * 6
    assert sum(found[d] == label for d, label in labels) > 590


def test_reader_of_wanted_features_finds_the_same_ones():
    counts = Counter()
    texts = ["some plain words here", "so.me pl4in w0rds", "p l a i n letters, hereee", None, ""] * 2
    for word in " ".join(t or "" for t in texts).split():
        counts.update(f"  {word} "[at : at + 3] for at in range(len(word) + 1))
    chars = toxicity.char_model(dict(counts))
    full = [toxicity.Reader(chars).features(text) for text in texts]
    wanted = set(sorted(set().union(*full))[::3])
    reader = toxicity.Reader(chars, wanted)
    assert [reader.features(text) for text in texts] == [found & wanted for found in full]


def test_many_texts_of_rare_words_are_labelled_in_bounded_memory():
    texts = [" ".join(f"w{chr(97 + i % 26)}{'abcdefghij'[i % 7]}é{chr(0x4E00 + (300 * t + i) % 20000)}{chr(0x4E00 + t)}" for i in range(300)) for t in range(1000)]
    column = pa.array([*texts, None, "", "x"])
    draw = np.random.default_rng(5)
    model = langid.Field(["x", "y"], draw.normal(size=(langid.BUCKETS, 2)), np.zeros((2, 2)), langid.Lexicon.of(np.empty(0, np.int64), []))
    labeller = langid.Labeller(model)
    tracemalloc.start()
    parts = [(at, len(own), labeller.shares(own)) for at, own in langid._together(column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6
    assert [at for at, _, _ in parts] == [0, *np.cumsum([n for _, n, _ in parts])[:-1]] and len(parts) > 1
    found = np.concatenate([x for _, _, x in parts])
    assert len(found) == len(column) and (found[-3:-1] == 0).all()
    for place in (0, 500, 999):
        alone = langid.Labeller(model).shares([langid.words_of(texts[place])])[0]
        assert np.allclose(found[place], alone)
