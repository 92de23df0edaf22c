import corpus_pipeline
from promptloom.llm.mixture import mix_documents
from promptloom.session import materialise
from tests.llm import cases
from tests.llm.test_jaccard import brute_force as jaccard_brute_force

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF_DIR), name)
        assert docs.columns == before.columns and docs.schema == before.schema
        assert 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            kept = {d for d, _, c in jaccard_brute_force([(r["doc_id"], r["text"]) for r in before.collect()]) if c == d}
            assert {r["doc_id"] for r in docs.collect()} == kept
    expected = sorted(map(tuple, mix_documents(docs).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == expected


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (cases.documents(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF_DIR), name)


def test_mix(spark):
    docs = cases.documents(spark, extra="size")
    rows = mix_documents(docs).collect()
    assert len(rows) == docs.count() and mix_documents(cases.empty(spark)).count() == 0
    total = sum(r["size"] for r in rows)
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    sources = {r["source_size"]: r["target"] for r in rows}
    assert sum(sources.values()) <= 1.5 * total * 1.001
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_documents(docs.repartition(5)).collect()), key=str)


def test_near_copies_share_four_fifths_of_their_five_word_shingles(spark):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    rows = []
    for d in range(40):
        words = cases.prose(d // 4, 100 + d // 4).split()
        words[50 : 50 + d % 4 * 2] = [f"w{d}x{k}" for k in range(d % 4 * 2)]
        rows.append((d, " ".join(words)))
    reach = {d: {d} for d, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if 100 * len(shingles(x) & shingles(y)) >= 80 * len(shingles(x) | shingles(y)):
                joined = reach[a] | reach[b]
                for d in joined:
                    reach[d] = joined
    expected = {d for d, _ in rows if min(reach[d]) == d}
    by_op7 = {d for d, _, c in jaccard_brute_force(rows) if c == d}
    assert len(expected) < len(by_op7)  # some pairs link by these values only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()} == expected
