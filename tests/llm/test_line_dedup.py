import hashlib
import random

import pytest

from promptloom import session
from promptloom.llm.linedup import drop_repeated_lines, op2_line_dedup, without_repeated_lines
from tests.llm import cases

LOWEST = -(1 << 63)


def brute_force(rows, min_words=5):
    """Text left of each (id, text), from the longest earlier match of every suffix."""
    docs = sorted({(LOWEST if d is None else d, t or "") for d, t in rows})
    lines = [text.split("\n") for _, text in docs]
    places = [(i, j) for i, own in enumerate(lines) for j in range(len(own))]
    left = {}
    for i, own in enumerate(lines):
        runs = []
        for j in range(len(own)):
            longest = 0
            for a, b in places:
                if (a, b) >= (i, j):
                    break
                n = 0
                while j + n < len(own) and b + n < len(lines[a]) and own[j + n].strip(" \t\n\x0b\x0c\r") == lines[a][b + n].strip(" \t\n\x0b\x0c\r"):
                    n += 1
                longest = max(longest, n)
            if longest and runs and j < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], j + longest)
            elif longest:
                runs.append([j, j + longest])
        gone = {k for a, b in runs if sum(len(x.split()) for x in own[a:b]) >= min_words for k in range(a, b)}
        left[docs[i]] = (len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone))
    return [(d, left[LOWEST if d is None else d, t or ""][0], None if t is None else left[LOWEST if d is None else d, t or ""][1]) for d, t in rows]


@pytest.mark.parametrize("seed", range(2))
def test_agrees_with_brute_force(spark, seed):
    draw = random.Random(seed)
    parts = ["a b", "c", "d e f", "", " g h i j k l ", "x y z w v", "q"]
    rows = [(d, "\n".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for d in range(30)]
    rows += [(41, None), (42, ""), (None, "a b\nc\nd e f"), (3, rows[3][1])]
    done = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [tuple(r) for r in done.select("doc_id", "n_removed", "text").collect()]
    assert sorted(found, key=str) == sorted(brute_force(rows), key=str)


def test_query_agrees_with_brute_force_on_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = {(d, n, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, t in brute_force(rows)}
    assert {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in op2_line_dedup(spark, sf_dir).collect()} == expected


def test_awkward_rows(spark):
    docs = cases.documents(spark, extra="n_removed")
    kept = without_repeated_lines(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 1 not in ids  # the row with a null id comes first and holds their line
    assert ids.count(16) == 3 and {7, 8, 9, 12, None} <= set(ids)
    assert without_repeated_lines(cases.empty(spark)).count() == 0


def test_levels_count_no_ranks_across_partitions(spark, tmp_path, monkeypatch):
    """Jobs of each level cost the driver memory; only the places in reading order are numbered."""
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    text = "\n".join(f"a line of its own {n}" for n in range(9))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in drop_repeated_lines(docs).orderBy("doc_id").collect()] == [0, 9]
    made = [path.name.split("-")[0] for path in (tmp_path / "promptloom").iterdir()]
    assert made.count("ranks") == 5  # runs of 1, 2, 4, 8 lines, none of 16
    assert made.count("placed") == made.count("parts") == 1
    assert not {"order", "pairs"} & {name for name, n in zip(made, map(made.count, made), strict=True) if n > 1}
