import math

import numpy as np
import pytest

from promptloom.llm import negatives
from promptloom.llm.negatives import hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int, rank string"


def brute_force(rows, every=100):
    given = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        given[i] = min(given.get(i, row), row)
    found = []
    for a, (label, v) in given.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, own) for b, (own, w) in given.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            window = [(t, n) for t, n, own in scored if own != label and -80 * s <= -100 * t <= -100 * s]
            found += [(a, p, rank, n, -s, -t) for rank, (t, n) in enumerate(window[:5], 1)]
    return sorted(found)


def result(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], VECTORS).repartition(4)
    return sorted(map(tuple, hard_negatives(frame, **more).collect()))


def clustered(count, width, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, width))
    return [(i, (centres[draw.integers(12)] + 0.4 * draw.normal(size=width)).tolist(), int(draw.integers(4))) for i in range(count)]


@pytest.mark.parametrize("shard_rows", [60, 50_000])
def test_agrees_with_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    rows = clustered(900, 9, 1)
    found = result(spark, rows, anchors="vec_id % 20 = 0")
    assert found == brute_force(rows, 20) and len(found) > 200


def test_groups_of_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 100)
    base = clustered(40, 4, 2)
    rows = [(i, base[i % 7][1] if i % 3 else base[i % 40][1], i % 2 if i % 5 else 3) for i in range(800)]
    found = result(spark, rows, anchors="vec_id % 10 = 0")
    assert found == brute_force(rows, 10) and len(found) > 500


def test_awkward_rows(spark):
    rows = clustered(60, 3, 3)
    rows += [(100, None, 1), (200, [], 1), (300, [0.0, 0.0, 0.0], 1), (400, [1.0, None, 2.0], 1), (500, [float("nan"), 1.0, 1.0], 2)]
    rows += [(600, [float("inf"), 1.0, 1.0], 2), (700, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (800, [0.5], 1), (801, [0.5], 0)]
    rows += [rows[0], rows[0], (rows[1][0], [9.0, 9.0, 9.0], 3), (900, [-1.0, -1.0, 2.5], 77), (901, [1e6, 0.0, 0.0], 1)]
    kept = [r for r in rows if r[0] != 901]
    assert result(spark, rows, anchors="vec_id % 5 = 0") == brute_force(kept, 5)
    assert result(spark, []) == [] and result(spark, [(1, [1.0], 1)]) == [] and result(spark, [(100, [1.0], 1)]) == []


def test_large_components_are_exact(spark):
    rows = [(i, [100_000.0 + i / 256, -130_000.0 + i, 3.0], i % 2) for i in range(40)]
    found = result(spark, rows, anchors="vec_id % 4 = 0")
    assert found == brute_force(rows, 4) and found


def test_cells_come_by_falling_bound_and_searches_stop(spark):
    import pyarrow as pa

    draw = np.random.default_rng(4)
    vectors = np.floor(256 * (np.eye(16)[draw.integers(16, size=4000)] + 0.05 * draw.normal(size=(4000, 16))))
    index = negatives._Index(8, 16, (negatives._codebook(vectors[:, :8], 16), negatives._codebook(vectors[:, 8:], 16)))
    (i, far_i), (j, far_j) = index.codes(vectors)
    index.radii = tuple(np.array([far[codes == k].max(initial=0.0) for k in range(len(c))]) for codes, far, c in zip((i, j), (far_i, far_j), index.centres, strict=True))
    shard = negatives._Shard(index, pa.table({"vec_id": np.arange(4000), "label": draw.integers(2, size=4000), "v": list(vectors.astype(np.int64)), "i": i, "j": j}))
    one, two = index.bounds(vectors[:1])
    visits = list(shard.visits((one[0], two[0])))
    assert [b for b, _ in visits] == sorted((b for b, _ in visits), reverse=True)
    assert sum(b - a for _, (a, b) in visits) == 4000
    for bound, (a, b) in visits:
        assert (shard.vectors[a:b] @ vectors[0] <= bound).all()
    results, scored = shard.search(vectors[0], 0, True, (one[0], two[0]), [(-(1 << 62), 1 << 62, -(1 << 62))], 6)
    assert len(results) == 6 and scored < 1000
