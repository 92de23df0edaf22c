import math
import random

import numpy as np

from promptloom.llm.vectors import Rotation, near_vectors


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))


def test_awkward_vectors_agree_with_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for d in range(150):
        centre = random.Random(d % 9)
        rows.append((d, [centre.gauss(0, 1) + draw.gauss(0, 0.25) for _ in range(12)]))
    nan, inf = float("nan"), float("inf")
    rows += [(d, [0.5] * 12) for d in range(200, 260)]  # one vector many times
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [nan] + [1.0] * 11), (304, [inf] + [1.0] * 11)]
    rows += [(305, [None] + [1.0] * 11), (None, [0.5] * 12), (306, [0.5] * 3), (307, [0.25] * 3), (200, [0.5] * 12), (308, [1e200] * 12)]
    usable = [
        (i, d, v) for i, (d, v) in enumerate(rows) if d is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    ]
    scaled = {i: [x / max(map(abs, v)) for x in v] for i, _, v in usable}
    reach = {i: {i} for i in range(len(rows))}
    degree = [0] * len(rows)
    for i, _, _ in usable:
        for j, _, _ in usable:
            if i != j and len(scaled[i]) == len(scaled[j]) and cosine(scaled[i], scaled[j]) >= 0.9:
                degree[i] += 1
                if j not in reach[i]:
                    joined = reach[i] | reach[j]
                    for k in joined:
                        reach[k] = joined
    expected = []
    for i, (d, _) in enumerate(rows):
        least = min((rows[k][0] for k in reach[i] if rows[k][0] is not None), default=None)
        expected.append((d, degree[i], least, d == least))
    df = spark.createDataFrame([(d, v, "x") for d, v in rows], "vec_id long, embedding array<double>, n_links string")
    for cell in (16_000, 7):
        found = [tuple(r) for r in near_vectors(df, cell=cell).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_within_a_part_lie_in_neighbouring_cells():
    draw = np.random.default_rng(9)
    low_rank = draw.normal(size=(400, 2)) @ draw.normal(size=(2, 12))
    low_rank /= np.sqrt((low_rank**2).sum(1))[:, None]
    rotation = Rotation(low_rank, 0.2, 4)
    assert rotation.parts.min() < 1e-5
    one = rotation.turn(low_rank)
    other = one + draw.normal(size=one.shape) * 1.5e-3
    within = rotation.within(one, other)
    assert within.any(0).all()
    for block in range(4):
        apart = np.abs(rotation.cells(one, block) - rotation.cells(other, block)).max(1)
        assert (apart[within[:, block]] <= 1).all()


def test_low_rank_vectors_agree_with_brute_force(spark):
    draw = np.random.default_rng(10)
    rows = draw.normal(size=(200, 2)) @ draw.normal(size=(2, 12)) + draw.normal(size=(200, 12)) * 1e-3
    unit = rows / np.sqrt((rows**2).sum(1))[:, None]
    near = unit @ unit.T >= 0.9
    degrees = near.sum(1) - 1
    found = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    assert [r["n_links"] for r in sorted(found.collect(), key=lambda r: r["vec_id"])] == degrees.tolist()
