import math

import numpy as np

from hushgrad.llm import neighbours


def brute(rows, ask, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in fine if ask(i)}:
        a = np.array(a)
        near = sorted((-(a @ np.array(v)) / (np.linalg.norm(a) * np.linalg.norm(v)), i) for i, v in fine if i != q and len(v) == len(a))
        out |= {(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(near[:k], 1)}
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "ROWS", 3)
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8)]) for i in range(150)]
    rows += [(150 + i, list(rows[20][1])) for i in range(9)]  # ties
    rows += [(200, None), (205, [0.0] * 8), (210, [1.0, None, *[0.0] * 6]), (215, [float("nan")] * 8), (220, [float("inf"), *[1.0] * 7]), (225, []), (230, [1.0, 2.0]), (235, [2.0, 1.0]), (5, rows[5][1]), (240, [1e-30] * 8), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(*r, 0, 0.5) for r in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(4)
    got = neighbours.nearest(vectors, vectors.where("vec_id % 5 = 0")).collect()
    want = brute([(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows], lambda i: i % 5 == 0, 5)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)


def test_few_candidates_and_empty_tables(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(vectors, vectors.where("vec_id = 0")).collect()] == [(0, 1)]
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64)) * rng.exponential(size=(300, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, scale, size = neighbours.coded(unit)
    near = neighbours.product(codes, codes) * np.outer(scale, scale)
    assert (np.abs(near - unit @ unit.T) <= np.outer(scale, scale) * (0.5 * (size[:, None] + size) + 16) + 1e-9).all()


def test_vectors_of_more_than_a_thousand_lengths(spark):
    vectors = spark.range(2200).selectExpr("id as vec_id", "transform(sequence(1, cast(id div 2 as int) + 1), x -> cast(sin(x * id + 1) as float)) as embedding")
    got = neighbours.nearest(vectors, vectors.where("vec_id >= 4")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(i, 1, i ^ 1) for i in range(4, 2200)]


def test_clashing_ids_and_many_waves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VALUES", 8)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0, 5.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0]), (2, [0.2, 1.0]), (4, [1.0, 1.0]), (6, [1.0, 0.9]), (8, [-1.0, 0.5]), (10, [3.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, query_id string")
    got = neighbours.nearest(vectors, vectors.where("vec_id % 2 = 0"), 3).collect()
    least = {}
    for i, v in rows:
        if i % 2 == 0:
            least[i] = min(least.get(i, v), v)
    want = set()
    for q, a in least.items():
        near = sorted((-np.dot(a, v) / np.linalg.norm(a) / np.linalg.norm(v), i) for i, v in rows if i != q and len(v) == len(a))
        want |= {(q, n, i, round(-s, 9)) for n, (s, i) in enumerate(near[:3], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == [1, 2, 4]
