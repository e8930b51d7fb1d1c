"""Exact ranks against numpy and plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrad.operators import metrics, order, prep

RNG = np.random.default_rng(5)
SAMPLES = {
    "uniform": RNG.random(3000),
    "heavy tail": np.exp(RNG.normal(0, 8, 3000)),
    "ties": RNG.integers(0, 5, 3000) / 7,
    "one value": np.full(500, 0.25),
    "two far values": np.array([-1e300] * 20 + [1e300] * 21),
    "one far value": np.append(RNG.random(3000) * 1e-9, 1e9),
    "negative": RNG.normal(-3, 1, 999),
    "one row": np.array([7.5]),
    "tiny": np.array([0.0, 5e-324, 1e-323, 5e-324]),
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("few", [4096, 8])
def test_quantiles_equal_numpys(spark, monkeypatch, name, few):
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "CELLS", 4096 if few > 8 else 16)
    v = SAMPLES[name]
    rows = spark.createDataFrame([(float(x),) for x in v], "p double").union(spark.createDataFrame([(None,), (float("nan"),)], "p double")).repartition(3)
    at = [0, 0.01, 1 / 3, 0.5, 0.99, 1]
    assert order.quantiles(rows, "p", at) == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12, abs=1e-300)


def test_quantiles_without_values(spark):
    assert order.quantiles(spark.createDataFrame([(None,)], "p double"), "p", [0.5]) is None


@pytest.mark.parametrize("kind", ["uniform", "narrow", "one score", "few scores"])
def test_walks_over_many_ranges_equal_a_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    n = 1200
    p = {"uniform": RNG.random(n), "narrow": 0.5 + RNG.random(n) * 1e-7, "one score": np.full(n, 0.3), "few scores": RNG.integers(0, 3, n) / 2}[kind]
    y = RNG.random(n) < 0.3
    rows = [(int(i) * 7 % n, float(a), int(b)) for i, a, b in zip(range(n), p, y, strict=True)]
    s = spark.createDataFrame(rows, "row_id long, p double, y int").repartition(4)
    found, want = 0, []
    for k, (row, score, hit) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        found += hit
        want.append((k, row, score, hit, found))
    got = metrics.ranked_walk(s).orderBy("k").collect()
    assert [tuple(r)[:5] for r in got] == want and got[-1].recall == 1
    made = s.withColumn("down", -F.col("p"))
    parts = order.ranges(made, ["down", "row_id"], (-1.0, 0.0), {})
    sizes = [r.n for r in made.groupBy(parts.part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]
    assert sizes == [x["n"] for x in parts.sums] and max(sizes) <= 20


def test_empty_walk(spark):
    assert metrics.ranked_walk(spark.createDataFrame([], "row_id long, p double, y int")).count() == 0
    assert metrics.best_f1(spark.createDataFrame([], "row_id long, p double, y int")).first().f1 is None


@pytest.mark.parametrize("kind", ["string", "long"])
def test_large_vocabularies_are_ranked_in_ranges(spark, monkeypatch, kind):
    codes = [f"c{x}" if kind == "string" else x for x in RNG.integers(0, 900, 3000).tolist()]
    rows = spark.createDataFrame([(i, c, "test" if i % 5 == 0 else "train") for i, c in enumerate(codes)], f"row_id long, code {kind}, split string").repartition(3)
    want = {c: i for i, c in enumerate(sorted({c for i, c in enumerate(codes) if i % 5}))}
    for most in (100_000, 50):
        monkeypatch.setattr(prep, "RANGE_CODES", most)
        assert {r.code: r["index"] for r in prep.vocabulary(rows, "code").collect()} == want
