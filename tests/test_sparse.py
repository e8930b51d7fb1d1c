"""Sparse rows, loaders, gradient sources and claims."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrad.operators import accounting as acc
from hushgrad.operators import stages, training, updates
from hushgrad.sources import loaders

RNG = np.random.default_rng(9)
WIDTH = 7


@pytest.fixture(scope="module")
def both(spark):
    """The same rows sparse and dense: 3 of 7 features are set in each."""
    rows = []
    for i in range(300):
        idx = sorted(RNG.choice(WIDTH, 3, replace=False).tolist())
        val = RNG.normal(size=3).tolist()
        x = [0.0] * WIDTH
        for j, v in zip(idx, val, strict=True):
            x[j] = v
        rows.append((i, idx, val, int(x[0] - x[3] > 0), *x))
    names = [f"x{j}" for j in range(WIDTH)]
    schema = "row_id long, idx array<int>, val array<double>, y int, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(4).cache(), names


def sources(names):
    loss = stages.Logistic()

    def per_batch(v, x, y):
        r = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1]))) - y
        return np.column_stack([r[:, None] * x, r])

    return stages.Dense(loss, names), stages.Sparse(loss, WIDTH), stages.Batched(per_batch, names)


def test_sources_agree(both):
    rows, names = both
    v, w = RNG.normal(size=WIDTH + 1), RNG.normal(size=WIDTH + 1)
    for clip in (None, 0.3):
        dense, *others = (s.totals(rows, v, clip) for s in sources(names))
        assert dense[1] == 300
        for sums, n in others:
            assert n == 300 and np.allclose(sums, dense[0])
    dense, *others = (s.difference(rows, v, w) for s in sources(names))
    assert all(np.allclose(d, dense) for d in others)
    assert all(np.allclose(s.sums(rows.limit(0), v, 0.3), 0) for s in sources(names))


def test_loops_agree_on_all_sources(both):
    rows, names = both
    start = np.zeros(WIDTH + 1)
    for params, source in zip((stages.Linear.of(start), stages.SparseLinear.of(start), stages.Parameters(start)), sources(names), strict=True):
        got = [
            training.sgd_train(source, params, updates.Sgd(0.5), rows, steps=3, batch=100, key="k").vector,
            training.dp_sgd_train(source, params, updates.Sgd(0.5), rows, steps=2, expected=60, clip=0.5, multiplier=1.0, key="k", noise=stages.CoinNoise("k")).vector,
            training.spider_train(source, params, updates.Sgd(0.5), rows, steps=3, interval=2, anchor=100, variation=60, scales=acc.NoiseScales(0.01, 0.1, 0.5), key="k", noise=stages.CoinNoise("k"))[1].vector,
            training.bias_reduced_train(source, params, updates.Sgd(0.01), rows, max_steps=2, epsilon=1.0, delta=1e-2, clip=1.0, radius=1.0, key="k", noise=stages.CoinNoise("k"), top=3).final.vector,
        ]
        first = got if isinstance(source, stages.Dense) else first
        assert all(np.allclose(a, b) for a, b in zip(got, first, strict=True))
    with pytest.raises(RuntimeError, match="provided"):
        training.dp_sgd_release(rows, stages.Sparse(stages.Logistic(), WIDTH), stages.SparseLinear(start[:-1]), rate=0.5, clip=1.0, multiplier=1.0, expected=150, key="k", step=0, noise=stages.Noise(0), cap=10)
    with pytest.raises(ValueError, match="cap"):
        training.dp_sgd_train(stages.Logistic(), stages.Linear.of(start), updates.Sgd(0.5), rows, names, steps=1, expected=60, clip=0.5, multiplier=1.0, key="k", cap=59)


def test_norms_and_clipping_of_sparse_rows(both):
    rows, names = both
    model = stages.SparseLinear.of(RNG.normal(size=WIDTH + 1))
    sparse = {r.row_id: (r.norm, r.k) for r in stages.sparse_gradients(rows, stages.Logistic(), model, 0.2).collect()}
    dense = {r.row_id: (r.norm, r.k) for r in stages.gradients(rows, stages.Logistic(), stages.Linear.of(model.vector), names, 0.2).collect()}
    assert all(np.allclose(sparse[i], dense[i]) for i in dense)
    with pytest.raises(Exception, match="outside the weights"):
        stages.sparse_logits(rows, stages.SparseLinear(np.zeros(3))).collect()


def test_empty_rows_of_a_sparse_table(spark):
    rows = spark.createDataFrame([(1, [], [], 0), (2, [1], [2.0], 1)], "row_id long, idx array<int>, val array<double>, y int")
    z = {r.row_id: r.z for r in stages.sparse_logits(rows, stages.SparseLinear(np.array([5.0, 3.0]), 0.5)).collect()}
    assert z == {1: 0.5, 2: 6.5}


def split_rows(spark):
    rows = [(i, "test" if i % 5 == 0 else "train", i % 2, None if i % 7 == 0 else float(i % 13 - 2), "abc"[i % 3] if i % 5 else "zabc"[i % 4]) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, split string, y int, v double, code string")


def test_one_hot_rows_and_their_bound(spark):
    split = loaders.load_one_hot(split_rows(spark), ["v"], ["code"], bound=1.25)
    assert split.width == 1 + 4 and split.meta["layout"] == {"code": (1, 3)}
    rows = split.rows.collect()
    assert max(np.linalg.norm(r.val) for r in rows) <= 1.25 + 1e-12 and {len(r.idx) for r in rows} == {2}
    assert {r.idx[1] for r in split.train.collect()} == {1, 2, 3} and 4 in {r.idx[1] for r in split.test.collect()}
    assert split.train.count() + split.test.count() == 200
    free = loaders.load_one_hot(split_rows(spark), ["v"], ["code"])
    assert {r.val[1] for r in free.rows.collect()} == {1.0}


def test_sparse_split_checks_its_rows(spark):
    rows = spark.createDataFrame([(1, "train", 0, [0, 5], [1.0, 1.0])], "row_id long, split string, y int, idx array<long>, val array<float>")
    fine = loaders.sparse_split(rows, 6, {"source": "made"})
    assert fine.rows.schema["idx"].dataType.simpleString() == "array<int>" and fine.meta == {"source": "made"} and fine.rows.count() == 1
    with pytest.raises(Exception, match="below 5"):
        loaders.sparse_split(rows, 5).rows.collect()
    with pytest.raises(ValueError, match="features"):
        loaders.load(rows, ["v"], [], features="some")


def test_claims_are_checked(both):
    rows, names = both
    acc.check_claim(acc.GaussianClaim(1.0, 2.0), 1.0, 2.0)
    for claim in (None, "gaussian", acc.GaussianClaim(2.0, 2.0), acc.GaussianClaim(1.0, 1.9)):
        with pytest.raises(ValueError, match="claim"):
            acc.check_claim(claim, 1.0, 2.0)
    with pytest.raises(ValueError, match="priced"):
        training.bias_reduced_train(stages.Logistic(), stages.Linear((0.0,) * WIDTH), updates.Sgd(0.1), rows, names, max_steps=1, epsilon=1.0, delta=1e-2, clip=1.0, radius=1.0, key="k", estimator=lambda **_: lambda sums, k, noise: sums)
    for bad in ({"clip_norm": 0}, {"radius": -1}, {"noise_multiplier": -1}):
        with pytest.raises(ValueError):
            training.MeanEstimator(**{"clip_norm": 1.0, "radius": 1.0, "noise_multiplier": 1.0} | bad)


def test_warnings_of_the_accountant(monkeypatch):
    c = acc.lipschitz(2.0, has_bias=True)
    n = acc.spider_noise(100_000, 2000, 500, 200, 20, c, 1.0, 1e-6)
    with pytest.warns(UserWarning, match="weaker"):
        acc.spider_epsilon(100_000, 2000, 500, 200, 20, c, acc.NoiseScales(n.anchor, n.variation_rate, 2 * n.variation_cap), 1e-6, align=False)
    with pytest.raises(ValueError, match="positive"):
        acc.spider_epsilon(100_000, 2000, 500, 200, 20, c, acc.NoiseScales(0, 1, 1), 1e-6)
    whole = acc.renyi
    monkeypatch.setattr(acc, "renyi", lambda q, z: np.where(acc.ORDERS > 200, np.nan, whole(q, z)))
    with pytest.warns(UserWarning, match="56 of"):
        acc.epsilon([acc.Schedule(0.1, 2.0, 10)], 1e-5)


def test_an_epoch_reads_only_its_batch(both):
    rows, names = both
    seen, source = [], stages.Dense(stages.Logistic(), names)

    class Spy(stages.Dense):
        def sums(self, rows, v, clip):
            seen.append(sorted(r.row_id for r in rows.select("row_id").collect()))
            return source.sums(rows, v, clip)

    training.sgd_train(Spy(stages.Logistic(), names), stages.Linear((0.0,) * WIDTH), updates.Sgd(0.1), rows, steps=5, batch=75, key="k")
    assert [len(x) for x in seen] == [75] * 5 and sorted(sum(seen[:4], [])) == list(range(300))


def test_coin_noise_equals_the_columns(spark):
    from hushgrad.functions import coins

    noise = stages.CoinNoise("k")
    noise.gaussian(2, 1.0)
    drawn = noise.gaussian(3, 2.0)
    cols = spark.range(3).select((F.lit(2.0) * coins.gaussian("k", "noise", 1, F.col("id"))).alias("z")).collect()
    assert np.allclose(sorted(drawn), sorted(r.z for r in cols))
