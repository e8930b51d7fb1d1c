"""Closed forms, golden values and invariants of the operators."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushgrad.functions import coins
from hushgrad.operators import accounting as acc
from hushgrad.operators import metrics, prep, sampling, stages, training, updates
from hushgrad.sources import tables


def scored(spark, rows):
    return spark.createDataFrame([(i, float(p), int(y)) for i, (p, y) in enumerate(rows)], "row_id long, p double, y int")


# --- metrics


PINNED = [(0.9, 0), (0.8, 1), (0.8, 1), (0.5, 0), (0.4, 1), (0.35, 1), (0.2, 0), (0.1, 0)]


def test_confusion_and_best_f1_agree(spark):
    s = scored(spark, PINNED)
    best = metrics.best_f1(s).first()
    assert (best.threshold, round(best.f1, 12)) == (0.35, 0.8)
    got = [tuple(r)[1:] for r in metrics.confusion_at(s, [0.0, 0.35, 0.8, 1.0]).orderBy("threshold").collect()]
    assert got == [(0, 4, 0, 4), (2, 2, 0, 4), (3, 1, 2, 2), (4, 0, 4, 0)]


def test_ties_go_to_the_largest_threshold_and_walk_is_complete(spark):
    s = scored(spark, [(0.9, 1), (0.5, 0), (0.4, 0), (0.3, 1)])
    assert metrics.best_f1(s).first().threshold == 0.9 or metrics.best_f1(s).first().f1 == pytest.approx(2 / 3)
    w = metrics.ranked_walk(s, 3).orderBy("k").collect()
    assert [r.k for r in w] == [1, 2, 3, 4] and w[-1].recall == 1


def test_clipped_log_loss_and_constant_bins(spark):
    assert metrics.scores(scored(spark, [(1, 0)])).first().log_loss == pytest.approx(-math.log1p(-(1 - 1e-15)))
    flat = scored(spark, [(0.25, i % 4 == 0) for i in range(40)])
    b = metrics.bin_summary(flat, 10).collect()
    assert len(b) == 1 and b[0].n == 40 and metrics.ece(flat).first().ece == pytest.approx(0)
    with pytest.raises(ValueError, match="strategy"):
        metrics.edges(flat, 5, "other")


@pytest.mark.parametrize(("rows", "said"), [([], "no rows"), ([(1.5, 1)], "outside"), ([(float("nan"), 1)], "NaN"), ([(0.5, 2)], "label")])
def test_bad_inputs_are_told_apart(spark, rows, said):
    with pytest.raises(ValueError, match=said):
        metrics.validate(scored(spark, rows))


def test_decompositions_add_up(spark):
    rng = np.random.default_rng(2)
    p = rng.beta(2, 6, 3000)
    s = scored(spark, zip(p, rng.random(3000) < p, strict=True))
    for f in (metrics.brier_decomposition, metrics.log_loss_decomposition):
        d = f(s).first()
        assert d.score == pytest.approx(d.calibration - d.resolution + d.uncertainty + d.residual)
        assert abs(d.residual) < 0.01 and d.calibration < 0.02
    both = [tuple(r) for r in metrics.ranked_walk(s, 7).orderBy("k").collect()]
    assert both == [tuple(r) for r in metrics.ranked_walk(s.repartition(5), 64).orderBy("k").collect()]


def test_no_banned_names():
    assert not [n for n in dir(metrics) if "roc" in n.lower() or "accuracy" in n.lower()]


# --- coins, samplers, splits


def test_coins_do_not_depend_on_partitions(spark):
    u = lambda n: {r.id: r.u for r in spark.range(0, 500, 1, n).select("id", coins.coin("k", "p", 3, F.col("id")).alias("u")).collect()}
    assert u(2) == u(7)
    assert u(2)[9] == int(hashlib.md5(b"k|p|3|9").hexdigest()[:13], 16) / 2**52
    z = np.array([r.z for r in spark.range(4000).select(coins.gaussian("k", "g", 0, F.col("id")).alias("z")).collect()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05


def test_samplers(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    with pytest.raises(RuntimeError):
        sampling.poisson_batch(rows, 0.5, "k", 0, cap=10)
    assert sampling.poisson_truncated_batch(rows, 0.5, 10, "k", 0).count() == 10
    d = sampling.dyadic_batch(rows, 3, "k", 1).collect()
    assert [sum(r.half == h for r in d) for h in ("odd", "even", "single")] == [8, 8, 1]
    assert len({r.row_id for r in d if r.half != "single"}) == 16
    e = sampling.epoch_batches(rows, 64, "k", 0).collect()
    assert len(e) == 15 * 64 and len({r.row_id for r in e}) == len(e)
    assert sampling.max_scale(64) == 5 and sum(sampling.dyadic_probabilities(5)) == pytest.approx(1)


@pytest.mark.parametrize(("n", "f"), [(10, 0.25), (7, 0.5), (101, 0.2), (3, 0.0), (5, 1.0)])
def test_exact_split(spark, n, f):
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    got = {r.row_id for r in prep.exact_split(rows, "k", f).where("split = 'test'").collect()}
    assert len(got) == round(n * f)
    assert got == {r.row_id for r in prep.exact_split(rows.repartition(3), "k", f).where("split = 'test'").collect()}


def test_norm_cap_warns_and_bounds(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.1, 0.0],)], "x array<double>")
    assert sorted(r.x for r in prep.norm_capped(rows, 1.0).collect()) == [[0.1, 0.0], [pytest.approx(0.6), pytest.approx(0.8)]]
    with pytest.warns(UserWarning, match="not finite"):
        prep.norm_capped(spark.createDataFrame([([float("nan")],)], "x array<double>"), 1.0)
    with pytest.raises(ValueError, match="positive"):
        prep.norm_capped(rows, 0)


# --- gradients, projections, updates


def test_linear_identity_equals_the_generic_path(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    rows = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x], "x1 double, x2 double, y int")
    model = stages.Linear((0.5, -1.0), 0.2)

    def per_batch(x, y):
        r = 1 / (1 + np.exp(-(x @ np.array(model.w) + model.b))) - y
        return np.column_stack([r[:, None] * x, r])

    a = stages.gradient_sum(rows, stages.Logistic(), model, ("x1", "x2"), 0.4)
    assert np.allclose(a, stages.gradient_sum_by(rows, ("x1", "x2"), per_batch, 0.4))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20), st.floats(0, 30))
def test_projection_is_in_the_ball_and_idempotent(v, radius):
    p = updates.l1_projected_vector(np.array(v), radius)
    assert np.abs(p).sum() <= radius + 1e-9 or np.array_equal(p, v)
    assert np.allclose(updates.l1_projected_vector(p, radius + 1e-12), p, atol=1e-9)


def test_projection_golden_and_windows(spark):
    assert np.allclose(updates.l1_projected_vector(np.array([3.0, -4.0, 1.0]), 2), [0.5, -1.5, 0])
    long = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, -4.0, 1.0])], "i int, value double")
    assert [r.value for r in updates.l1_projected(long, 2.0).orderBy("i").collect()] == pytest.approx([0.5, -1.5, 0])
    with pytest.raises(ValueError, match="negative"):
        updates.l1_projected_vector(np.zeros(2), -1)
    with pytest.raises(ValueError, match="parameters"):
        updates.L1Projected(updates.Sgd(1.0), 1.0).update(np.zeros(2), 0)


# --- accounting


@pytest.mark.parametrize(("z", "target"), [(2.750093, 0.5), (1.611770, 1.0), (0.931127, 3.0)])
def test_composed_renyi(z, target):
    build = acc.spider_schedules(100_000, 2000, 500, 2000, 20)
    assert acc.epsilon(build(z), 1e-6) == pytest.approx(target, rel=1e-3)


@pytest.mark.parametrize(("z", "target"), [(2.562007, 0.5), (1.507924, 1.0), (0.868438, 3.0)])
def test_composed_privacy_loss(z, target):
    assert acc.epsilon(acc.spider_schedules(100_000, 2000, 500, 2000, 20)(z), 1e-6, "pld") == pytest.approx(target, rel=3e-3)


def test_more_accounting():
    assert acc.sampled_epsilon(0.1, 2.0, 200, 1e-5) == pytest.approx(3.68, abs=0.005)
    assert acc.calibrated(lambda z: [acc.Schedule(1024 / 700_000, z, 3000)], 1.0, 1e-12) == pytest.approx(1.4243, rel=1e-3)
    assert acc.epsilon([], 1e-5) == 0 == acc.epsilon([acc.Schedule(0.1, 1, 0)], 1e-5)
    assert [acc.release_counts(*x) for x in ((2, 1000), (21, 20), (50, 1))] == [(1, 1), (2, 19), (50, 0)]
    c = acc.lipschitz(2.0, has_bias=True)
    assert (round(c.l0, 6), c.l1, c.step_size) == (2.236068, 1.25, 0.4)
    assert acc.inner_multiplier(1.0, 1e-12) == pytest.approx(250.4, abs=0.05)
    for bad in (lambda: acc.Schedule(0, 1, 1), lambda: acc.epsilon([acc.Schedule(0.1, 1, 1)], 0), lambda: acc.calibrated(lambda z: [acc.Schedule(1.0, z, 1)], 1e-9, 1e-6), lambda: acc.inner_multiplier(2.0, 0.1)):
        with pytest.raises(ValueError):
            bad()
    n = acc.spider_noise(100_000, 2000, 500, 200, 20, c, 1.0, 1e-6)
    assert acc.spider_epsilon(100_000, 2000, 500, 200, 20, c, n, 1e-6) == pytest.approx(1.0, rel=1e-5)
    with pytest.raises(ValueError, match="different"):
        acc.spider_epsilon(100_000, 2000, 500, 200, 20, c, acc.NoiseScales(n.anchor, n.variation_rate, 2 * n.variation_cap), 1e-6)


# --- loops


def test_training_lowers_the_loss_and_seeds_reproduce(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), int(a - b > 0)) for i, (a, b) in enumerate(x)], "row_id long, x1 double, x2 double, y int").cache()
    f, loss = ("x1", "x2"), stages.Logistic()
    value = lambda m: rows.agg(F.avg(loss.value(stages.logit(m, f), F.col("y")))).first()[0]
    start = stages.Linear.start(2, 0)
    run = lambda: training.dp_sgd_train(loss, start, updates.Sgd(1.0), rows, f, steps=4, expected=100, clip=1.0, multiplier=0.5, key="k", noise_seed=1)
    a = run()
    assert a == run() and value(a) < value(start)
    s = training.sgd_train(loss, start, updates.Adam(0.2), rows, f, steps=3, batch=100, key="k")
    assert value(s) < value(start)
    out, last = training.spider_train(loss, start, updates.Sgd(1.0), rows, f, steps=3, interval=2, anchor=200, variation=100, scales=acc.NoiseScales(0, 0, 0), key="k")
    assert out != last and value(last) < value(start)
    b = training.bias_reduced_train(loss, start, updates.Sgd(0.01), rows, f, max_steps=2, epsilon=1.0, delta=1e-2, clip=1.0, radius=1.0, key="k", noise_seed=2, top=3)
    assert b.steps == b.spent.steps <= 2
    swept = training.sweep(spark.createDataFrame([(i, 0.1 * i) for i in range(4)], "config_id long, rate double"), lambda c: {"config_id": c["config_id"], "twice": 2 * c["rate"]}, "config_id long, twice double")
    assert {r.config_id: r.twice for r in swept.collect()}[3] == pytest.approx(0.6)


# --- sources and streams


def test_fetch_checks_digests(tmp_path):
    src = tmp_path / "a.bin"
    src.write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest().upper()
    to = tmp_path / "b.bin"
    assert tables.fetched(src.as_uri(), to, good).read_bytes() == b"abc"
    to.write_bytes(b"bad")
    assert tables.fetched(src.as_uri(), to, good).read_bytes() == b"abc"
    with pytest.raises(RuntimeError, match="digest"):
        tables.fetched(src.as_uri(), tmp_path / "c.bin", "00")
    assert not (tmp_path / "c.bin").exists()


def test_missing_input(spark):
    with pytest.raises(FileNotFoundError):
        tables.scan(spark, "/no/such.parquet", ["a"])


def test_ledger_stream(spark, tmp_path):
    from hushgrad.streaming import ledger

    spark.createDataFrame([(1, i) for i in range(8)] + [(2, 100)], "user_id long, event_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long").parquet(str(tmp_path / "in"))
    q = ledger.admitted(stream, 1.0, 1e-2, (0.05, 1e-4)).writeStream.format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = {(r.user_id, r.event_id): r.admitted for r in spark.table("ledger").collect()}
    spent, want = acc.Spent(), {}
    for i in range(8):
        want[1, i] = acc.permits(spent, (0.05, 1e-4), 1.0, 1e-2) and all(want.values())
        if want[1, i]:
            spent = spent.plus(0.05, 1e-4)
    assert rows == want | {(2, 100): True}
