"""Training loops: one DataFrame job a step, state on the driver. Loops return parameters, never metrics.

Sweeps of many small runs go the other way about: one task holds a run, see sweep().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import accounting, sampling, stages, updates


def source_of(loss, features: Sequence[str] | None) -> stages.Gradients:
    """The gradients that a loop sums: given as such, or those of a loss over feature columns."""
    return loss if hasattr(loss, "totals") else stages.Dense(loss, tuple(features))


def sgd_train(loss, params, optimizer, rows: DataFrame, features: Sequence[str] | None = None, *, steps: int, batch: int, key: str):
    """Mean gradients of shuffled full batches.

    An epoch is kept with each batch's rows side by side, so a step reads its own batch and skips the others' blocks.
    """
    source, n = source_of(loss, features), rows.count()
    v, state, done = params.vector, optimizer.init(params.vector), 0
    for _, epoch in sampling.epochs(rows, batch, key):
        if done == steps:
            break
        epoch = epoch.repartitionByRange("batch_id").sortWithinPartitions("batch_id").persist()
        try:
            for b in range(min(n // batch, steps - done)):
                g = source.sums(epoch.where(F.col("batch_id") == b), v, None) / batch
                inc, state = optimizer.update(g, state, v)
                v, done = v + inc, done + 1
        finally:
            epoch.unpersist()
    return type(params).of(v)


def dp_sgd_release(rows: DataFrame, loss, params, features: Sequence[str] | None = None, *, rate: float, clip: float, multiplier: float, expected: float, key: str, step: int, noise: stages.Noise, cap: int | None = None) -> np.ndarray:
    """(sum of clipped gradients + noise) / expected size."""
    sums, n = source_of(loss, features).totals(sampling.poisson_batch(rows, rate, key, step), params.vector, clip)
    if cap is not None and n > cap:
        raise RuntimeError(f"the draw has {n} rows; at most {cap} were provided for")
    return stages.fixed_divisor_mean(sums + noise.gaussian(len(sums), multiplier * clip), expected)


def dp_sgd_train(loss, params, optimizer, rows: DataFrame, features: Sequence[str] | None = None, *, steps: int, expected: float, clip: float, multiplier: float, key: str, noise_seed: int | None = None, noise: stages.Noise | None = None, cap: int | None = None):
    """Poisson batches at rate expected / n; draws above the cap raise. The default cap is one that no fair draw meets."""
    n = rows.count()
    if not 0 < expected <= n:
        raise ValueError("the expected batch size must lie in (0, rows]")
    if cap is not None and cap < expected:
        raise ValueError("the cap must not be below the expected batch size")
    cap, noise = cap or sampling.poisson_cap(expected, n), noise or stages.Noise(noise_seed)
    v, state = params.vector, optimizer.init(params.vector)
    for t in range(steps):
        g = dp_sgd_release(rows, loss, type(params).of(v), features, rate=expected / n, clip=clip, multiplier=multiplier, expected=expected, key=key, step=t, noise=noise, cap=cap)
        inc, state = optimizer.update(g, state, v)
        v = v + inc
    return type(params).of(v)


def spider_train(loss, params, optimizer, rows: DataFrame, features: Sequence[str] | None = None, *, steps: int, interval: int, anchor: float, variation: float, scales: accounting.NoiseScales, key: str, seed: int = 0, noise_seed: int | None = None, noise: stages.Noise | None = None) -> tuple:
    """Anchors replace the running estimate, variations add to it; returns a uniformly chosen iterate and the last one.

    The first is one of w_1 .. w_(steps-1). Gradients are not clipped: their norms are bounded by the features' bound.
    """
    if steps < 2 or interval < 1:
        raise ValueError("two steps and an interval of one are the least")
    source, n, noise = source_of(loss, features), rows.count(), noise or stages.Noise(noise_seed)
    chosen = spider_choice(steps, seed)
    v = before = params.vector
    estimate, state, output = None, optimizer.init(v), None
    for t in range(steps):
        if t % interval == 0:
            drawn = sampling.poisson_batch(rows, anchor / n, key, t)
            estimate = source.sums(drawn, v, None) / anchor + noise.gaussian(len(v), scales.anchor)
        else:
            drawn = sampling.poisson_batch(rows, variation / n, key, t)
            d = source.difference(drawn, v, before) / variation
            std = min(scales.variation_rate * float(np.linalg.norm(v - before)), scales.variation_cap)
            estimate = estimate + d + noise.gaussian(len(v), std)
        inc, state = optimizer.update(estimate, state, v)
        before, v = v, v + inc
        if t + 1 == chosen:
            output = v
    return type(params).of(output), type(params).of(v)


def spider_choice(steps: int, seed: int) -> int:
    """Which iterate a run of so many steps returns."""
    return int(np.random.default_rng(seed).integers(1, steps))


@dataclass(frozen=True)
class MeanEstimator:
    """A private mean of clipped gradients: Gaussian noise of std multiplier * 2 clip / k, then the l1 ball."""

    clip_norm: float
    radius: float
    noise_multiplier: float
    name: str = "projection"

    def __post_init__(self):
        if not self.clip_norm > 0:
            raise ValueError("the clipping norm must be positive")
        if self.radius < 0 or self.noise_multiplier < 0:
            raise ValueError("the radius and the noise multiplier must not be negative")

    @property
    def claim(self) -> accounting.GaussianClaim:
        """What one call releases, for the accountant to check."""
        return accounting.GaussianClaim(self.clip_norm, self.noise_multiplier)

    def __call__(self, sums: np.ndarray, k: int, noise: stages.Noise) -> np.ndarray:
        return updates.l1_projected_vector(sums / k + noise.gaussian(len(sums), self.noise_multiplier * 2 * self.clip_norm / k), self.radius)


def dyadic_sums(batch: DataFrame, loss, params: stages.Linear, features: Sequence[str], clip: float) -> DataFrame:
    """Clipped sums over whole, odd, even and single in one pass: columns whole_<c>, odd_<c>, ..."""
    g = stages.gradients(batch, loss, params, features, clip)
    parts = {"whole": F.col("half") != "single", "odd": F.col("half") == "odd", "even": F.col("half") == "even", "single": F.col("half") == "single"}
    return g.agg(*[c for name, where in parts.items() for c in stages.summed(g, features, where=where, names=lambda x, name=name: f"{name}_{x}")])


def half_sums(source: stages.Gradients, batch: DataFrame, v: np.ndarray, clip: float) -> list[np.ndarray]:
    """Clipped sums over whole, odd, even and single: one pass for dense models, one for each part for others."""
    if isinstance(source, stages.Dense):
        return list(stages.vector(dyadic_sums(batch, source.loss, stages.Linear.of(v), source.features, clip)).reshape(4, -1))
    odd, even, single = (source.sums(batch.where(F.col("half") == h), v, clip) for h in ("odd", "even", "single"))
    return [odd + even, odd, even, single]


def debiased(whole: np.ndarray, odd: np.ndarray, even: np.ndarray, single: np.ndarray, probability: float) -> np.ndarray:
    if not 0 < probability <= 1:
        raise ValueError("the probability must lie in (0, 1]")
    return (whole - (odd + even) / 2) / probability + single


@dataclass(frozen=True)
class Run:
    """Parameters of the type that the run began with."""

    average: object
    random: object
    final: object
    steps: int
    spent: accounting.Spent


def bias_reduced_train(loss, params, optimizer, rows: DataFrame, features: Sequence[str] | None = None, *, max_steps: int, epsilon: float, delta: float, clip: float, radius: float, key: str, seed: int = 0, noise_seed: int | None = None, noise: stages.Noise | None = None, top: int | None = None, estimator: Callable = MeanEstimator) -> Run:
    """Coin, price, filter, draw, release, update, charge; until the filter refuses or max_steps are done.

    average and random are over x^0 .. x^T, the latter a reservoir of one. estimator takes clip_norm, radius and
    noise_multiplier; what it claims must be the Gaussian release that a step is priced as.
    """
    source, n = source_of(loss, features), rows.count()
    top = sampling.max_scale(n) if top is None else min(top, sampling.max_scale(n))
    multiplier = accounting.inner_multiplier(epsilon, delta)
    mean = estimator(clip_norm=clip, radius=radius, noise_multiplier=multiplier)
    accounting.check_claim(getattr(mean, "claim", None), clip, multiplier)
    rng, noise, chances = np.random.default_rng(seed), noise or stages.Noise(noise_seed), sampling.dyadic_probabilities(top)
    v = params.vector
    state, spent, average, kept, seen = optimizer.init(v), accounting.Spent(), v.copy(), v, 1
    for t in range(max_steps):
        scale = sampling.dyadic_scale(top, rng.random())
        cost = accounting.step_cost(scale, n, epsilon, delta)
        if not accounting.permits(spent, cost, epsilon, delta):
            break
        sums = half_sums(source, sampling.dyadic_batch(rows, scale, key, t), v, clip)
        size = 2 ** (scale + 1)
        whole, odd, even, single = (mean(s, k, noise) for s, k in zip(sums, (size, size // 2, size // 2, 1), strict=True))
        inc, state = optimizer.update(debiased(whole, odd, even, single, chances[scale]), state, v)
        v, spent, seen = v + inc, spent.plus(*cost), seen + 1
        average += (v - average) / seen
        if rng.random() < 1 / seen:
            kept = v
    of = type(params).of
    return Run(of(average), of(kept), of(v), spent.steps, spent)


def sweep(configs: DataFrame, run: Callable[[dict], dict], schema: str) -> DataFrame:
    """One run for each row of configs, each in one task: run takes a row and returns the result's columns."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [run(c) for c in b.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows])

    return configs.repartition(max(1, configs.count())).mapInArrow(each, schema)
