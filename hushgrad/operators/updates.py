"""Optimizers on the driver's vectors, projection onto the l1 ball, and wrappers that project."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Optimizer(Protocol):
    def init(self, params: np.ndarray): ...

    def update(self, estimate: np.ndarray, state, params: np.ndarray | None = None) -> tuple[np.ndarray, object]: ...


class Sgd:
    """x - rate * g; the rate is a positive number or a function of how many updates there were."""

    def __init__(self, rate: float | Callable[[int], float]):
        if not callable(rate) and not rate > 0:
            raise ValueError("the rate must be positive")
        self.rate = rate if callable(rate) else lambda _: rate

    def init(self, params):
        return 0

    def update(self, estimate, state, params=None):
        return -self.rate(state) * estimate, state + 1


class Adam:
    """Kingma and Ba's rule."""

    def __init__(self, rate: float, first: float = 0.9, second: float = 0.999, tiny: float = 1e-8):
        self.rate, self.first, self.second, self.tiny = rate, first, second, tiny

    def init(self, params):
        return 0, np.zeros_like(params), np.zeros_like(params)

    def update(self, estimate, state, params=None):
        t, m, v = state
        t, m, v = t + 1, self.first * m + (1 - self.first) * estimate, self.second * v + (1 - self.second) * estimate**2
        return -self.rate * (m / (1 - self.first**t)) / (np.sqrt(v / (1 - self.second**t)) + self.tiny), (t, m, v)


def l1_projected_vector(v: np.ndarray, radius: float) -> np.ndarray:
    """The nearest point of the l1 ball (Duchi et al. 2008)."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    size = np.abs(v)
    if size.sum() <= radius:
        return v
    u = np.sort(size)[::-1]
    excess = np.cumsum(u) - radius
    rho = max(1, int((u * np.arange(1, len(u) + 1) > excess).sum()))
    return np.sign(v) * np.maximum(size - max(excess[rho - 1] / rho, 0.0), 0.0)


def l1_projected(rows: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """The same for vectors in long form (by..., i, value): one ball for each group, or one over all rows."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    part = Window.partitionBy(*(by or [F.lit(0)]))
    down = part.orderBy(F.desc(F.abs("value")), "i", *([] if by else [c for c in ("leaf",) if c in rows.columns]))
    run = rows.withColumn("size", F.abs("value")).withColumn("k", F.row_number().over(down)).withColumn("excess", F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, 0)) - radius)
    inside = F.sum("size").over(part) <= radius
    rho = F.greatest(F.sum((F.col("size") * F.col("k") > F.col("excess")).cast("int")).over(part), F.lit(1))
    theta = F.max(F.when(F.col("k") == F.col("rho"), F.greatest(F.col("excess") / F.col("rho"), F.lit(0.0)))).over(part)
    out = run.withColumn("inside", inside).withColumn("rho", rho).withColumn("theta", theta)
    return out.withColumn("value", F.when(F.col("inside"), F.col("value")).otherwise(F.signum("value") * F.greatest(F.col("size") - F.col("theta"), F.lit(0.0)))).select(*rows.columns)


class L1Projected:
    """Takes the inner step, then projects the parameters."""

    def __init__(self, inner: Optimizer, radius: float):
        if radius < 0:
            raise ValueError("the radius must not be negative")
        self.inner, self.radius = inner, radius

    def init(self, params):
        return self.inner.init(params)

    def update(self, estimate, state, params=None):
        if params is None:
            raise ValueError("projection needs the parameters")
        step, state = self.inner.update(estimate, state, params)
        return l1_projected_vector(params + step, self.radius) - params, state


class L1ProjectedEstimate:
    """Projects what comes in, then takes the inner step."""

    def __init__(self, inner: Optimizer, radius: float):
        if radius < 0:
            raise ValueError("the radius must not be negative")
        self.inner, self.radius = inner, radius

    def init(self, params):
        return self.inner.init(params)

    def update(self, estimate, state, params=None):
        return self.inner.update(l1_projected_vector(estimate, self.radius), state, params)
