"""Prices of private runs: Renyi and privacy-loss accountants, calibration, shared noise, privacy filter.

Nothing here reads data. Every price names its mechanism: Poisson-subsampled Gaussian releases under add-or-remove
neighbours for epsilon(), fixed draws without replacement under advanced composition for the filter.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: The orders at which Renyi divergences are taken; the grid is part of every number.
ORDERS = np.array([*np.round(np.arange(1.1, 8.0, 0.1), 1), *range(8, 257)])
LOWEST, HIGHEST = 1e-2, 1e4


@dataclass(frozen=True)
class Schedule:
    """`releases` Gaussian releases at a sampling rate and a noise multiplier."""

    rate: float
    multiplier: float
    releases: int

    def __post_init__(self):
        if not 0 < self.rate <= 1:
            raise ValueError("the rate must lie in (0, 1]")
        if not self.multiplier > 0:
            raise ValueError("the multiplier must be positive")
        if self.releases < 0:
            raise ValueError("the releases must not be negative")


def _check_delta(delta: float) -> None:
    if not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")


def renyi(rate: float, z: float, orders: np.ndarray = ORDERS) -> np.ndarray:
    """Renyi divergences of the Poisson-subsampled Gaussian (Mironov, Talwar, Zhang 2019), by quadrature."""
    if rate == 1:
        return orders / (2 * z * z)
    out = np.empty(len(orders))
    for i, a in enumerate(orders):
        # Where exp(a x / z^2) carries the mass the integrand peaks near x = a; the grid covers both ends widely.
        x = np.linspace(-14 * z - 2, 14 * z + a + 2, 60_001)
        log_ratio = np.logaddexp(np.log1p(-rate), np.log(rate) + (2 * x - 1) / (2 * z * z))
        g = a * log_ratio - x * x / (2 * z * z)
        top = g.max()
        out[i] = (top + np.log(np.trapezoid(np.exp(g - top), x)) - math.log(z * math.sqrt(2 * math.pi))) / (a - 1)
    return np.maximum(out, 0)


def _renyi_epsilon(schedules: Sequence[Schedule], delta: float) -> float:
    total = sum(s.releases * renyi(s.rate, s.multiplier) for s in schedules)
    # Canonne, Kamath, Steinke 2020.
    eps = total + np.log1p(-1 / ORDERS) - (math.log(delta) + np.log(ORDERS)) / (ORDERS - 1)
    fine = ~np.isnan(eps)
    if not fine.any():
        raise ValueError("no order gave a number")
    if not fine.all():
        warnings.warn(f"{(~fine).sum()} of {len(ORDERS)} orders gave no number and were left out, from {ORDERS[~fine].min():g} on", stacklevel=3)
    return max(0.0, float(eps[fine].min()))


def _loss_epsilon(schedules: Sequence[Schedule], delta: float, step: float = 2e-4, points: int = 1 << 19) -> float:
    """Losses on a grid, composed by Fourier transforms; the worse of both directions.

    A close estimate, not a bound: losses are taken in the middle of small cells, and masses are interpolated. Mass
    that falls off the grid counts as a certain failure.
    """
    half = points // 2
    out = 0.0
    for remove in (True, False):
        log_f = np.zeros(points // 2 + 1, dtype=complex)
        lost = 0.0
        for s in schedules:
            z, q = s.multiplier, s.rate
            x = np.linspace(-12 * z - 1, 12 * z + 2, 400_001)
            mid = (x[1:] + x[:-1]) / 2
            cdf = np.vectorize(math.erf)(np.linspace(-9, 9, 20_001) / math.sqrt(2)) / 2 + 0.5
            phi = lambda t, c=cdf: np.interp(t, np.linspace(-9, 9, 20_001), c)
            base, mixed = np.diff(phi(x / z)), None
            mixed = (1 - q) * base + q * np.diff(phi((x - 1) / z))
            loss = np.logaddexp(np.log1p(-q) if q < 1 else -np.inf, math.log(q) + (2 * mid - 1) / (2 * z * z))
            mass, loss = (mixed, loss) if remove else (base, -loss)
            # Mass between two grid points goes to both so that it keeps its sum under either distribution
            # (Doroshenko et al. 2022): off by the square of the step only.
            at = np.floor(loss / step).astype(np.int64)
            up = mass * np.expm1(-(loss - at * step)) / np.expm1(-step)
            keep = np.abs(at) < half - 1
            lost += s.releases * max(0.0, 1 - mass[keep].sum())
            pmf = np.bincount(at[keep] % points, (mass - up)[keep], points) + np.bincount((at[keep] + 1) % points, up[keep], points)
            log_f += s.releases * np.log(np.fft.rfft(pmf) + 0j)
        pmf = np.maximum(np.fft.irfft(np.exp(log_f), points), 0)
        grid = np.where(np.arange(points) < half, np.arange(points), np.arange(points) - points) * step
        order = np.argsort(grid)
        grid, pmf = grid[order], pmf[order]
        tail, weighted = np.cumsum(pmf[::-1])[::-1], np.cumsum((pmf * np.exp(-np.clip(grid, -50, None)))[::-1])[::-1]
        d = tail - np.exp(np.minimum(grid, 50)) * weighted + max(0.0, lost)
        fine = np.flatnonzero((grid >= 0) & (d <= delta))
        out = max(out, float(grid[fine[0]]) if len(fine) else math.inf)
    return out


def epsilon(schedules: Sequence[Schedule], delta: float, method: str = "rdp") -> float:
    """The epsilon of all schedules together at delta, in any order; none of them costs 0."""
    _check_delta(delta)
    if method not in ("rdp", "pld"):
        raise ValueError("method must be 'rdp' or 'pld'")
    live = [s for s in schedules if s.releases]
    if not live:
        return 0.0
    return _renyi_epsilon(live, delta) if method == "rdp" else _loss_epsilon(live, delta)


def sampled_epsilon(rate: float, multiplier: float, releases: int, delta: float, method: str = "rdp") -> float:
    return epsilon([Schedule(rate, multiplier, releases)], delta, method)


def truncated_epsilon(rate: float, multiplier: float, releases: int, delta: float, method: str = "rdp") -> float:
    """The number of the untruncated mechanism; for truncated draws it is not a bound."""
    return sampled_epsilon(rate, multiplier, releases, delta, method)


def calibrated(build: Callable[[float], Sequence[Schedule]], target: float, delta: float, method: str = "rdp") -> float:
    """The smallest multiplier whose schedules cost at most the target."""
    _check_delta(delta)
    if not target > 0:
        raise ValueError("epsilon must be positive")
    if not any(s.releases for s in build(1.0)):
        raise ValueError("there is nothing to release")
    cost = lambda z: epsilon(build(z), delta, method)
    high = 1.0
    if cost(high) > target:
        while cost(high) > target:
            high *= 2
            if high > HIGHEST:
                raise ValueError("no noise reaches this epsilon")
        low = high / 2
    else:
        low = high / 2
        while cost(low) <= target:
            high, low = low, low / 2
            if low < LOWEST:
                raise ValueError("the target is so loose that it is meaningless")
    while high / low > 1 + 1e-7:
        mid = math.sqrt(low * high)
        low, high = (low, mid) if cost(mid) <= target else (mid, high)
    return high


def release_counts(steps: int, interval: int) -> tuple[int, int]:
    """Anchor and variation releases of a run."""
    if steps < 1 or interval < 1:
        raise ValueError("steps and interval must be positive")
    anchors = -(-steps // interval)
    return anchors, steps - anchors


@dataclass(frozen=True)
class Lipschitz:
    l0: float
    l1: float
    step_size: float


def lipschitz(bound: float, *, has_bias: bool) -> Lipschitz:
    """Constants of the logistic loss for features of norm at most the bound."""
    if not 0 < bound < math.inf:
        raise ValueError("the bound must be positive and finite")
    r = bound * bound + has_bias
    return Lipschitz(math.sqrt(r), r / 4, 1 / (2 * (r / 4)))


def spider_schedules(rows: int, anchor: int, variation: int, steps: int, interval: int) -> Callable[[float], list[Schedule]]:
    if not 0 < anchor <= rows or not 0 < variation <= rows:
        raise ValueError("batches must lie in (0, rows]")
    anchors, variations = release_counts(steps, interval)
    return lambda z: [Schedule(anchor / rows, z, anchors), Schedule(variation / rows, z, variations)]


@dataclass(frozen=True)
class NoiseScales:
    anchor: float
    variation_rate: float
    variation_cap: float


def spider_noise(rows: int, anchor: int, variation: int, steps: int, interval: int, constants: Lipschitz, target: float, delta: float, method: str = "rdp") -> NoiseScales:
    """Noise of anchors, of variations by the distance moved, and its cap, from one shared multiplier."""
    m = calibrated(spider_schedules(rows, anchor, variation, steps, interval), target, delta, method)
    return NoiseScales(m * constants.l0 / anchor, m * constants.l1 / variation, 2 * m * constants.l0 / variation)


def spider_epsilon(rows: int, anchor: int, variation: int, steps: int, interval: int, constants: Lipschitz, noise: NoiseScales, delta: float, method: str = "rdp", align: bool = True) -> float:
    """The inverse; noise whose cap and rate disagree is refused, or priced at the weaker of both, with a warning."""
    if not (noise.anchor > 0 and noise.variation_rate > 0 and noise.variation_cap > 0):
        raise ValueError("noise scales must be positive")
    by_rate, by_cap = variation * noise.variation_rate / constants.l1, variation * noise.variation_cap / (2 * constants.l0)
    if not math.isclose(by_rate, by_cap, rel_tol=1e-9):
        if align:
            raise ValueError("the variation's rate and cap stand for different multipliers")
        warnings.warn("the variation's rate and cap stand for different multipliers; the weaker one is priced", stacklevel=2)
    anchors, variations = release_counts(steps, interval)
    return epsilon([Schedule(anchor / rows, noise.anchor * anchor / constants.l0, anchors), Schedule(variation / rows, min(by_rate, by_cap), variations)], delta, method)


def _check_budget(eps: float, delta: float) -> None:
    if not 0 < eps <= 1:
        raise ValueError("epsilon must lie in (0, 1]")
    _check_delta(delta)


@dataclass(frozen=True)
class GaussianClaim:
    """A Gaussian release of a mean of gradients clipped to a norm: noise of multiplier * 2 clip_norm / batch size."""

    clip_norm: float
    noise_multiplier: float


def check_claim(claim: object, clip_norm: float | None = None, noise_multiplier: float | None = None) -> None:
    """Refuses an estimator that is not the mechanism which steps are priced as, or has other numbers than the run's."""
    if not isinstance(claim, GaussianClaim):
        raise ValueError(f"a step is priced as Gaussian releases of means; a claim of {type(claim).__name__} is something else")
    if clip_norm is not None and not math.isclose(claim.clip_norm, clip_norm):
        raise ValueError(f"the claim's clip_norm is {claim.clip_norm}, the run clips to {clip_norm}")
    if noise_multiplier is not None and claim.noise_multiplier < noise_multiplier * (1 - 1e-12):
        raise ValueError(f"the claim's noise_multiplier is {claim.noise_multiplier}, the run's price needs {noise_multiplier}")


def inner_multiplier(eps: float, delta: float) -> float:
    _check_budget(eps, delta)
    return 32 * math.sqrt(2 * math.log(20 / delta)) / eps


def step_cost(scale: int, rows: int, eps: float, delta: float) -> tuple[float, float]:
    """(epsilon, delta) of a step with a whole batch of 2**(scale + 1) rows, its halves and a single row."""
    share = (3 * 2 ** (scale + 1) + 1) / (16 * rows)
    return share * eps, share * delta


@dataclass(frozen=True)
class Spent:
    steps: int = 0
    squares: float = 0.0
    deltas: float = 0.0

    def plus(self, eps: float, delta: float) -> Spent:
        return Spent(self.steps + 1, self.squares + eps * eps, self.deltas + delta)

    def epsilon(self, delta: float) -> float:
        return math.sqrt(2 * math.log(4 / delta) * self.squares) + self.squares / 2


def permits(spent: Spent, cost: tuple[float, float], eps: float, delta: float) -> bool:
    """Whether the filter admits a step, counting its own cost."""
    after = spent.plus(*cost)
    return after.epsilon(delta) <= eps / 2 and after.deltas <= delta / 4
