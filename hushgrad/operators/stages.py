"""Forward, per-row gradients, clipping, aggregation and noise for models that are linear in their features.

A row's gradient is r * (x, 1), so it is never formed: its norm is |r| * sqrt(1 + |x|^2), clipping scales r, and the
clipped sum is a plain sum of k * x. Dense features are d columns; sparse ones an index and a value array, whose sums
group by index; their logits come from the broadcast weights, one Arrow batch at a time, so no row is exploded for a join. For
other models a gradient callback runs over Arrow batches. Dense, Sparse and Batched are what training loops take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushgrad.functions.coins import drawn_gaussian, gaussian, laplace

TINY = 1e-12
#: Weights of a sparse model that go to each task at most (256 MB).
MOST_WEIGHTS = 1 << 25


@dataclass(frozen=True)
class Linear:
    """Weights and bias."""

    w: tuple[float, ...]
    b: float = 0.0

    @classmethod
    def start(cls, d: int, seed: int) -> Linear:
        return cls(tuple(np.random.default_rng(seed).normal(0, 0.01, d).tolist()))

    @property
    def vector(self) -> np.ndarray:
        return np.array([*self.w, self.b])

    @classmethod
    def of(cls, v: np.ndarray) -> Linear:
        return cls(tuple(float(x) for x in v[:-1]), float(v[-1]))


@dataclass(frozen=True, eq=False)
class SparseLinear:
    """Weights by index, and a bias."""

    w: np.ndarray
    b: float = 0.0

    @classmethod
    def start(cls, width: int, seed: int) -> SparseLinear:
        return cls(np.random.default_rng(seed).normal(0, 0.01, width))

    @property
    def vector(self) -> np.ndarray:
        return np.append(self.w, self.b)

    @classmethod
    def of(cls, v: np.ndarray) -> SparseLinear:
        return cls(np.asarray(v[:-1], np.float64), float(v[-1]))


@dataclass(frozen=True, eq=False)
class Parameters:
    """The parameters of any other model, as one vector."""

    vector: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray) -> Parameters:
        return cls(np.asarray(v, np.float64))


class Loss(Protocol):
    def value(self, z: Column, y: Column) -> Column: ...

    def residual(self, z: Column, y: Column) -> Column: ...


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


class Logistic:
    def value(self, z: Column, y: Column) -> Column:
        return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))

    def residual(self, z: Column, y: Column) -> Column:
        return sigmoid(z) - y


class Squared:
    def value(self, z: Column, y: Column) -> Column:
        return 0.5 * (z - y) * (z - y)

    def residual(self, z: Column, y: Column) -> Column:
        return z - y


def total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def logit(model: Linear, features: Sequence[str]) -> Column:
    return total([F.lit(w) * F.col(c) for w, c in zip(model.w, features, strict=True)]) + F.lit(model.b)


def sparse_logits(rows: DataFrame, model: SparseLinear) -> DataFrame:
    """Adds z from index and value arrays; an index without a weight is an error.

    The weights are broadcast: MOST_WEIGHTS of them at most.
    """
    if len(model.w) > MOST_WEIGHTS:
        raise ValueError(f"{len(model.w)} weights; tasks hold {MOST_WEIGHTS} at most")
    sent, bias = rows.sparkSession.sparkContext.broadcast(np.asarray(model.w, np.float64)), model.b
    i, v = rows.columns.index("idx"), rows.columns.index("val")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            at, x = b.column(i).flatten().to_numpy(), b.column(v).flatten().to_numpy()
            if len(at) and (at.min() < 0 or at.max() >= len(w)):
                raise IndexError("an index lies outside the weights")
            row = np.repeat(np.arange(b.num_rows), b.column(i).value_lengths().to_numpy(zero_copy_only=False))
            z = np.bincount(row, w[at] * x, b.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], names=[*b.schema.names, "z"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("z", T.DoubleType())]))


def row_norm(features: Sequence[str]) -> Column:
    """The norm of (x, 1)."""
    return F.sqrt(total([F.col(c) * F.col(c) for c in features]) + 1.0)


def clip_factor(norm: Column, clip: float) -> Column:
    return F.least(F.lit(1.0), F.lit(clip) / (norm + TINY))


def gradients(rows: DataFrame, loss: Loss, model: Linear, features: Sequence[str], clip: float | None = None) -> DataFrame:
    """Adds r (the residual), norm (of the row's gradient) and k (the residual after clipping)."""
    r = loss.residual(logit(model, features), F.col("y").cast("double"))
    out = rows.withColumn("r", r).withColumn("norm", F.abs("r") * row_norm(features))
    return out.withColumn("k", F.col("r") * (clip_factor(F.col("norm"), clip) if clip is not None else 1.0))


def summed(rows: DataFrame, features: Sequence[str], scale: str = "k", where: Column | None = None, names: Callable[[str], str] = lambda c: f"g_{c}") -> list[Column]:
    k = F.col(scale) if where is None else F.when(where, F.col(scale)).otherwise(0.0)
    return [*[F.sum(k * F.col(c)).alias(names(c)) for c in features], F.sum(k).alias(names("b"))]


def sparse_gradients(rows: DataFrame, loss: Loss, model: SparseLinear, clip: float | None = None) -> DataFrame:
    """gradients() for rows of index and value arrays."""
    z = sparse_logits(rows, model)
    out = z.withColumn("r", loss.residual(F.col("z"), F.col("y").cast("double")))
    out = out.withColumn("norm", F.abs("r") * F.sqrt(F.aggregate("val", F.lit(1.0), lambda a, x: a + x * x)))
    return out.withColumn("k", F.col("r") * (clip_factor(F.col("norm"), clip) if clip is not None else 1.0)).drop("z")


def sparse_sums(rows: DataFrame, scale: str = "k") -> DataFrame:
    """(idx, g): sums of k * val by index; as many rows as indices that occur."""
    return rows.select(F.col(scale).alias("k"), F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("idx")).agg(F.sum(F.col("k") * F.col("e.val")).alias("g"))


def sparse_totals(rows: DataFrame, width: int, scale: str = "k") -> tuple[np.ndarray, int]:
    """The sums for all indices and for the bias behind them, and the number of rows, in one pass."""
    long = rows.select(F.col(scale).alias("k"), F.explode(F.arrays_zip(F.concat("idx", F.array(F.lit(width))).alias("idx"), F.concat("val", F.array(F.lit(1.0))).alias("val"))).alias("e"))
    got = long.groupBy(F.col("e.idx").alias("idx")).agg(F.sum(F.col("k") * F.col("e.val")).alias("g"), F.count("*").alias("n")).toArrow()  # as many rows as indices that occur
    out, at = np.zeros(width + 1), got.column("idx").to_numpy()
    out[at] = got.column("g").to_numpy()
    n = got.column("n").to_numpy()[at == width]
    return out, int(n[0]) if len(n) else 0


def vector(one: DataFrame) -> np.ndarray:
    """A one-row table of sums; sums of no rows are zero."""
    return np.array([0.0 if v is None else float(v) for v in one.first()])


def gradient_sum(rows: DataFrame, loss: Loss, model: Linear, features: Sequence[str], clip: float | None) -> np.ndarray:
    return vector(gradients(rows, loss, model, features, clip).agg(*summed(rows, features)))


def gradient_sum_by(rows: DataFrame, features: Sequence[str], per_batch: Callable[[np.ndarray, np.ndarray], np.ndarray], clip: float | None) -> np.ndarray:
    """The clipped sum of any model's gradients: per_batch(x, y) returns a gradient for each row of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                g = per_batch(np.stack([c.to_numpy() for c in b.columns[:-1]], axis=1), b.columns[-1].to_numpy())
                if clip is not None:
                    g = g * np.minimum(1.0, clip / (np.linalg.norm(g, axis=1) + TINY))[:, None]
                out = g.sum(axis=0) if out is None else out + g.sum(axis=0)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], names=["i", "g"])

    made = rows.select(*[F.col(c).cast("double") for c in features], F.col("y").cast("double")).mapInArrow(run, "i int, g double")
    return np.array([r.g for r in made.groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()])


class Gradients(Protocol):
    """What a training loop asks of a model and its loss; v is the parameters' vector."""

    def sums(self, rows: DataFrame, v: np.ndarray, clip: float | None) -> np.ndarray:
        """The sum of the rows' clipped gradients."""

    def totals(self, rows: DataFrame, v: np.ndarray, clip: float | None) -> tuple[np.ndarray, int]:
        """sums(), and how many rows there are."""

    def difference(self, rows: DataFrame, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The sum of the rows' gradients at now less those at before."""


@dataclass(frozen=True)
class Dense:
    """A linear model over columns: sums in one pass with partial aggregation."""

    loss: Loss
    features: Sequence[str]

    def sums(self, rows, v, clip):
        return gradient_sum(rows, self.loss, Linear.of(v), self.features, clip)

    def totals(self, rows, v, clip):
        *sums, n = gradients(rows, self.loss, Linear.of(v), self.features, clip).agg(*summed(rows, self.features), F.count("*").alias("n")).first()
        return np.array([0.0 if x is None else float(x) for x in sums]), n

    def difference(self, rows, now, before):
        return vector(rows.agg(*two_point_sums(rows, self.loss, Linear.of(now), Linear.of(before), self.features)))


@dataclass(frozen=True)
class Sparse:
    """A linear model over index and value arrays with so many indices."""

    loss: Loss
    width: int

    def sums(self, rows, v, clip):
        return self.totals(rows, v, clip)[0]

    def totals(self, rows, v, clip):
        return sparse_totals(sparse_gradients(rows, self.loss, SparseLinear.of(v), clip), self.width)

    def difference(self, rows, now, before):
        at = sparse_logits(rows, SparseLinear.of(now)).withColumnRenamed("z", "z_now")
        y, both = F.col("y").cast("double"), sparse_logits(at, SparseLinear.of(before))
        return sparse_totals(both.withColumn("k", self.loss.residual(F.col("z_now"), y) - self.loss.residual(F.col("z"), y)), self.width)[0]


@dataclass(frozen=True)
class Batched:
    """Any model over columns: per_batch(v, x, y) returns a gradient for each row of a batch."""

    per_batch: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    features: Sequence[str]

    def sums(self, rows, v, clip):
        per_batch = self.per_batch
        g = gradient_sum_by(rows, self.features, lambda x, y: per_batch(v, x, y), clip)
        return g if len(g) else np.zeros(len(v))

    def totals(self, rows, v, clip):
        return self.sums(rows, v, clip), rows.count()

    def difference(self, rows, now, before):
        return self.sums(rows, now, None) - self.sums(rows, before, None)


def two_point_sums(rows: DataFrame, loss: Loss, now: Linear, before: Linear, features: Sequence[str]) -> list[Column]:
    """Sums of g(now) - g(before) over the same rows, in one pass."""
    y = F.col("y").cast("double")
    d = loss.residual(logit(now, features), y) - loss.residual(logit(before, features), y)
    return [*[F.sum(d * F.col(c)).alias(f"g_{c}") for c in features], F.sum(d).alias("g_b")]


def fixed_divisor_mean(sums: np.ndarray, divisor: float) -> np.ndarray:
    """Private sums are divided by the expected size, never by the rows drawn."""
    return sums / divisor


def noised(leaves: DataFrame, key: str, step: int, scale: float, kind: str = "gaussian") -> DataFrame:
    """leaves (leaf, i, value) with noise from coins: one draw for each coordinate."""
    draw = {"gaussian": gaussian, "laplace": laplace}[kind]
    return leaves.withColumn("value", F.col("value") + F.lit(scale) * draw(key, kind, step, F.concat_ws("/", "leaf", F.col("i").cast("string"))))


class Noise:
    """The driver's noise for one training run."""

    def __init__(self, seed: int | None = None):
        self.rng = np.random.default_rng(seed)

    def gaussian(self, n: int, std: float) -> np.ndarray:
        return self.rng.normal(0, std, n) if std > 0 else np.zeros(n)

    def laplace(self, n: int, scale: float) -> np.ndarray:
        return self.rng.laplace(0, scale, n) if scale > 0 else np.zeros(n)


class CoinNoise(Noise):
    """Noise from keyed coins: a pure function of key, draw and coordinate, equal in any engine. md5 is for tests."""

    def __init__(self, key: str):
        self.key, self.draws = key, 0

    def gaussian(self, n: int, std: float) -> np.ndarray:
        out = std * np.array([drawn_gaussian(self.key, "noise", self.draws, i) for i in range(n)])
        self.draws += 1
        return out
