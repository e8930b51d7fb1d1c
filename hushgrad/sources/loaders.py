"""Loaders: rows with a split become train and test rows of features, dense or one-hot, along independent axes.

The axes: which features (numeric, or numbers and codes), prepared or raw, standardized or not, and a bound on each
row's norm or none. What is fitted is fitted on the train rows only. Metadata says what was done, with the statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrad.operators import prep

FEATURES = ("numeric", "all")


@dataclass(frozen=True)
class DenseSplit:
    """rows: the row's id, split, y and one double for each feature."""

    rows: DataFrame
    features: tuple[str, ...]
    meta: dict = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.rows.where("split = 'train'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("split = 'test'").drop("split")


@dataclass(frozen=True)
class SparseSplit:
    """rows: the row's id, split, y, idx array<int> and val array<double>; indices lie below width."""

    rows: DataFrame
    width: int
    meta: dict = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.rows.where("split = 'train'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("split = 'test'").drop("split")


def dense_split(rows: DataFrame, features: Sequence[str], meta: dict | None = None, row: str = "row_id") -> DenseSplit:
    """Rows as they are, with features cast to double."""
    return DenseSplit(rows.select(row, "split", "y", *[F.col(c).cast("double").alias(c) for c in features]), tuple(features), dict(meta or {}))


def sparse_split(rows: DataFrame, width: int, meta: dict | None = None, row: str = "row_id") -> SparseSplit:
    """Rows of idx and val as they are, cast. A row whose arrays differ in size, or whose index lies outside, is an error when it is read."""
    idx, val = F.col("idx").cast("array<int>"), F.col("val").cast("array<double>")
    fine = (F.size(idx) == F.size(val)) & F.forall(idx, lambda i: (i >= 0) & (i < width))
    checked = F.when(fine, idx).otherwise(F.raise_error(F.lit(f"idx and val must be of one size, with indices below {width}")).cast("array<int>"))
    return SparseSplit(rows.select(row, "split", "y", checked.alias("idx"), val.alias("val")), width, dict(meta or {}))


def _numbers(rows: DataFrame, numeric: Sequence[str], prepared: bool) -> DataFrame:
    return prep.integer_chain(rows, list(numeric)) if prepared else rows.withColumns({c: prep.present(F.col(c).cast("double")) for c in numeric})


def load(rows: DataFrame, numeric: Sequence[str], codes: Sequence[str], *, features: str = "all", prepared: bool = True, standard: bool = False, bound: float | None = None, row: str = "row_id") -> DenseSplit:
    """Dense features: numbers, and by `features` each code column as f_<code>.

    Prepared numbers are filled with train medians, clipped at zero and logged, and prepared codes are their train
    frequencies; raw ones are as they are. standard: train mean 0 and deviation 1. bound: no row's norm exceeds it.
    """
    if features not in FEATURES:
        raise ValueError(f"features must be one of {FEATURES}")
    names = [*numeric]
    if features == "all":
        for c in codes:
            rows = prep.frequency_encoded(rows, c, f"f_{c}") if prepared else rows.withColumn(f"f_{c}", F.col(c).cast("double"))
            names.append(f"f_{c}")
    rows = _numbers(rows, numeric, prepared)
    if standard:
        rows = prep.standardized(rows, names)
    rows = rows.select(row, "split", "y", F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    if bound is not None:
        rows = prep.norm_capped(rows, bound)
    meta = {"features": features, "prepared": prepared, "standard": standard, "bound": bound}
    return dense_split(rows.select(row, "split", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(names)]), names, meta, row)


def load_one_hot(rows: DataFrame, numeric: Sequence[str], codes: Sequence[str], *, prepared: bool = True, bound: float | None = None, row: str = "row_id") -> SparseSplit:
    """Sparse features: the numbers at indices 0 to n - 1, then one 1.0 for each code column, at its code's index.

    Codes that no train row has share one index behind their column's vocabulary. bound: no row's norm exceeds it, which
    scales the ones as well. Metadata holds each column's first index and number of codes.
    """
    rows, layout = prep.one_hot_index(_numbers(rows, numeric, prepared), list(codes), len(numeric))
    rows = prep.sparse_rows(rows, list(numeric), list(codes))
    if bound is not None:
        rows = prep.norm_capped(rows, bound, "val")
    return sparse_split(rows, len(numeric) + sum(n + 1 for _, n in layout.values()), {"layout": layout, "prepared": prepared, "bound": bound}, row)
