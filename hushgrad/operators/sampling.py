"""Batches as predicates over coins: who is drawn is a pure function of key, purpose, step and row."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushgrad.functions.coins import coin


def poisson_cap(expected: float, rows: int, deviations: float = 6.0) -> int:
    """Above this size a draw counts as a fault."""
    return min(math.ceil(expected + deviations * math.sqrt(expected * max(1 - expected / rows, 0)) + 4), rows)


def poisson_batch(rows: DataFrame, rate: float, key: str, step: int, row: str = "row_id", cap: int | None = None) -> DataFrame:
    """Each row by itself with probability `rate`. A draw above the cap raises; it is never cut."""
    drawn = rows.where(coin(key, "poisson", step, F.col(row)) < rate)
    if cap is not None and (n := drawn.count()) > cap:
        raise RuntimeError(f"the draw has {n} rows; at most {cap} were provided for")
    return drawn


def poisson_truncated_batch(rows: DataFrame, rate: float, most: int, key: str, step: int, row: str = "row_id") -> DataFrame:
    """A Poisson draw of which at most so many rows stay, by a second coin: another mechanism, priced apart."""
    return poisson_batch(rows, rate, key, step, row).withColumn("cut", coin(key, "truncate", step, F.col(row))).orderBy("cut", row).limit(most).drop("cut")


def max_scale(rows: int) -> int:
    if rows < 2:
        raise ValueError("two rows are needed")
    return rows.bit_length() - 2


def dyadic_probabilities(top: int) -> list[float]:
    """P(scale = k) in proportion to 2**-k, for k from 0 to top."""
    c = 1 / (2 * (1 - 2.0 ** -(top + 1)))
    return [c / 2**k for k in range(top + 1)]


def dyadic_pmf(rows: DataFrame, top: int) -> DataFrame:
    return rows.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("scale"), (F.lit(1 / (2 * (1 - 2.0 ** -(top + 1)))) / F.pow(F.lit(2.0), F.col("id"))).alias("probability"))


def dyadic_scale(top: int, u: float) -> int:
    """The inverse of the distribution at a uniform draw."""
    total = 0.0
    for k, p in enumerate(dyadic_probabilities(top)):
        total += p
        if u < total:
            return k
    return top


def dyadic_batch(rows: DataFrame, scale: int, key: str, step: int, row: str = "row_id") -> DataFrame:
    """2**(scale + 1) distinct rows tagged odd and even, half each, and one row tagged single that may be among them."""
    if scale < 0:
        raise ValueError("the scale must not be negative")
    size = 2 ** (scale + 1)
    taken = rows.withColumn("c", coin(key, "dyadic", step, F.col(row))).orderBy("c", row).limit(size)
    # The drawn rows are few: 2**(scale + 1) by choice of the caller.
    placed = taken.withColumn("n", F.row_number().over(Window.orderBy("c", row))).withColumn("half", F.when(F.col("n") <= size // 2, "odd").otherwise("even")).drop("c", "n")
    single = rows.withColumn("c", coin(key, "single", step, F.col(row))).orderBy("c", row).limit(1).drop("c").withColumn("half", F.lit("single"))
    return placed.unionByName(single)


def epoch_batches(rows: DataFrame, size: int, key: str, epoch: int, row: str = "row_id") -> DataFrame:
    """Adds batch_id within one shuffled epoch; rows beyond the last full batch are left out.

    Ranks are counted within ranges of the coin and added up, so no task sorts all rows.
    """
    n = rows.count()
    if not 0 < size <= n:
        raise ValueError("the batch size must be between 1 and the number of rows")
    parts = max(1, n // 50_000)
    cast = rows.withColumn("c", coin(key, "epoch", epoch, F.col(row))).withColumn("part", F.floor(F.col("c") * parts).cast("int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cast.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    ranked = cast.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("c", row))).join(starts, "part")
    return ranked.withColumn("batch_id", F.floor((F.col("r") + F.col("start") - 1) / size).cast("int")).where(F.col("batch_id") < n // size).drop("c", "part", "r", "start")


def epochs(rows: DataFrame, size: int, key: str, row: str = "row_id") -> Iterator[tuple[int, DataFrame]]:
    """Endless epochs of batches."""
    epoch = 0
    while True:
        yield epoch, epoch_batches(rows, size, key, epoch, row)
        epoch += 1
