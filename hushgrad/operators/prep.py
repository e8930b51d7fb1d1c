"""Tabular preparation: exact splits, train-fitted filling, encodings, standardization and per-row norm caps.

What is fitted is fitted on the train rows only, and is small: statistics go to the driver or into plans as one-row
tables. Vocabularies grow with the data and are joined, not broadcast by hint. Fitted preparation is not private.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushgrad.functions.coins import coin

from . import order

#: Codes of a vocabulary that are ranked together, and the ranges of larger vocabularies at most.
RANGE_CODES, RANGES = 100_000, 1024


def exact_split(rows: DataFrame, key: str, fraction: float = 0.2, purpose: str = "split", row: str = "row_id", names: tuple[str, str] = ("test", "train"), n_test: int | None = None) -> DataFrame:
    """Adds split: exactly round(n * fraction) rows (half to even), those of the smallest coins, are test rows.

    The coin at the cut is found from counts of coin ranges, and rows of one coin go by the row; nothing sorts all rows.
    """
    u = rows.withColumn("coin", coin(key, purpose, 0, F.col(row)))
    x = u.select(F.col("coin").alias("x"))
    n, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n_test is None:
        n_test = round(n * fraction)
    if n_test <= 0 or n_test >= n:
        inside: Column = F.lit(n_test > 0)
    else:
        at = order.at_ranks(x, [n_test - 1], (n, low, high))[n_test - 1]
        inside = F.col("coin") <= at.value
        if (spare := at.below + at.equal - n_test) > 0:
            last = [r[0] for r in u.where(F.col("coin") == at.value).orderBy(F.desc(row)).limit(spare).select(row).collect()]  # ties of one coin
            inside &= (F.col("coin") < at.value) | (F.col(row) < F.lit(last[-1]))
    return u.withColumn("split", F.when(inside, names[0]).otherwise(names[1])).drop("coin")


def three_way_split(rows: DataFrame, key: str, fraction: float = 0.2, n_validation: int = 0, row: str = "row_id") -> DataFrame:
    """A test split, then a validation cut of the train rows by a second coin."""
    first = exact_split(rows, key, fraction, row=row)
    train = exact_split(first.where("split = 'train'").drop("split"), key, purpose="validation", row=row, names=("validation", "train"), n_test=n_validation)
    return train.unionByName(first.where("split = 'test'"))


def present(x: Column) -> Column:
    """NaN as null: a missing number."""
    return F.when(~F.isnan(x), x)


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the train rows' present values."""
    train = rows.where("split = 'train'").select(*columns)
    out = {}
    for c in columns:
        at = order.quantiles(train, c, [0.5])
        out[c] = None if at is None else at[0]
    return out


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    m = medians(rows, columns)
    return rows.withColumns({c: F.coalesce(present(F.col(c)), F.lit(m[c])) for c in columns})


def clip_log1p(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def integer_chain(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fill, clip at zero, log1p."""
    return filled(rows, columns).withColumns({c: clip_log1p(F.col(c)) for c in columns})


def frequency_encoded(rows: DataFrame, column: str, out: str) -> DataFrame:
    """The share of train rows with the row's code; 0 for codes not in train."""
    train = rows.where("split = 'train'")
    n = train.count()
    share = train.groupBy(column).agg((F.count("*") / F.lit(float(max(1, n)))).alias(out))
    return rows.join(share, column, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """(code, index) of the train rows' distinct codes in sorted order."""
    return _vocabulary(rows, column)[0]


def _vocabulary(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The vocabulary and its size. Large ones are ranked in ranges between codes that a hash picks, so no task sorts all;
    whichever codes are picked, the ranks are the same."""
    codes = rows.where(f"split = 'train' and {column} is not null").select(F.col(column).alias("code")).distinct()
    n = codes.count()
    parts = min(RANGES, -(-n // RANGE_CODES))
    if parts <= 1:
        return codes.withColumn("index", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("code")) - 1).cast("int")), n
    picked = sorted(r.code for r in codes.orderBy(F.xxhash64("code"), "code").limit(8 * parts).collect())
    cuts = F.array(*[F.lit(c) for c in picked[4::8]])
    ranged = codes.withColumn("part", F.size(F.filter(cuts, lambda c: c <= F.col("code"))))
    count = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = order.Ranges(F.col("part"), [{"n": count.get(i, 0)} for i in range(parts + 1)])
    own = F.row_number().over(Window.partitionBy("part").orderBy("code"))
    return ranged.withColumn("index", (own + starts.before("n") - 1).cast("int")).drop("part"), n


def _placed(rows: DataFrame, vocabulary_: DataFrame, column: str, out: str) -> DataFrame:
    v = vocabulary_.select(F.col("code").alias(column), F.col("index").alias(out))
    return rows.join(v, column, "left").withColumn("seen", F.col(out).isNotNull())


def vocab_index(rows: DataFrame, column: str, out: str = "index") -> DataFrame:
    """Place in the vocabulary and whether the code is in it."""
    return _placed(rows, vocabulary(rows, column), column, out)


def one_hot_index(rows: DataFrame, columns: list[str], first: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Adds <column>_idx: offset plus place, unseen codes in the slot behind the vocabulary; offsets and sizes by column."""
    at, layout, given = first, {}, rows
    for c in columns:
        known, size = _vocabulary(given, c)
        layout[c] = (at, size)
        rows = _placed(rows, known, c, f"{c}_place").withColumn(f"{c}_idx", (F.coalesce(F.col(f"{c}_place"), F.lit(size)) + at).cast("int")).drop(f"{c}_place", "seen")
        at += size + 1
    return rows, layout


def sparse_rows(rows: DataFrame, numeric: list[str], indexed: list[str]) -> DataFrame:
    """idx and val arrays: numbers first with their values, then one 1.0 for each category."""
    idx = F.array(*[F.lit(i) for i in range(len(numeric))], *[F.col(f"{c}_idx") for c in indexed])
    val = F.array(*[F.col(c).cast("double") for c in numeric], *[F.lit(1.0)] * len(indexed))
    return rows.withColumn("idx", idx).withColumn("val", val)


def densified(rows: DataFrame, width: int) -> DataFrame:
    """idx and val as one dense array."""
    lookup = F.map_from_arrays("idx", "val")
    return rows.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(lookup[i], F.lit(0.0))))


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Train mean 0 and population deviation 1; a deviation under 1e-8 counts as 1."""
    r = rows.where("split = 'train'").agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return rows.withColumns({c: (F.col(c) - r[f"m_{c}"]) / (r[f"s_{c}"] if r[f"s_{c}"] is not None and not r[f"s_{c}"] < 1e-8 else 1.0) for c in columns})


def l2(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def norm_capped(rows: DataFrame, bound: float, column: str = "x") -> DataFrame:
    """x divided by max(1, norm / bound), row by row. Says that there are non-finite rows, never how many."""
    if not 0 < bound < float("inf"):
        raise ValueError("the bound must be positive and finite")
    bad = F.exists(F.col(column), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    if rows.agg(F.max(bad)).first()[0]:
        warnings.warn("at least one row is not finite, so no bound holds for it", stacklevel=2)
    scale = F.greatest(F.lit(1.0), l2(F.col(column)) / bound)
    return rows.withColumn(column, F.transform(column, lambda v: v / scale))


def unseen_categories(rows: DataFrame, column: str) -> DataFrame:
    """Codes of other rows that no train row has."""
    return rows.where("split <> 'train'").select(column).distinct().join(rows.where("split = 'train'").select(column).distinct(), column, "left_anti")
