"""Exact order statistics and ranks with no task that holds all rows.

Values fall into cells of equal width by plain arithmetic; counts of the cells tell which of them hold the wanted ranks
or hold too many rows, and only those are cut again. The driver sees counts of cells, never rows in bulk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a first cut and of one that follows.
CELLS, FINER = 4096, 256
#: Rows of a cell that the driver takes in to read a rank off.
FEW = 4096
#: Rows of one range of a ranking at least, and ranges at most, about.
RANGE_ROWS, RANGES = 25_000, 1024


def literals(values: Sequence, kind: str) -> Column:
    """A constant array, folded by the optimizer: one literal, however many values."""
    return F.split(F.lit(",".join(map(repr, values or [0]))), ",").cast(f"array<{kind}>")


def cell(x: str, low: float, high: float, cells: int) -> str:
    """SQL for the cell of x between two values: never lower for a larger x."""
    return f"cast(least(greatest(floor(({x} / 2 - {low / 2!r}D) / {high / 2 - low / 2!r}D * {cells}), 0), {cells - 1}) as int)"


@dataclass(frozen=True)
class Ranked:
    """A value, how many rows are below it, and how many have it."""

    value: float
    below: int
    equal: int


def at_ranks(x: DataFrame, ranks: Sequence[int], known: tuple[int, float, float] | None = None) -> dict[int, Ranked]:
    """The values at ranks (from 0) of the finite column x; known: count, least and largest value, where they are known."""
    n, low, high = known or x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    wanted = sorted({r for r in ranks if 0 <= r < n})
    found: dict[int, Ranked] = {}
    spans = [(low, high, 0, n)] if wanted else []
    while spans:
        narrow, wide = [], []
        for low, high, below, count in spans:
            if low == high:
                found |= {r: Ranked(low, below, count) for r in wanted if below <= r < below + count}
            else:
                (narrow if count <= FEW or high / 2 - low / 2 < 1e-300 else wide).append((low, high, below, count))
        if narrow:
            inside = " or ".join(f"x between {a!r}D and {b!r}D" for a, b, _, _ in narrow)
            at = {below: below for _, _, below, _ in narrow}
            for r in sorted(x.where(inside).groupBy("x").agg(F.count("*").alias("n")).collect(), key=lambda r: r.x):
                base = next(below for a, b, below, _ in narrow if a <= r.x <= b)
                found |= {k: Ranked(r.x, at[base], r.n) for k in wanted if at[base] <= k < at[base] + r.n}
                at[base] += r.n
        spans = []
        if wide:
            inside = " or ".join(f"x between {a!r}D and {b!r}D" for a, b, _, _ in wide)
            slot = " ".join(f"when x between {a!r}D and {b!r}D then {i * CELLS} + {cell('x', a, b, CELLS)}" for i, (a, b, _, _) in enumerate(wide))
            rows = x.where(inside).groupBy(F.expr(f"case {slot} end").alias("slot")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
            at = [below for _, _, below, _ in wide]
            for r in sorted(rows, key=lambda r: r.slot):
                i = r.slot // CELLS
                if any(at[i] <= k < at[i] + r.n for k in wanted):
                    spans.append((r.low, r.high, at[i], r.n))
                at[i] += r.n
    return found


def quantiles(rows: DataFrame, column: str, at: Sequence[float]) -> list[float] | None:
    """Exact quantiles, interpolated between ranks, of the values that are neither null nor NaN; None without any."""
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    places = [p * (n - 1) for p in at]
    got = at_ranks(x, [k for p in places for k in (int(p), min(int(p) + 1, n - 1))], (n, low, high))
    out = []
    for p in places:
        a, b, share = got[int(p)].value, got[min(int(p) + 1, n - 1)].value, p - int(p)
        out.append(a if a == b or not share else (1 - share) * a + share * b)
    return out


@dataclass(frozen=True)
class Ranges:
    """part: a column that tells a row's range, lower ranges first; sums: each range's rows and sums, in that order."""

    part: Column
    sums: list[dict[str, int]]

    def before(self, name: str) -> Column:
        """By range, the total of all lower ones."""
        total, out = 0, []
        for s in self.sums:
            out.append(total)
            total += s[name]
        return F.get(literals(out, "bigint"), self.part)

    def total(self, name: str) -> int:
        return sum(s[name] for s in self.sums)


def ranges(rows: DataFrame, keys: Sequence[str], first: tuple[float, float], sums: dict[str, Column], parts: int | None = None) -> Ranges:
    """Ranges of bounded size of rows in the order of numeric keys, ascending; first: bounds of the first key, about.

    A cell of too many rows is cut again by the first key that differs in it: so ties of one key go by the next. Only
    rows that are equal in all keys stay together. parts: how many ranges there are to be, about.
    """
    stats = [F.count("*").alias("n"), *[c.alias(s) for s, c in sums.items()], *[f(F.col(k).cast("double")).alias(f"{s}_{i}") for i, k in enumerate(keys) for s, f in (("low", F.min), ("high", F.max))]]
    names = ("n", *sums)

    def grouped(found: dict[int, dict], cells: int, most: int) -> tuple[list[int], list[dict]]:
        """Neighbouring cells together up to the most: by cell its group, and the groups."""
        group, out, is_open = [], [], False
        for c in range(cells):
            s = found.get(c)
            if s is not None and is_open and out[-1]["n"] + s["n"] <= most:
                out[-1] = {k: out[-1][k] + s[k] for k in names}
            elif s is not None:
                out.append(s)
                is_open = s["n"] <= most
            group.append(max(0, len(out) - 1))
        return group, out

    slot = F.expr(cell(f"cast(`{keys[0]}` as double)", *first, CELLS))
    by = rows.groupBy(slot.alias("slot")).agg(*stats).collect()
    n = sum(r.n for r in by)
    most = max(1, n // parts) if parts else max(RANGE_ROWS, n // RANGES)
    group, parts = grouped({r.slot: r.asDict() for r in by}, CELLS, most)
    part = F.get(literals(group, "int"), slot)
    while True:
        split = [(i, next((k for k in range(len(keys)) if p[f"low_{k}"] < p[f"high_{k}"]), None)) for i, p in enumerate(parts) if p["n"] > most]
        split = [(i, k) for i, k in split if k is not None]
        if not split:
            return Ranges(part, [{k: p[k] for k in names} for p in parts])
        nth = {i: j for j, (i, _) in enumerate(split)}
        where = F.get(literals([nth.get(i, -1) for i in range(len(parts))], "int"), part)
        key = F.lit(None).cast("double")
        for k in sorted({k for _, k in split}):
            of_key = literals([k == x for _, x in split], "boolean")
            key = F.when(F.get(of_key, where), F.col(keys[k]).cast("double")).otherwise(key)
        lows = F.get(literals([parts[i][f"low_{k}"] / 2 for i, k in split], "double"), where)
        wides = F.get(literals([parts[i][f"high_{k}"] / 2 - parts[i][f"low_{k}"] / 2 or 1.0 for i, k in split], "double"), where)
        finer = F.least(F.greatest(F.floor((key / 2 - lows) / wides * FINER), F.lit(0)), F.lit(FINER - 1)).cast("int")
        slot = F.when(where >= 0, where * FINER + finer)
        by = rows.withColumn("slot", slot).where("slot is not null").groupBy("slot").agg(*stats).collect()
        cells: dict[int, dict[int, dict]] = {}
        for r in by:
            cells.setdefault(r.slot // FINER, {})[r.slot % FINER] = r.asDict()
        new, base, fine = [], [], [0] * (len(split) * FINER)
        for i, p in enumerate(parts):
            base.append(len(new))
            if i in nth:
                group, made = grouped(cells[nth[i]], FINER, most)
                fine[nth[i] * FINER : (nth[i] + 1) * FINER] = group
                new += made
            else:
                new.append(p)
        if len(new) == len(parts):
            return Ranges(part, [{k: p[k] for k in names} for p in parts])
        part = F.get(literals(base, "int"), part) + F.coalesce(F.get(literals(fine, "int"), slot), F.lit(0))
        parts = new
