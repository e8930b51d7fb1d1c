"""Evaluation of scored rows (p, y[, row_id]): proper scores, calibration, decompositions, rankings, operating points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import order

CLIP = 1e-15
STRATEGIES = ("equal_mass", "equal_width")


def validate(scored: DataFrame) -> None:
    """One pass over the rows; raises a ValueError that names what is wrong first."""
    r = validation(scored).first()
    if r.n == 0:
        raise ValueError("no rows")
    if r.bad_p:
        raise ValueError("a probability is null, NaN or infinite")
    if r.low < 0 or r.high > 1:
        raise ValueError("a probability lies outside [0, 1]")
    if r.bad_y:
        raise ValueError("a label is neither 0 nor 1")


def validation(scored: DataFrame) -> DataFrame:
    p = F.col("p")
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return scored.agg(
        F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad_p"), F.min(p).alias("low"), F.max(p).alias("high"),
        F.sum((F.col("y").isNull() | ~F.col("y").isin(0, 1)).cast("long")).alias("bad_y"),
    )


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def log_loss_of(p: Column, y: Column) -> Column:
    q = _clipped(p)
    return -(y * F.log(q) + (1 - y) * F.log1p(-q))


def entropy_of(rate: Column) -> Column:
    return F.when((rate > 0) & (rate < 1), -rate * F.log(rate) - (1 - rate) * F.log1p(-rate))


def scores(scored: DataFrame) -> DataFrame:
    """n, base_rate, log_loss, brier_score, normalized_entropy and calibration_ratio in one pass; null where undefined."""
    y = F.col("y").cast("double")
    one = scored.agg(F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg(log_loss_of(F.col("p"), y)).alias("log_loss"), F.avg((F.col("p") - y) ** 2).alias("brier_score"), F.sum(y).alias("sy"), F.sum("p").alias("sp"))
    return one.select(
        "n", "base_rate", "log_loss", "brier_score", (F.col("log_loss") / entropy_of(F.col("base_rate"))).alias("normalized_entropy"),
        F.when(F.col("sp") > 0, F.col("sy") / F.when(F.col("sp") > 0, F.col("sp"))).alias("calibration_ratio"),
    )


def base_rate_entropy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.col("y").cast("double")).alias("base_rate")).select("base_rate", entropy_of(F.col("base_rate")).alias("entropy"))


def edges(scored: DataFrame, bins: int = 15, strategy: str = "equal_mass", approximate: bool = False) -> list[float]:
    """Distinct bin edges. Equal mass: exact interpolated quantiles, or estimates where that is asked for."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if bins < 1:
        raise ValueError("bins must be positive")
    if strategy == "equal_width":
        return [i / bins for i in range(bins + 1)]
    at = [i / bins for i in range(bins + 1)]
    found = scored.agg(F.percentile_approx("p", at, 100_000).alias("e")).first().e if approximate else order.quantiles(scored, "p", at)
    if found is None:
        raise ValueError("no rows")
    out = sorted(set(found))
    if len(out) == 1:
        out.append(math.nextafter(out[0], math.inf))
    return out


def assigned(scored: DataFrame, at: list[float]) -> DataFrame:
    """Adds each row's bin: closed on the left, the last one on the right too."""
    found = F.size(F.filter(F.array(*[F.lit(float(e)) for e in at]), lambda e: e <= F.col("p"))) - 1
    return scored.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(len(at) - 2), found)))


def bin_summary(scored: DataFrame, bins: int = 15, strategy: str = "equal_mass", approximate: bool = False) -> DataFrame:
    """A row for each bin that has rows, renumbered from 0."""
    at = edges(scored, bins, strategy, approximate)
    lower, upper = F.array(*[F.lit(float(e)) for e in at[:-1]]), F.array(*[F.lit(float(e)) for e in at[1:]])
    by = assigned(scored, at).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("mean_observed"))
    named = by.withColumn("lower", F.element_at(lower, F.col("bin") + 1)).withColumn("upper", F.element_at(upper, F.col("bin") + 1))
    return named.withColumn("bin", (F.dense_rank().over(Window.orderBy("bin")) - 1).cast("int"))


def reliability_curve(scored: DataFrame, bins: int = 15, strategy: str = "equal_mass") -> DataFrame:
    return bin_summary(scored, bins, strategy).withColumn("gap", F.col("mean_predicted") - F.col("mean_observed"))


def ece(scored: DataFrame, bins: int = 15, strategy: str = "equal_mass") -> DataFrame:
    b = bin_summary(scored, bins, strategy)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("mean_observed"))) / F.sum("n")).alias("ece"))


def brier_decomposition(scored: DataFrame, bins: int = 15, strategy: str = "equal_mass") -> DataFrame:
    """calibration - resolution + uncertainty + residual = score."""
    b, s = bin_summary(scored, bins, strategy), scores(scored)
    r = F.col("base_rate")
    parts = b.crossJoin(s.select("base_rate", "brier_score", F.col("n").alias("total"))).groupBy("base_rate", "brier_score").agg(
        F.sum(F.col("n") / F.col("total") * (F.col("mean_predicted") - F.col("mean_observed")) ** 2).alias("calibration"), F.sum(F.col("n") / F.col("total") * (F.col("mean_observed") - r) ** 2).alias("resolution")
    )
    out = parts.withColumn("uncertainty", r * (1 - r)).withColumn("score", F.col("brier_score"))
    return out.select("score", "calibration", "resolution", "uncertainty", (F.col("score") - F.col("calibration") + F.col("resolution") - F.col("uncertainty")).alias("residual"))


def _xlogx(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log(F.when(a > 0, a) / b)).otherwise(0.0)


def log_loss_decomposition(scored: DataFrame, bins: int = 15, strategy: str = "equal_mass") -> DataFrame:
    """The same for the log loss, with divergences in place of squares."""
    b, s = bin_summary(scored, bins, strategy), scores(scored)
    q, o, r = _clipped(F.col("mean_predicted")), F.col("mean_observed"), F.col("base_rate")
    kl = lambda a, c: _xlogx(a, c) + _xlogx(1 - a, 1 - c)
    parts = b.crossJoin(s.select("base_rate", "log_loss", F.col("n").alias("total"))).groupBy("base_rate", "log_loss").agg(
        F.sum(F.col("n") / F.col("total") * kl(o, q)).alias("calibration"), F.sum(F.col("n") / F.col("total") * kl(o, _clipped(r))).alias("resolution")
    )
    out = parts.withColumn("uncertainty", F.coalesce(entropy_of(r), F.lit(0.0))).withColumn("score", F.col("log_loss"))
    return out.select("score", "calibration", "resolution", "uncertainty", (F.col("score") - F.col("calibration") + F.col("resolution") - F.col("uncertainty")).alias("residual"))


def ranked_walk(scored: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows from the highest score on, ties by row_id: k, row_id, score, hit, found, precision, recall.

    Rows are ranked within ranges of scores, and of row_id where many rows have one score; the ranges' counts say where
    each begins. No task sorts all rows, and nothing is joined. Without positive rows recall is null. There are as many
    ranges as the number of rows asks for, or about as many as the caller does.
    """
    # Made rows, so that each score is computed once and not once for every use.
    made = scored.select(F.inline(F.array(F.struct("row_id", "p", "y")))).select("row_id", F.col("p").alias("score"), F.col("y").cast("int").alias("hit"), (-F.col("p")).alias("down"))
    keys = ["down", *(["row_id"] if isinstance(scored.schema["row_id"].dataType, T.NumericType) else [])]
    by = order.ranges(made, keys, (-1.0, 0.0), {"hits": F.coalesce(F.sum("hit"), F.lit(0))}, ranges)
    positives = by.total("hits")
    own = Window.partitionBy("part").orderBy("down", "row_id")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    walked = made.withColumn("part", by.part).withColumn("k1", F.row_number().over(own)).withColumn("h1", F.sum("hit").over(run))
    starts = order.Ranges(F.col("part"), by.sums)
    ranks = walked.select("row_id", "score", "hit", (starts.before("n") + F.col("k1")).cast("long").alias("k"), (starts.before("hits") + F.col("h1")).cast("long").alias("found"))
    recall = F.col("found") / float(positives) if positives else F.lit(None).cast("double")
    return ranks.select("k", "row_id", "score", "hit", "found", (F.col("found") / F.col("k")).alias("precision"), recall.alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    w = ranked_walk(scored)
    return w.agg((F.sum(F.col("precision") * F.col("hit")) / F.nullif(F.sum("hit"), F.lit(0))).alias("average_precision"))


def pr_curve(scored: DataFrame) -> DataFrame:
    return ranked_walk(scored).select("k", "score", "precision", "recall")


def best_f1(scored: DataFrame) -> DataFrame:
    """The highest F1 over all cuts of the ranking; of equal ones the largest threshold."""
    w = ranked_walk(scored)
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    top = w.withColumn("f1", f1).agg(F.max_by(F.struct("score", "f1", "precision", "recall"), F.struct("f1", (-F.col("k")).alias("o"))).alias("b"))
    return top.select(F.col("b.score").alias("threshold"), "b.f1", "b.precision", "b.recall")


def tie_collapsed(scored: DataFrame) -> DataFrame:
    """One row for each distinct score, with its rows and positives: a ranking that does not depend on the order of ties."""
    return scored.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("hits"))


def confusion_at(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """tn, fp, fn, tp where rows with p >= threshold count as positive; one row for each threshold."""
    pos, neg = F.col("y") == 1, F.col("y") == 0
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(neg & (F.col("p") < t)).alias("tn"), F.count_if(neg & (F.col("p") >= t)).alias("fp"), F.count_if(pos & (F.col("p") < t)).alias("fn"), F.count_if(pos & (F.col("p") >= t)).alias("tp")) for t in thresholds]
    return scored.agg(F.array(*cells).alias("c")).select(F.inline("c"))
