"""Inputs: pruned Parquet scans, the scored relations, checksummed files, a cache folder and notices."""

from __future__ import annotations

import hashlib
import os
import sys
import threading
import urllib.request
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushgrad.operators import stages

LINE_FEATURES = ("x1", "x2", "x3", "x4")
#: Weights of the fixed models that score lines and clicks.
LINE_MODEL = stages.Linear((0.4, -3.0, 2.5, 0.5), -1.0)
NUMERIC, CATEGORICAL = ("value", "hour", "k"), ("user_id",)


def scan(spark: SparkSession, path: str, columns: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Only the named columns; a path that is missing in any store is an error at once, as is a column that is not there."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    read = spark.read if schema is None else spark.read.schema(schema)
    try:
        return read.parquet(path).select(*columns)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise


def lines(spark: SparkSession, sf_dir: str, row: bool = False) -> DataFrame:
    """Features and label of order lines, with row_id where asked for."""
    t = scan(spark, f"{sf_dir}/lineitem.parquet", [*["l_orderkey", "l_linenumber"] * row, "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag"])
    return t.select(*[(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id")] * row, (F.col("l_quantity") / 50.0).alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), (F.col("l_extendedprice") / 100000.0).alias("x4"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def scored_lines(spark: SparkSession, sf_dir: str, row: bool = False) -> DataFrame:
    """p and y, with row_id where asked for."""
    return lines(spark, sf_dir, row).select(*["row_id"] * row, stages.sigmoid(stages.logit(LINE_MODEL, LINE_FEATURES)).alias("p"), "y")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their numbers and label; event_id is the row's identity."""
    t = scan(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "ts", "event_type", "value", "props"])
    return t.select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value", F.hour("ts").cast("double").alias("hour"), F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_type") == "click").cast("int").alias("y"))


def click_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).select("row_id", "y", (F.log1p("value") / 6.0).alias("x1"), (F.col("hour") / 24.0).alias("x2"), (F.col("k") / 100.0).alias("x3"))


CLICK_FEATURES = ("x1", "x2", "x3")
CLICK_MODEL = stages.Linear((0.6, -0.4, 0.3), -1.4)


def scored_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_features(spark, sf_dir).select("row_id", stages.sigmoid(stages.logit(CLICK_MODEL, CLICK_FEATURES)).alias("p"), "y")


def ranked_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of scored_clicks for rankings: p has the very bits that SQL gives it.

    Scores that only rounding tells apart are ranked as rounding has them, and the JVM's exp and log often differ from the
    C library's in the last bit. Arrow calls that library, as SQL does. As in scored_clicks, p is null without a value
    above -1.
    """
    (w1, w2, w3), b = CLICK_MODEL.w, CLICK_MODEL.b

    @F.arrow_udf("double")
    def p(value: pa.Array, hour: pa.Array, k: pa.Array) -> pa.Array:
        value = pc.if_else(pc.less_equal(value, -1.0), pa.scalar(None, pa.float64()), value)
        parts = [pc.multiply(w1, pc.divide(pc.ln(pc.add(1.0, value)), 6.0)), pc.multiply(w2, pc.divide(hour, 24.0)), pc.multiply(w3, pc.divide(k, 100.0))]
        z = pc.add(pc.add(pc.add(parts[0], parts[1]), parts[2]), b)
        return pc.divide(1.0, pc.add(1.0, pc.exp(pc.negate(z))))

    return clicks(spark, sf_dir).select("row_id", p(F.col("value").cast("double"), "hour", "k").alias("p"), "y")


def cache_dir(sub: str = "") -> Path:
    """HUSHGRAD_CACHE or the user's cache folder on this system; made where missing."""
    usual = {"darwin": Path.home() / "Library" / "Caches", "win32": os.environ.get("LOCALAPPDATA") or Path.home() / "AppData" / "Local"}
    base = os.environ.get("HUSHGRAD_CACHE") or usual.get(sys.platform) or os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache"
    out = Path(base).expanduser().resolve() / "hushgrad" / sub
    out.mkdir(parents=True, exist_ok=True)
    return out


def sha256_of(path: Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def fetched(url: str, to: Path, sha256: str, chunk: int = 1 << 20) -> Path:
    """A file of known digest: kept if it is right, fetched again if not; named only when complete and right."""
    if to.exists():
        if sha256_of(to) == sha256.lower():
            return to
        to.unlink()
    part = to.with_name(to.name + ".partial")
    with urllib.request.urlopen(url) as r, part.open("wb") as f:  # noqa: S310
        while block := r.read(chunk):
            f.write(block)
    if (found := sha256_of(part)) != sha256.lower():
        raise RuntimeError(f"{url}: digest {found}, expected {sha256.lower()}")
    part.rename(to)
    return to


_said: set[str] = set()
_lock = threading.Lock()


def say_once(key: str, message: str) -> None:
    with _lock:
        if key not in _said:
            _said.add(key)
            print(message, file=sys.stderr)


def forget_said() -> None:
    with _lock:
        _said.clear()
