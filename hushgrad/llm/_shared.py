"""What the operators of this folder share: inputs, intermediate tables and Arrow maps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in one Arrow batch: with texts of tens of kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 512

_local_default: list[str] = []
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the package that knows it is on the path or in /opt."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may fall back to one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_default:
        _local_default.append(tempfile.mkdtemp(prefix="hushgrad-"))
    return _local_default[0]


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shipped(spark)


def shipped(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once in each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="hushgrad-code-")) / "hushgrad-code.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(where))
    _shipped.add(sc.applicationId)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushgrad-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._hushgrad_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the tables of DataFrames that saved() returned, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_hushgrad_path", None)
        for entry in [e for e in _written if e[1] == path]:
            _delete(*entry)
            _written.remove(entry)


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by a long column whose hot keys Spark can split when it runs (adaptive skew joins).

    That needs an exchange of its own on both sides, which an aggregate by the same key would not get. So the key is
    hashed once more: xxhash64 of a long is one to one. The right side has one row for each key.
    """
    other = right.withColumnRenamed(key, "hushgrad_key")
    out = left.join(other, F.xxhash64(left[key]) == F.xxhash64(other["hushgrad_key"]), how)
    return out if how in ("left_semi", "left_anti") else out.drop("hushgrad_key")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        _delete(spark, path)
    for folder in _local_default:
        shutil.rmtree(folder, ignore_errors=True)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow by a function of one batch that returns columns by name. make() runs once in each task."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                columns = one(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


def crc_mod(column: str, divisor: int):
    """crc32 of an id's decimal text, modulo a divisor: the folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))
