"""Nearest vectors by cosine: a block matrix join over int8 tiles, exact in the end.

Queries come in blocks of bounded size, one after the other, each broadcast as int8 codes with scales; candidates pass
in tiles. A tile's
int8 product gives every cosine up to a bound that follows from the codes' rounding. Pairs whose upper bound reaches
the k-th best lower bound so far survive, are computed again in double precision, and go into the task's heaps (the k
best of each query); those are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fields, saved, small_batches

#: Queries that are broadcast at once, their components at most, about (32 MB), and candidates in one tile.
BLOCK, VALUES, TILE = 65_536, 1 << 22, 2_048
#: Queries whose products with a tile are held at once.
ROWS = 1_024

FOUND = fields(("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: all components present and finite, not all zero, with an id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.size(x) > 0
    fine &= ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("embedding"))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the sums of the codes' sizes."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.int32)).sum(axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer product of code tiles: sums stay below 2**24, where single precision is exact."""
    step = 1024
    return sum(a[:, k : k + step].astype(np.float32) @ b[:, k : k + step].astype(np.float32).T for k in range(0, a.shape[1], step))


class Queries:
    """A block of queries: ids, vectors, unit vectors and codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norm = ids, x, np.sqrt((x * x).sum(axis=1))
        self.codes, self.scale, self.size = coded(x / self.norm[:, None])


class Heaps:
    """The k best candidates of each query so far, best first; ties to the smaller id."""

    def __init__(self, q: Queries, k: int):
        self.q, self.k = q, k
        self.score = np.full((len(q.ids), k), -np.inf)
        self.id = np.full((len(q.ids), k), np.iinfo(np.int64).max)

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x * x).sum(axis=1))
        codes, scale, size = coded(x / norm[:, None])
        for b in range(0, len(self.q.ids), ROWS):
            e = min(b + ROWS, len(self.q.ids))
            near = product(self.q.codes[b:e], codes) * (self.q.scale[b:e, None] * scale)
            # |true - near| by the rounding of both codes (half a step in each component), and of the units themselves.
            stray = (self.q.scale[b:e, None] * scale) * (0.5 * (self.q.size[b:e, None] + size) + 0.25 * x.shape[1]) + 1e-6
            low = near - stray
            low[self.q.ids[b:e, None] == ids] = -np.inf
            floor = self.score[b:e, -1]
            if low.shape[1] >= self.k:
                floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
            r, c = np.nonzero((near + stray >= floor[:, None]) & (self.q.ids[b:e, None] != ids))
            if len(r):
                exact = np.einsum("ij,ij->i", self.q.x[b + r], x[c]) / (self.q.norm[b + r] * norm[c])
                self._merge(b + r, ids[c], exact)

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched, inverse = np.unique(row, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), inverse])
        all_scores = np.concatenate([self.score[touched].ravel(), score])
        all_ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((all_ids, -all_scores, rows))
        rows, all_scores, all_ids = rows[order], all_scores[order], all_ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(touched)))[rows]
        keep = place < self.k
        self.score[touched[rows[keep]], place[keep]] = all_scores[keep]
        self.id[touched[rows[keep]], place[keep]] = all_ids[keep]


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors for each length, in the order of rows."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = pa.array(np.flatnonzero(size == n))
        yield int(n), ids.take(at).to_numpy(), vectors.take(at).flatten().to_numpy().reshape(-1, n)


def _blocks(asked: DataFrame) -> Iterator[DataFrame]:
    """The queries in blocks of bounded size; lengths of few queries share one, so there are as many scans as blocks."""
    lengths, held, values = [], 0, 0

    def pieces() -> Iterator[DataFrame]:
        n = max(-(-held // BLOCK), -(-values // VALUES))
        for i in range(n):
            yield asked.where(F.size("embedding").isin(lengths) & (F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i))

    for r in asked.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect():
        if lengths and (held + r.rows > BLOCK or values + r.n * r.rows > VALUES):
            yield from pieces()
            lengths, held, values = [], 0, 0
        lengths, held, values = [*lengths, r.n], held + r.rows, values + r.n * r.rows
    if lengths:
        yield from pieces()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank from 1, vec_id and the exact cosine of each query's k nearest vectors but itself.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of another
    length than the query's. Fewer candidates than k give fewer rows. A vec_id is one query: of its vectors, the least
    one in Spark's order of arrays. A row's own vec_id is left out wherever it repeats; other repeated vec_ids are
    candidates as often as they have rows, and may take several ranks. An empty table gives no rows. Other columns are
    not read.

    Query blocks pass in waves: one block is held by the driver and the workers at a time, and each wave's rows are
    written to the shared folder, so that no memory grows with the number of queries.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    given = usable(vectors)
    asked = saved(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    waves, last = [], None
    for block in _blocks(asked):
        rows = block.orderBy("vec_id").toArrow()
        if rows.num_rows == 0:
            continue
        if last is not None:
            waves.append(saved(last[0], "nearest"))
            last[1].destroy()
        last = _wave(given, rows, k)
    if last is None:
        return spark.createDataFrame([], T.StructType([FOUND["query_id"], T.StructField("rank", T.IntegerType()), FOUND["vec_id"], FOUND["score"]]))
    if not waves:
        return last[0]
    waves.append(saved(last[0], "nearest"))
    last[1].destroy()
    return reduce(DataFrame.union, waves)


def _wave(given: DataFrame, block: pa.Table, k: int) -> tuple[DataFrame, Broadcast]:
    """One block of queries against all candidates, and the broadcast that its tasks read."""
    by_length = {n: Queries(ids, x) for n, ids, x in _by_length(block.column("vec_id").combine_chunks(), block.column("embedding").combine_chunks())}
    sent = given.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, tiles, held = {}, {}, 0

        def flush() -> None:
            for n, tile in tiles.items():
                if n not in heaps:
                    heaps[n] = Heaps(sent.value[n], k)
                heaps[n].take(*(np.concatenate(c) for c in zip(*tile, strict=True)))
            tiles.clear()

        for batch in batches:
            for n, ids, x in _by_length(batch.column(0), batch.column(1)):
                if n in sent.value:
                    tiles.setdefault(n, []).append((ids, x))
                    held += len(ids)
            if held >= TILE:
                flush()
                held = 0
        flush()
        for h in heaps.values():
            r, c = np.nonzero(h.score > -np.inf)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(h.q.ids[r]), pa.array(h.id[r, c]), pa.array(h.score[r, c])], names=FOUND.names)

    found = given.where(F.size("embedding").isin(list(by_length))).mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), sent
