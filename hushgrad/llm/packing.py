"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are cut only when longer than a sequence: the first piece takes the remainder, all others are full. The
histogram of piece lengths (at most one entry for each length) goes to the driver, where a configuration linear
program over it is solved: multiplicative weights hold a price for each length, a knapsack dynamic program prices
all configurations at once, and the configurations of nearly the best price for their longest scarce piece get
weight. Weights are rounded down to whole sequences within the counts, what is left over is solved again, and a
small rest goes by best fit. Pieces then find their places by their rank among pieces of equal length; ranks are
counted in salted groups, so that no task holds all pieces of one length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_map, fields, saved, tokenizer_path
from .tokens import byte_ids

SEQUENCE = 2048
VOCABULARY = "byte_bpe_50k.json"
#: Rounds of multiplicative weights, the share of the best value that a configuration needs, and the step of prices.
ROUNDS, NEAR, STEP = 8, 0.02, 0.01
#: With fewer lengths than this, rounds are cheap and there are more of them.
SPARSE = 512
#: How often leftovers are solved again, and when they are few enough for best fit.
SOLVES, FEW = 20, 1500
#: Pieces of one length that are ranked together, about.
RANKED = 1_000

PIECES = fields(("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))


def prices(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each capacity, and the index of a length to take there (-1: none)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - lengths[:k]] + value[:k]
            j = int(np.argmax(v))
            if v[j] > best[c]:
                best[c], take[c] = v[j], j
    return best, take


def _filled(take: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        j = take[room]
        if j < 0:
            room -= 1
        else:
            out.append(int(j))
            room -= int(lengths[j])
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations (lengths, longest first) and how often each is used, so that each length is covered about once."""
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    rounds = max(rounds, min(50 * rounds, rounds * SPARSE // len(lengths)))
    log_price, covered = np.zeros(len(lengths)), np.zeros(len(lengths))
    step = STEP * (1 + 4 * (len(lengths) < SPARSE))
    use: dict[tuple[int, ...], float] = {}
    for t in range(rounds):
        value = lengths / capacity * np.exp(log_price)
        best, take = prices(lengths, value, capacity)
        own = value + best[capacity - lengths]
        gained = np.zeros(len(lengths))
        for j in np.flatnonzero(own >= (1 - NEAR) * own.max() * (1 if t else 0.5)):
            chosen = Counter([int(j), *_filled(take, lengths, capacity - int(lengths[j]))])
            flow = min(need[i] / n for i, n in chosen.items()) / rounds
            for i, n in chosen.items():
                gained[i] += n * flow
            key = tuple(sorted((int(lengths[i]) for i, n in chosen.items() for _ in range(n)), reverse=True))
            use[key] = use.get(key, 0.0) + flow
        covered += gained
        log_price -= step * np.clip(gained / need * rounds - 1, -1, 3)
        log_price -= log_price.mean()
    return use


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequence that takes it; equal sequences move together."""
    room: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                each = min(capacity // length, left)
                opened = left // each
                room.setdefault(capacity - each * length, Counter())[(length,) * each] += opened
                left -= opened * each
                continue
            pattern, n = next(iter(room[fit].items()))
            moved = min(n, left)
            room[fit][pattern] -= moved
            if not room[fit][pattern]:
                del room[fit][pattern]
            room.setdefault(fit - length, Counter())[(*pattern, length)] += moved
            left -= moved
    return [(p, n) for c in room.values() for p, n in c.items()]


def configurations(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole sequences: configurations and their numbers, which use up the counts exactly."""
    left = counts.astype(np.int64).copy()
    out: Counter = Counter()
    out[(capacity,)] = int(left[capacity])
    left[capacity] = 0
    # Over many lengths only full sequences, until those no longer come about; few lengths may not fill any.
    least = capacity if np.count_nonzero(left) > SPARSE else 0
    for _ in range(SOLVES):
        if left.sum() <= FEW:
            break
        before = left.sum()
        use = fractional(left, capacity)
        # Fullest first: what a configuration takes beyond its rounded-down share only uses counts that are left.
        for whole in (True, False):
            for key, x in sorted(use.items(), key=lambda u: (-sum(u[0]), *(-i for i in u[0]))):
                if sum(key) < (least if whole else capacity):
                    break
                each = Counter(key)
                n = min(int(x) if whole else int(x) + 1, *(int(left[i]) // m for i, m in each.items()))
                if n > 0:
                    out[key] += n
                    for i, m in each.items():
                        left[i] -= n * m
        if left.sum() > 0.9 * before:
            if not least:
                break
            least = 0
    for key, n in best_fit(Counter({int(i): int(left[i]) for i in np.flatnonzero(left)}), capacity):
        out[key] += n
    return [(key, n) for key, n in out.items() if n]


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For ranks among pieces of one length: from which rank on, first sequence, pieces in each, offset of the first."""
    rows, used, base = [], Counter(), 0
    for key, n in found:
        at = 0
        for length, m in Counter(key).items():
            rows.append((length, used[length], base, m, at))
            used[length] += n * m
            at += length * m
        base += n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return {"key": (cols[0] << 44) + cols[1], "rank": cols[1], "base": cols[2], "each": cols[3], "offset": cols[4]}


def pieces(docs: DataFrame, capacity: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of each document's ids with one id 0 at the end; a null text counts as empty."""
    path = tokenizer_path(vocabulary)

    def make():
        encode = byte_ids(path)

        def one(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {f.name: [] for f in PIECES}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + b"\0\0\0\0"
                n = len(ids) // 4
                first = n - (-(-n // capacity) - 1) * capacity
                begin, end, k = 0, first, 0
                while begin < n:
                    for name, x in zip(cols, (doc, k, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])), strict=True):
                        cols[name].append(x)
                    begin, end, k = end, end + capacity, k + 1
            return cols

        return one

    return arrow_map(docs.select("doc_id", "text"), make, PIECES)


def packed(docs: DataFrame, capacity: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece with its sequence and its offset there.

    Null and empty texts are one id 0 each. Repeated rows are packed like any other; of documents with one doc_id the
    order within a length is by content. An empty table gives no rows. Other columns are not read. A very long text is
    encoded whole in one task, and its pieces go their own ways.
    """
    cut = saved(pieces(docs, capacity, vocabulary), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row for each length
        counts[length] = n
    table = places(configurations(counts, capacity)) if counts.any() else places([])
    sent = docs.sparkSession.sparkContext.broadcast(table)

    # Groups for each length, in one literal that is folded into an array.
    groups = F.split(F.lit(",".join(map(str, np.maximum(1, -(-counts // RANKED)).tolist()))), ",").cast("array<int>")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.element_at(groups, (F.col("length") + 1).cast("int")))
    salted = cut.withColumn("salt", salt)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "salt"]).select(*PIECES.names, (F.col("rank") + F.col("before")).alias("rank"))

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def make():
        t = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(t["key"], (length << 44) + rank, side="right") - 1
            nth = rank - t["rank"][i]
            return {n: batch.column(n) for n in PIECES.names} | {"sequence_id": t["base"][i] + nth // t["each"][i], "offset": t["offset"][i] + nth % t["each"][i] * length}

        return one

    return arrow_map(ranked, make, schema)
