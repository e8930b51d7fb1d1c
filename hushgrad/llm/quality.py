"""Quality scores of whole texts: statistics of each document, boosted trees over them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from ._shared import arrow_map, crc_mod, fields
from .labelled import sampled

#: The most labelled rows of each class whose statistics go into the fit.
NEGATIVES, POSITIVES = 6000, 12000
DIVISOR, HELD = 3, 1

SCORES = fields(("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType()))

_KIND = np.zeros(256, np.int64)  # 0: other ASCII punctuation
for _k, _chars in enumerate([range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", b"!", b"|", b"*#$%&", b".", b",", b"=<>{}[]()/\\_~^@+-", range(128, 256), [*range(0, 10), *range(11, 32), 127]], 1):
    _KIND[list(_chars)] = _k
_KINDS = int(_KIND.max()) + 1
_SIGNS = tuple(b"!|*#$%&")
NAMES = ("bytes", *(f"kind_{k}" for k in range(_KINDS)), "words", "distinct_words", "word_bytes", "top_word", "top_three_words", "bare_signs", "signed_words", "upper_words", "lines", "distinct_lines", "top_line", "line_bytes", "longest_line", "distinct_pairs", "worst_part_signs", "worst_part_upper", "worst_part_distinct")


def statistics(text: str | None) -> list[float]:
    """Shares of kinds of bytes, repetition of words, pairs and lines, and the worst of ten parts; zeros without text."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return [float(len(raw)), *([0.0] * (len(NAMES) - 1))]
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=_KINDS) / len(raw)
    n = len(words)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)]
    signed = np.fromiter((w[-1] in _SIGNS for w in words), bool, n)
    bare = sum(len(w) == 1 and w[0] in _SIGNS for w in words)
    upper = np.fromiter(map(bytes.isupper, words), bool, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_seen = Counter(lines)
    part = max(1, -(-n // 10))
    begin = np.arange(0, n, part)
    size = np.diff(np.append(begin, n))
    distinct = min(len(set(words[b : b + part])) / s for b, s in zip(begin.tolist(), size.tolist(), strict=True))
    return [
        float(len(raw)), *kinds.tolist(), float(n), len(seen) / n, len(raw) / n, top[0] / n, sum(top) / n, bare / n, float(signed.mean()), float(upper.mean()), float(len(lines)), len(line_seen) / len(lines),
        max(line_seen.values()) / len(lines), len(raw) / len(lines), max(map(len, lines)) / len(raw), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        float((np.add.reduceat(signed, begin) / size).max()), float((np.add.reduceat(upper, begin) / size).max()), distinct,
    ]


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> boosting.Forest | float:
    """The trees; with labels of one class or none, that class or 1 as the score of all.

    The driver holds NEGATIVES + POSITIVES rows of statistics at most: of rows that repeat a labelled doc_id, the one
    with the least statistics is fitted.
    """
    sample, _ = sampled(labels, label, DIVISOR, HELD, NEGATIVES, POSITIVES)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "y": batch.column(2), "x": [statistics(t) for t in batch.column(1).to_pylist()]}

        return one

    got = arrow_map(rows, make, fields(("doc_id", T.LongType()), ("y", T.IntegerType()), ("x", T.ArrayType(T.DoubleType()))))
    got = got.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    y = got.column("y").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return float(y[0]) if len(y) else 1.0
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    return boosting.grown(x, y)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """A score for each row's whole text.

    Null, empty and blank texts have zeros for statistics and are scored as such; repeated rows get equal scores; an
    empty table gives no rows. Other columns are not read. The statistics of a very long text are those of all of it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label))

    def make():
        model = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()])
            s = np.full(len(x), model) if isinstance(model, float) else 1 / (1 + np.exp(-model.margin(x)))
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return one

    return arrow_map(docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", DIVISOR) == HELD, F.lit(False)).alias("held_out")), make, SCORES)
