"""Toxicity scores of whole texts by a small convolutional classifier, with a threshold for each language.

The classifier is fitted on every labelled row outside the held fold and on every word of it: four fifths train the net,
the rest sets the thresholds. Texts become word codes once, written to the shared folder in parts of about PART_ROWS rows,
PARTS at most. In each pass every part trains the net that it was sent, one step after the other, and the driver averages
what they made of it; it holds PARTS nets at most, never rows. Thresholds come from counts of scores in steps of 0.001,
the digits that scores keep. A text's language is told by its own frequent words, never by a column. Each language's
threshold is its own one and the shared one, weighted by its labelled rows and SHRINK. Scores are shifted so that 0.5 is
the threshold of the text's language.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import convnet
from ._shared import arrow_map, crc_mod, dropped, fields, saved, small_batches
from .labelled import labelled

#: Labelled rows that one task trains on, about, and how many tasks train at once at most (their parts grow beyond).
PART_ROWS, PARTS = 4096, 32
#: Texts of a part that are shuffled together.
SHUFFLED = 10 * convnet.BATCH
#: For _spread, which the fit does not use: it takes whole texts.
FIT_WORDS, FIT_PIECE = 4096, 64
#: How many labelled rows the shared threshold counts for in that of each language.
SHRINK = 30
DIVISOR, HELD = 5, 0

SCORES = fields(("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType()))


class Model:
    """score(codes): probabilities with 0.5 at the language's threshold. Without both labels, a constant."""

    def __init__(self, net: convnet.Net | None, cuts: np.ndarray | None, constant: float = 0.0):
        self.net, self.cuts, self.constant = net, cuts, constant

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.constant)
        code = [convnet.codes(t) for t in texts]
        # Rounded, so that what else is in a batch can't show in the last digits.
        z = np.round(convnet.logits(self.net, code) - self.cuts[[convnet.language(c) for c in code]], 3)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where the weighted errors are fewest: the middle of the widest such gap, or 0, the net's own border, if that lies
    in the inner half of the gap (texts without words are near it)."""
    order = np.argsort(z)
    z, y, w = z[order], y[order], weight[order]
    wrong = np.concatenate(([0], np.cumsum(np.where(y == 1, w, -w)))) + w[y == 0].sum()
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    gap = np.concatenate(([0], np.diff(z), [0]))
    wrong[1:-1][gap[1:-1] == 0] = np.inf  # equal scores stay together
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = best[gap[best].argmax()]
    return 0.0 if abs(edges[at]) < gap[at] / 4 else float(edges[at])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The net and its thresholds, from all labelled rows; rows that repeat both doc_id and words count once."""
    truth = labelled(labels, label, DIVISOR, HELD)
    # Ids and labels go to the tasks, so that no text is shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(truth), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            code = [convnet.codes(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "y": batch.column(2), "code": pa.array(code, pa.list_(pa.int32()))}

        return one

    coded = arrow_map(rows, make, fields(("doc_id", T.LongType()), ("y", T.IntegerType()), ("code", T.ArrayType(T.IntegerType()))))
    parts = min(PARTS, max(1, -(-truth.count() // PART_ROWS)))
    coin = F.xxhash64("doc_id", "code")
    marked = coded.withColumn("coin", coin).withColumn("part", F.pmod("coin", F.lit(parts)).cast("int")).withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    once = marked.repartition(parts, "part").dropDuplicates(["part", "coin", "doc_id"])  # one shuffle, of codes
    kept = saved(once.sortWithinPartitions("part", "coin", "doc_id").select("part", "apart", "y", "code"), "toxicity-codes")
    try:
        count = {(r.apart, r.y): r.n for r in kept.groupBy("apart", "y").agg(F.count("*").alias("n")).collect()}
        found = {y for _, y in count}
        if len(found) < 2:
            return Model(None, None, float(max(found, default=0)))
        net = _trained(kept.where("not apart").select("part", "y", "code"), [count.get((False, y), 0) for y in (0, 1)])
        return Model(net, _cuts(kept.where("apart").select("y", "code"), net))
    finally:
        dropped(kept)


def _trained(rows: DataFrame, count: list[int]) -> convnet.Net:
    """The net after all passes; both classes weigh the same. Rows are part, y and code, those of a part side by side."""
    spark, state = rows.sparkSession, convnet.Training()
    weights = np.array([0.5 * sum(count) / max(1, n) for n in count])
    small_batches(spark)
    for epoch in range(convnet.EPOCHS):
        sent = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
            def results():
                now, part, n, pile, piles = None, None, 0, [], 0

                def spent():
                    nonlocal pile, piles
                    order = np.random.default_rng([epoch, part, piles]).permutation(len(pile))
                    for k in range(0, len(order), convnet.BATCH):
                        some = [pile[i] for i in order[k : k + convnet.BATCH]]
                        y = np.array([y for y, _ in some])
                        now.step([c for _, c in some], y.astype(np.float32), weights[y])
                    pile, piles = [], piles + 1

                for batch in batches:
                    codes = batch.column(2)
                    for i, (p, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                        if p != part or len(pile) == SHUFFLED:
                            if pile:
                                spent()
                            if p != part:
                                if n:
                                    yield now.since(sent.value, n)
                                now, part, n, piles = copy.deepcopy(sent.value), p, 0, 0
                        pile.append((y, codes[i].values.to_numpy().astype(np.int64)))
                        n += 1
                if pile:
                    spent()
                    yield now.since(sent.value, n)

            for r in results():
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(r)], pa.binary())], ["made"])

        made = [pickle.loads(r.made) for r in rows.mapInArrow(run, "made binary").collect()]  # noqa: S301
        if made:
            state.joined(made)
        sent.destroy()
    return state.net


def _cuts(rows: DataFrame, net: convnet.Net) -> np.ndarray:
    """The thresholds from all rows of y and code, by counts of equal scores."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            code = [c.values.to_numpy().astype(np.int64) for c in batch.column(1)]
            step = np.rint(np.clip(convnet.logits(sent.value, code), -100, 100) * 1000).astype(np.int64)
            return {"spoken": np.array([convnet.language(c) for c in code], np.int32), "y": batch.column(0), "step": step}

        return one

    scores = arrow_map(rows, make, fields(("spoken", T.IntegerType()), ("y", T.IntegerType()), ("step", T.LongType())))
    got = scores.groupBy("spoken", "y", "step").agg(F.count("*").alias("n")).orderBy("spoken", "step", "y").toArrow()
    sent.destroy()
    spoken, y, step, n = (got.column(c).to_numpy() for c in got.column_names)
    return thresholds(step / 1000, y, n.astype(float), spoken, n)


def thresholds(z: np.ndarray, y: np.ndarray, weight: np.ndarray, spoken: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """A threshold for each language: its own and the shared one, in proportion to its rows and SHRINK.

    A language without rows of both labels has no threshold of its own; it gets the shared one. count: how many rows
    each entry stands for, if not one. Without rows all thresholds are 0.
    """
    count = np.ones(len(z)) if count is None else count
    shared = _cut(z, y, weight) if len(z) else 0.0
    cuts = np.full(len(convnet.LANGUAGES), shared)
    for k in range(1, len(cuts)):
        own = spoken == k
        if 0 < y[own].sum() < own.sum():
            n = count[own].sum()
            cuts[k] = (n * _cut(z[own], y[own], weight[own]) + SHRINK * shared) / (n + SHRINK)
    return cuts


def _spread(code: np.ndarray) -> np.ndarray:
    """All codes of a text, or pieces of a long one that are evenly spread from its beginning to its end."""
    if len(code) <= FIT_WORDS:
        return code
    begin = np.linspace(0, len(code) - FIT_PIECE, FIT_WORDS // FIT_PIECE).astype(np.int64)
    return code[(begin[:, None] + np.arange(FIT_PIECE)).ravel()]


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """A score for each row's whole text.

    Null and empty texts get the score of a text without words; repeated rows get equal scores; an empty table gives no
    rows. Without labelled rows of both classes all scores are the one label there is, or 0. Other columns are not read.
    A very long text is scored in parts, with the score that it has in one piece.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label))

    def make():
        model = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            s = model.score(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return one

    return arrow_map(docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", DIVISOR) == HELD, F.lit(False)).alias("held_out")), make, SCORES)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns, whatever those are called.

    Null and empty texts are scored as texts without words; repeated rows share their fate; an empty table stays empty;
    without labelled rows of both classes all rows go if the one label is 1, else all stay. Very long texts are scored
    whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(batch.column(at).to_pylist()) < 0.5))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
