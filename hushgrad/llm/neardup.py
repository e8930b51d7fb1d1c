"""Near-duplicates: SetSketch bands propose pairs, likelihood thins them out, full shingle sets confirm them.

Rows with equal sets are one class, and a class goes on as one node with one representative row. Bands with several
nodes first propose each node with one member of its band, the one that shares most bands with others. So large groups
of copies come together by stars, in as many pairs as there are nodes. Of bands that still hold nodes not known to be
connected, small ones propose their pairs; the nodes of large ones are compared by the rarest shingles that they share
with others, which loses no link. Nodes that merely hold one long passage are told by the sizes alone: of two similar
sets the smaller one must share nearly all of its shingles, and without such a node a shingle forms no pairs.

Whatever is joined by a key that many rows may have (a band, a centre, a shingle) has an exchange of its own on both
sides, so that Spark splits such keys when it runs (adaptive skew joins); hot shingles are salted besides.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketches
from ._shared import arrow_map, dropped, fields, joined, saved, small_batches
from .components import components

#: Links need 100 * intersection >= PERCENT * union. Estimates under SURE are no links (they stray by 0.04 at 0.75).
PERCENT, SURE = 75, 0.55
#: Nodes of a band from which on its pairs are found by rare shingles instead of one by one; no pair is lost.
LARGE = 16
#: Nodes with one shingle that one task compares with others, about.
SPLIT = 1000
#: Bits of the map of documents whose texts a join needs (2 MB).
BITS = 1 << 24

FEATURES = fields(("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("set_key", T.BinaryType()), ("text_key", T.BinaryType()), ("registers", T.BinaryType()))
PAIR = fields(("a", T.LongType()), ("b", T.LongType()))


def _digest(raw: bytes) -> bytes:
    return hashlib.md5(raw, usedforsecurity=False).digest()


def features(docs: DataFrame) -> DataFrame:
    """For each row the size, digest and registers of its set, and the digest of its text; nulls for an empty set."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_shingles": [], "set_key": [], "text_key": [], "registers": []}
            for text in batch.column(1).to_pylist():
                s = sketches.shingles(text)
                row = (len(s), *((_digest(s.tobytes()), _digest(text.encode()), sketches.registers(s)) if len(s) else (None, None, None)))
                for c, x in zip(out.values(), row, strict=True):
                    c.append(x)
            return {"doc_id": batch.column(0)} | out

        return one

    return arrow_map(docs.select("doc_id", "text"), make, FEATURES)


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers make a similarity near the limit possible."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            col = {n: batch.column(n) for n in batch.schema.names}
            ra, rb = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint8).reshape(-1, sketches.REGISTERS) for c in ("r_a", "r_b"))
            j = sketches.estimated(col["n_a"].to_numpy(), col["n_b"].to_numpy(), (ra > rb).sum(axis=1), (ra < rb).sum(axis=1))
            keep = pa.array(j >= SURE)
            return {"a": col["a"].filter(keep), "b": col["b"].filter(keep)}

        return one

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_sizes("n_a", "n_b"))
    return arrow_map(joined, make, PAIR)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose whole shingle sets are similar enough; texts has one row (node, text) for each node."""

    def make():
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            if (s := recent.get(node)) is None:
                s = recent[node] = sketches.shingles(text)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return s

        def one(batch: pa.RecordBatch) -> dict:
            keep = []
            for a, x, b, y in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b")), strict=True):
                s, t = of(a, x), of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            k = pa.array(keep, pa.bool_())
            return {"a": batch.column("a").filter(k), "b": batch.column("b").filter(k)}

        return one

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return arrow_map(pairs.join(side("a"), "a").join(side("b"), "b"), make, PAIR)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, n_shingles, set_key and more of every row, and (set_key, component_id, stays) of every class
    with its representative row (unnamed, key, text_key)."""
    texts = docs.select("doc_id", "text")
    made = saved(features(texts), "features")
    # The row that stands for a class: rows with an id first, then the smallest id, then any one text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "n_shingles", "registers")).alias("r")
    classes = made.where("n_shingles > 0").groupBy("set_key").agg(first).select(F.monotonically_increasing_id().alias("node"), "set_key", "r.*")
    classes = saved(classes, "classes")  # numbered once and for all
    group, used = _linked(texts, classes)
    owned = classes.select("node", "set_key", "unnamed", "doc_id", "text_key").join(group, "node", "left").withColumn("component", F.coalesce("component", "node")).persist()
    least = owned.groupBy("component").agg(F.min(F.struct("unnamed", "doc_id", "text_key", "node")).alias("l")).select("component", F.col("l.doc_id").alias("component_id"), F.col("l.node").alias("stayer"))
    named = joined(owned, least, "component").select("set_key", "component_id", (F.col("node") == F.col("stayer")).alias("stays"), "unnamed", F.coalesce("doc_id", F.lit(0)).alias("key"), "text_key")
    named = saved(named, "named")
    owned.unpersist()
    dropped(*used, classes)
    return made, named


def _linked(texts: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) of every node with links, and the tables that this lies in."""
    sets = classes.select("node", "n_shingles", "registers")
    key = lambda i: F.xxhash64(i, F.substring("registers", i * sketches.ROWS + 1, sketches.ROWS))
    banded = sets.select("node", "n_shingles", F.explode(F.transform(F.sequence(F.lit(0), F.lit(sketches.BANDS - 1)), key)).alias("band"))
    held = joined(banded, banded.groupBy("band").agg(F.count("*").alias("held")).where("held > 1"), "band")
    # What a group's copies derive from lies in the largest bands of all: it makes the best centre.
    members = saved(held.withColumn("weight", F.sum("held").over(Window.partitionBy("node"))), "members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = saved(_likely(pairs, sets), "likely")
        some = _texts(texts, classes, _nodes(likely))
        out = saved(_confirmed(likely, some), "confirmed")
        dropped(likely, some)
        return out

    at = members.groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("o"), "node", "n_shingles")).alias("m"))
    near = joined(members, at.select("band", F.col("m.node").alias("c"), F.col("m.n_shingles").alias("n")), "band")
    near = near.where((F.col("node") != F.col("c")) & _near_sizes("n", "n_shingles"))
    star = saved(near.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct(), "pairs")
    links = confirmed(star)
    known = components(links)
    dropped(links)
    live = members.join(known, "node", "left").select("band", "node", "n_shingles", "held", F.coalesce("component", "node").alias("component"))
    live = saved(live, "live")
    dropped(members)
    mixed = live.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    open_ = saved(joined(live, mixed, "band", "left_semi"), "open")
    dropped(live)
    if open_.isEmpty():
        return known, [known, star, open_]
    x, y = open_.where(F.col("held") <= LARGE).alias("x"), open_.where(F.col("held") <= LARGE).alias("y")
    small = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _near_sizes("x.n_shingles", "y.n_shingles"))
    pairs, used = small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), []
    rest = open_.where(F.col("held") > LARGE).select("node", "component").distinct().persist()
    if not rest.isEmpty():
        some = _texts(texts, classes, rest.select("node"))
        sharing, used = _sharing(some, rest)
        pairs = pairs.union(sharing)
        dropped(some)
    more = confirmed(pairs.distinct().join(star, ["a", "b"], "left_anti"))
    rest.unpersist()
    dropped(open_, star, *used)
    # What is new links components that are known, so only those are contracted again.
    own = known.select(F.col("node").alias("a"), F.col("component").alias("low"))
    new = more.join(own, "a", "left").select(F.coalesce("low", "a").alias("a"), "b")
    new = new.join(own.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("low", "b").alias("b"))
    upper = components(new)
    dropped(more)
    top = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    both = known.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = upper.join(known, "node", "left_anti")
    return both.union(fresh), [known, upper]


def _near_sizes(a: str, b: str):
    """Whether the sizes of two sets allow the similarity at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _texts(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), written: the representatives' texts of some nodes, one row each, however often their rows repeat.

    A bitmap of fixed size, whatever the number of nodes, keeps most other rows out of the join.
    """
    spark = texts.sparkSession
    chosen = classes.join(nodes, "node", "left_semi").select("node", "unnamed", F.coalesce("doc_id", F.lit(0)).alias("key"), "text_key")
    chosen = chosen.persist()
    words = chosen.select(F.pmod("key", F.lit(BITS)).alias("h")).groupBy(F.floor(F.col("h") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 32, np.uint32)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = sent.value
        for batch in batches:
            h = np.mod(batch.column("key").to_numpy(zero_copy_only=False), BITS).astype(np.int64)
            yield batch.filter(pa.array((bits[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1))

    small_batches(spark)
    keyed = texts.where("text is not null").select(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("key"), "text")
    some = keyed.mapInArrow(run, keyed.schema).withColumn("text_key", _text_key())
    keys = ["unnamed", "key", "text_key"]
    out = saved(some.dropDuplicates(keys).join(chosen, keys).select("node", "text"), "texts")
    chosen.unpersist()
    sent.destroy()
    return out


def _text_key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _sharing(texts: DataFrame, rest: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of different components that can be similar, by prefixes of their sets, and the tables they come from.

    Only shingles that two components share can be in the overlap of such a pair. Of n shingles m are of this kind; an
    overlap of at least PERCENT of n leaves m - ceil(PERCENT n / 100) of them out at most, so in one order for all,
    rare ones first, two similar sets share one of their first shingles. Of two similar sets the smaller one has at
    least 2 PERCENT n / (100 + PERCENT) shingles in the overlap; it is called able. A shingle without an able node is
    as good as unshared, and pairs are formed only between able nodes and others that are no smaller. No pair is lost;
    pairs whose m is too small for an overlap, such as strayed copies of one text, are never formed.
    """
    rows = texts.join(rest, "node").select("node", "component", "text")

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            sets = [sketches.shingles(text).view(np.int64) for text in batch.column(2).to_pylist()]
            n = np.array([len(s) for s in sets])
            at = pa.array(np.repeat(np.arange(len(sets)), n))
            return {"shingle": np.concatenate(sets), "node": batch.column(0).take(at), "component": batch.column(1).take(at), "n": np.repeat(n, n).astype(np.int32)}

        return one

    schema = fields(("shingle", T.LongType()), ("node", T.LongType()), ("component", T.LongType()), ("n", T.IntegerType()))
    rows = arrow_map(rows, make, schema)
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    own = Window.partitionBy("node")
    both = joined(rows, mixed, "shingle", "left_semi").withColumn("m", F.count("*").over(own))
    kept = saved(both.where(F.col("m") * 100 >= PERCENT * F.col("n")).withColumn("able", _able("m", "n")), "kept")
    frequency = kept.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("able").alias("any")).where("low < high and any").select("shingle", "df")
    shared = joined(kept.drop("able"), frequency, "shingle")
    # Shingles that have become unshared count as left out: they take the first places, which need no rows.
    place = F.row_number().over(own.orderBy("df", "shingle")) + F.col("m") - F.count("*").over(own)
    first = shared.withColumn("place", place).where(F.col("place") <= F.col("m") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    first = saved(first.select("shingle", "node", "component", "n", "df", (F.col("m") - F.col("place") + 1).alias("left")), "prefixes")
    dropped(kept)
    parts = F.floor(F.col("df") / SPLIT).cast("int") + 1
    x = first.where(_able("left", "n")).withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).alias("x")
    y = first.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("y")
    # From two sets' first shared shingle on, as much must be left of both as an overlap needs.
    room = F.least("x.left", "y.left") * (100 + PERCENT) >= PERCENT * (F.col("x.n") + F.col("y.n"))
    fits = (F.col("x.n") <= F.col("y.n")) & (F.col("x.component") != F.col("y.component")) & _near_sizes("x.n", "y.n") & room
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt")) & fits)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), [first]


def _able(shared: str, n: str):
    """Whether a set with so many shared shingles may be the smaller one of a similar pair."""
    return F.col(shared) * (100 + PERCENT) >= 2 * PERCENT * F.col(n)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row: the size of its set, the smallest doc_id it is linked with over any path, whether it stays.

    Null, empty and blank texts have an empty set and stay alone. Equal sets are linked, whatever their ids. Rows that
    repeat a doc_id are rows of their own: with equal texts they are linked as copies, with others each has its own
    links. Rows without doc_id are linked like any other; a group without any doc_id has null for a component. An empty
    table gives no rows; other columns are not read. A very long text is handled whole in one task.
    """
    rows, classes = _grouped(docs)
    out = rows.join(classes.select("set_key", "component_id"), "set_key", "left")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns, and every row without words.

    Of a group the row with the smallest doc_id stays; one without doc_id only where no row has one. Of rows that
    repeat this row's doc_id and text, one stays. Extra columns of any name pass through; an empty table stays empty.
    """
    rows, classes = _grouped(docs)
    dropped(rows)
    own = {c: f"hushgrad_{c}" for c in ("unnamed", "key", "text_key")}
    stays = classes.where("stays").select(*[F.col(c).alias(n) for c, n in own.items()])
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumns({own["unnamed"]: F.col("doc_id").isNull(), own["key"]: F.coalesce("doc_id", F.lit(0)), own["text_key"]: _text_key()})
    one = keyed.join(stays, list(own.values()), "left_semi").dropDuplicates(list(own.values())).select(*docs.columns)
    return one.union(docs.where(~worded))
