"""Shards of equal row counts that keep linked documents together: balanced label propagation in joins.

Documents with equal texts are linked. Groups of more than a hundredth of a shard, 100 a shard at most, are dealt to as
few shards as possible by quotas. Every other linked document starts in a shard by the rank of a hash, but for some
groups that wait outside where shards would be full from the start. In each round every group that is still split turns to the open shard with most of it, or else to any open shard with room for all of it, or else to its fullest shard,
which others may leave. Coins of group and round admit groups whole: as many as fit the shard's room with what leaves it
in the same round, so no shard exceeds its target. Where less than half of what wants to move can, all groups that are
still split leave their shards and wait. Rounds go on until no group is split or waits, or none has moved in some
rounds; the last few are dealt one by one. All other documents fill the shards up, so counts differ by one
at most.

Everything is DataFrame functions; the driver sees sums by shard and coin, and bounded numbers of groups. Ranks are
counted in hashed buckets of bounded size whose starts are running sums, so no task holds a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import dropped, saved

SHARDS = 24
#: Rows that one bucket of a ranking has, about.
BUCKET = 50_000
#: Rounds without a move after which propagation ends, and split groups that the driver deals one by one.
STILL, REST = 3, 2_000
#: Room that rounds need at least, as a part of the documents of small groups: so many wait outside at first.
SPARE = 0.05
#: Coins have 30 bits and count by their logarithms: steps of a quarter of an octave.
_BITS, _STEPS = 30, 4

Parts = list[tuple[int, int]]
_LABELS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("n", T.LongType())])))])


def ranked(rows: DataFrame, within: list[str], total: int, name: str, rows_each: int | None = None) -> DataFrame:
    """Adds ranks from 0 within equal columns, in an order by hash; rows have doc_id, text_crc32 and size."""
    buckets = max(1, -(-total // (rows_each or BUCKET)))
    # A hash of several columns, not of doc_id alone, which other hashes of the plan deal rows out by.
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(name), "doc_id", "text_crc32"), F.lit(buckets)))
    order = Window.partitionBy(*within, "bucket").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*within, "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return salted.withColumn("nth", F.row_number().over(order) - 1).join(starts, [*within, "bucket"]).withColumn(name, F.col("nth") + F.col("start")).drop("nth", "start", "bucket")


def dealt_out(n: int, room: list[int], own: Parts = ()) -> Parts:
    """n documents of a group to as few shards as their room allows: to the one with most of the group, or where least is left over; takes the room."""
    parts = []
    while n:
        fits = [s for s, r in enumerate(room) if r >= n]
        held = dict(own)
        s = min(fits, key=lambda s: (-held.get(s, 0), room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], held.get(s, 0), -s))
        took = min(n, room[s])
        parts.append((s, took))
        room[s] -= took
        n -= took
    return parts


def dealt_again(groups: dict[bytes, tuple[int, Parts]], room: list[int]) -> dict[bytes, Parts]:
    """Waiting and split groups dealt one by one, largest first, until none is in fewer parts than before; takes the room."""
    order = sorted(groups, key=lambda k: (-groups[k][0], k))
    parts = {k: groups[k][1] or dealt_out(groups[k][0], room) for k in order}
    while True:
        before = sum(map(len, parts.values()))
        for k in order:
            if len(parts[k]) > 1:
                for s, n in parts[k]:
                    room[s] += n
                parts[k] = dealt_out(groups[k][0], room, parts[k])
        if sum(map(len, parts.values())) == before:
            return parts


def admitted(wants: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For wants (to, step of the coin, from, where the last is outside), the first step from which on each shard takes in: the most that fit its
    room and what leaves it then. Lowering one shard's share only lowers what leaves others, so this ends at the most."""
    after = np.concatenate([wants[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros_like(wants[:, :1])], axis=1)
    into, each = after.sum(axis=2), np.arange(len(room))
    cut = np.zeros(len(room), int)
    while True:
        free = room + after[each, cut].sum(axis=0)[: len(room)]
        new = np.maximum(cut, (into > np.maximum(free, 0)[:, None]).sum(axis=1))
        if (new == cut).all():
            return cut
        cut = new


def _at(values: list, shard: Column, kind: str = "long") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), shard + 1)


def _coin(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("coin"), *columns), F.lit(1 << _BITS))


def propagated(groups: DataFrame, room: list[int]) -> list[DataFrame]:
    """Tables of key and parts (structs of shard and n): split and waiting groups (key, n, parts) moved whole where shards have room for them; takes the room.

    Groups that no shard has had room for may still be split, or be missing if they wait.
    """
    spark, shards, steps = groups.sparkSession, len(room), _BITS * _STEPS + 1
    done, active = [groups.where(F.size("parts") == 1).select("key", "parts")], groups.where(F.size("parts") != 1)
    opened, turn, still = [True] * shards, 0, 0
    while (left := active.count()) > REST and still < STILL:
        most = max(range(shards), key=lambda s: room[s])
        salt = F.lit(turn)
        # Ties between shards go by a hash of group and round, so that no shard draws all of them.
        fullest = lambda parts: F.array_max(F.transform(parts, lambda p: F.struct(p["n"].alias("n"), F.xxhash64("key", p["shard"], salt).alias("h"), p["shard"].alias("shard"))))["shard"]  # noqa: B023, E731
        ends = [int(e) for e in np.cumsum(np.maximum(room, 0))]
        drawn = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.pmod(F.xxhash64(F.lit("draw"), "key", salt), F.lit(max(1, ends[-1])))))  # noqa: B023
        drawn = F.least(drawn, F.lit(shards - 1))
        anywhere = F.when(_at(room, drawn) >= F.col("n"), drawn).when(F.lit(room[most]) >= F.col("n"), F.lit(most))
        goal = F.coalesce(fullest(F.filter("parts", lambda p: _at(opened, p["shard"], "boolean"))), anywhere, fullest(F.col("parts")))  # noqa: B023
        step = F.floor(-F.log2((_coin("key", salt) + 1) / float(1 << _BITS)) * _STEPS).cast("int")
        aimed = saved(active.select("key", "n", "parts", goal.cast("int").alias("goal"), step.alias("step")), "goals")
        outside = F.array(F.struct(F.lit(shards).alias("shard"), F.col("n")))
        moves = aimed.where("goal is not null").select("goal", "step", F.explode(F.when(F.size("parts") == 0, outside).otherwise(F.filter("parts", lambda p: p["shard"] != F.col("goal")))).alias("p")).groupBy("goal", "step", "p.shard").agg(F.sum("p.n").alias("n"))
        wants = np.zeros((shards, steps, shards + 1), np.int64)
        for r in moves.collect():  # bounded by shards and steps of the coin
            wants[r.goal, r.step, r.shard] = r.n
        cut = admitted(wants, np.array(room))
        moved = sum(wants[s, cut[s] :].sum(axis=0) for s in range(shards))
        room[:] = [int(room[s] + moved[s] - wants[s, cut[s] :].sum()) for s in range(shards)]
        opened = [bool(c == 0 and r > 0) for c, r in zip(cut, room, strict=True)]
        still = 0 if moved.sum() else still + 1
        goes, kept = F.col("goal").isNotNull() & (F.col("step") >= F.coalesce(_at(cut.tolist(), F.coalesce("goal", F.lit(0))), F.lit(steps))), F.col("parts")
        if 2 * moved.sum() < wants.sum():
            # Split groups are in each other's way: what is left of them waits outside from now on.
            for r in aimed.where(~goes).select(F.explode("parts").alias("p")).groupBy("p.shard").agg(F.sum("p.n").alias("n")).collect():
                room[r["shard"]] += r.n
            kept = F.filter("parts", lambda p: F.lit(False))
        new = saved(aimed.withColumn("parts", F.when(goes, F.array(F.struct(F.col("goal").alias("shard"), F.col("n")))).otherwise(kept)).select("key", "n", "parts"), "labels")
        dropped(aimed)
        done.append(new.where(F.size("parts") == 1).select("key", "parts"))
        active, turn = new.where(F.size("parts") != 1), turn + 1
    if left > REST:
        return [*done, active.where(F.size("parts") > 1).select("key", "parts")]
    rest = dealt_again({bytes(r.key): (r.n, [(p.shard, p.n) for p in r.parts]) for r in active.collect()}, room)
    return [*done, spark.createDataFrame(list(rest.items()), _LABELS)]


def cut(placed: DataFrame) -> DataFrame:
    """How well rows of sharded() keep together: groups of equal texts, those in several shards, links and cut links.

    A group of n rows has n - 1 links, of which one less than its shards are cut. Texts count as equal by size and CRC.
    """
    by = placed.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n")).groupBy("size", "text_crc32").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).where("n > 1")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by.agg(F.count("*").alias("groups"), F.count_if(F.col("parts") > 1).alias("split"), zero(F.sum(F.col("n") - 1)).alias("links"), zero(F.sum(F.col("parts") - 1)).alias("cut"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row.

    A null text counts as empty and belongs to the group of empty texts: size 8, CRC 0. Groups larger than a shard are
    spread over as few shards as the quotas allow. Rows that repeat a document get places each; a null doc_id is an
    id like others. An empty table gives no rows; other columns are not read. Of a very long text only the size, CRC
    and digest are kept. cut() says how many links of the result are cut.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = saved(docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("key")), "slim")
    spark, total = docs.sparkSession, slim.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    groups = saved(slim.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    is_large = F.col("n") * 100 * shards > total
    room = list(targets)
    large = {bytes(r.key): dealt_out(r.n, room) for r in sorted(groups.where(is_large).collect(), key=lambda r: (-r.n, r.key))}  # at most 100 a shard

    # The table of large groups is small enough to go to all tasks, so that no join deals a large group to one of them.
    known = F.broadcast(spark.createDataFrame(list(large.items()), _LABELS))
    others = slim.join(known, "key", "left_anti")
    small = others.join(groups.where(~is_large), "key", "left_semi")
    linked = groups.where(~is_large).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    # Small groups start in proportion to the room that is left.
    ends = [int(e) * linked // max(1, sum(room)) for e in np.cumsum(room)]
    place = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    started = ranked(small, [], total, "rank").groupBy("key", place.cast("int").alias("shard")).agg(F.count("*").alias("n"))
    started = started.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("shard", "n")).alias("parts"))
    waits = _coin("key") < int((1 << _BITS) * max(0.0, SPARE - (sum(room) - linked) / max(1, linked)))
    started = saved(started.withColumn("parts", F.when(waits, F.filter("parts", lambda p: F.lit(False))).otherwise(F.col("parts"))), "labels")
    for r in started.select(F.explode("parts").alias("p")).groupBy("p.shard").agg(F.sum("p.n").alias("n")).collect():
        room[r["shard"]] -= r.n
    tables = propagated(started, room)
    labels = tables[0]
    for t in tables[1:]:
        labels = labels.unionByName(t)

    named = saved(slim.join(known, "key").unionByName(others.join(labels, "key")), "linked")
    plain = ("doc_id", "text_crc32", "size")
    stay = named.where(F.size("parts") == 1).select(*plain, F.col("parts")[0]["shard"].alias("shard"))
    # Documents of a group in several shards are dealt by rank, in small buckets: the large groups are here.
    upto = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).alias("at")), lambda a, p: F.struct((a["end"] + p["n"]).alias("end"), (a["at"] + (a["end"] + p["n"] <= F.col("place")).cast("int")).alias("at")))["at"]
    torn = ranked(named.where(F.size("parts") > 1), ["key"], total, "place", min(BUCKET, max(1, total // 1000))).select(*plain, F.element_at("parts", upto + 1)["shard"].alias("shard"))
    loose = others.join(labels, "key", "left_anti").select(*plain)
    ends = [int(e) for e in np.cumsum(room)]
    place = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("filler")))
    filled = ranked(loose, [], total, "filler").select(*plain, place.cast("int").alias("shard"))
    dealt = saved(stay.unionByName(torn).unionByName(filled), "dealt")
    out = ranked(dealt, ["shard"], total, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
