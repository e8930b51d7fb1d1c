import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from hushgrad.llm import sharding


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == sorted(range(len(texts)))
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(shards))
    for s in by.values():
        assert sorted(s) == list(range(len(s)))
    n = [len(by.get(s, [])) for s in range(shards)]
    assert max(n) - min(n) <= 1
    where = defaultdict(Counter)
    for r in rows:
        where[texts[r.doc_id] or ""][r.shard] += 1
    return where


def test_counts_are_even_and_copies_stay_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 60)
    texts = [f"unique {i}" for i in range(300)] + [f"copy {i % 40}" for i in range(160)] + ["é"] * 120 + [None, "", None]
    docs = spark.createDataFrame([(i, x, 1, "s") for i, x in enumerate(texts)], "doc_id long, text string, shard int, key string").repartition(5)
    where = check(sharding.sharded(docs, 8).collect(), texts, 8)
    together = sum(len(w) == 1 for t, w in where.items() if t.startswith("copy"))
    assert together >= 34
    assert where["é"].most_common(1)[0][1] >= 40


def test_tiny_and_empty_tables(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    check(sharding.sharded(docs, 5).collect(), ["a", "a", None], 5)
    assert sharding.sharded(docs.limit(0), 5).count() == 0


def test_a_group_of_a_third_is_in_as_few_shards_as_hold_it(spark):
    texts = ["big"] * 792 + [f"copy {i // 3}" for i in range(900)] + [f"unique {i}" for i in range(708)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    where = check(sharding.sharded(docs, 24).collect(), texts, 24)
    assert len(where["big"]) == 8
    assert sum(len(w) == 1 for t, w in where.items() if t.startswith("copy")) >= 295


def test_rounds_go_on_where_shards_are_nearly_full(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REST", 0)
    for lone in (0, 60):
        texts = [f"copy {i // 3}" for i in range(3000)] + [f"unique {i}" for i in range(lone)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        where = check(sharding.sharded(docs, 6).collect(), texts, 6)
        together = sum(len(w) == 1 for t, w in where.items() if t.startswith("copy"))
        assert together >= (1000 if lone else 990), (lone, together)


def test_admission_counts_what_leaves():
    wants = np.zeros((2, 3, 3), int)
    wants[0, :, 1] = 5, 3, 2
    wants[1, :, 0] = 4, 4, 1
    assert sharding.admitted(wants, np.array([1, 0])).tolist() == [0, 0]
    assert sharding.admitted(wants, np.array([0, 0])).tolist() == [1, 1]
    wants[0, 2, 2] = 6  # from outside, which opens no shard
    assert sharding.admitted(wants, np.array([0, 0])).tolist() == [3, 3]


def fewest_cuts(sizes, shards):
    """The least sum of parts - 1 over groups, by trying every way to deal out the groups; the rest are single rows."""
    total = sum(sizes)
    room = tuple(total // shards + (s < total % shards) for s in range(shards))

    @functools.cache
    def best(i, room):
        if i == len(groups):
            return 0  # single rows fill up what is left
        out = 10**9

        def deal(s, left, now, parts):
            nonlocal out
            if left == 0:
                out = min(out, parts - 1 + best(i + 1, tuple(sorted(now))))
            elif s < shards:
                for n in range(min(left, now[s]), -1, -1):
                    deal(s + 1, left - n, (*now[:s], now[s] - n, *now[s + 1 :]), parts + (n > 0))

        deal(0, groups[i], room, 0)
        return out

    groups = sorted((x for x in sizes if x > 1), reverse=True)
    return best(0, tuple(sorted(room)))


def test_cut_links_are_near_the_optimum_on_tiny_graphs(spark, monkeypatch):
    rng = random.Random(3)
    cases = [([3, 3, 3], 3), ([2, 2, 2, 1, 1, 1], 3), ([4, 4, 1], 3), ([5, 2, 2], 3), ([2] * 6, 4), ([7], 3)]
    cases += [([rng.choice([1, 1, 2, 3, 4]) for _ in range(rng.randint(3, 7))], rng.choice([2, 3])) for _ in range(6)]
    ours = least = 0
    for sizes, shards in cases:
        texts = [f"g{i}" for i, n in enumerate(sizes) for _ in range(n)]
        placed = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), shards)
        where = check(placed.collect(), texts, shards)
        got, best = sum(len(w) - 1 for w in where.values()), fewest_cuts(sizes, shards)
        c = sharding.cut(placed).first()
        assert (c.cut, c.links, c.groups) == (got, sum(n - 1 for n in sizes), sum(n > 1 for n in sizes))
        assert got <= best + 1, (sizes, shards, got, best)
        ours, least = ours + got, least + best
    assert ours <= least + 2, (ours, least)
