import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushgrad.llm import packing
from hushgrad.llm._shared import tokenizer_path
from hushgrad.llm.tokens import ByteIds

TEXTS = [
    "a plain text, with words.", "", None, " leading", "trailing ", "two  spaces   three", "tab\tand\nlines\n\n next \n x", "it's we'll THEY'RE", "ünïcode ñandú 漢字 😀 é", "x" * 5000,
    "special <|endoftext|> inside  <|endoftext|> twice", " nbsp  em \x1c sep", "1234 5,678.90 ½ ²", " ", "  ", "\n", "a\n b \n c", "word " * 5000, "a plain text, with words.",
]


def reference_ids():
    t = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


_OURS, _THEIRS = ByteIds(tokenizer_path(packing.VOCABULARY)), reference_ids()


def test_ids_equal_the_librarys():
    ours, theirs = ByteIds(tokenizer_path(packing.VOCABULARY)), reference_ids()
    for x in TEXTS:
        assert list(array("I", ours(x or ""))) == theirs(x), x


RUNS = ["\n" * 300_000 + "a", "\t" * 100_000 + "b", "a" + " \n\t" * 100_000 + "c", " " * 300_000, "x " + "\n " * 100_000, "ab" * 100_000, "_" * 50_000 + " end", "w" + "\n" * 255 + "x " + "\n" * 256 + "y", "é\u3000" * 1000, "\u2003" * 100_000 + "."]


@pytest.mark.parametrize("text", RUNS, ids=range(len(RUNS)))
def test_ids_of_long_runs_equal_the_librarys(text):
    assert list(array("I", ByteIds(tokenizer_path(packing.VOCABULARY))(text))) == reference_ids()(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "\n", "\t", "\r\n", "  ", "\xa0", "\u3000", "\x1c", "\x85", "\u200b"]), st.text(max_size=4), st.sampled_from(["it's", "12", "a", "é", "漢", "!?"])), max_size=30).map("".join))
def test_ids_of_mixed_white_space_equal_the_librarys(text):
    assert list(array("I", _OURS(text))) == _THEIRS(text)


def test_every_piece_has_one_place_and_sequences_are_gapless(spark):
    docs = spark.createDataFrame([(i, x, "en", 1) for i, x in enumerate(TEXTS * 3)], "doc_id long, text string, piece string, start int")
    rows = packing.packed(docs, capacity=64).collect()
    ids = reference_ids()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == 3 * len(TEXTS)
    for doc, ps in by_doc.items():
        whole = [*ids((TEXTS * 3)[doc]), 0]
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert len(ps) == -(-len(whole) // 64)
        at = 0
        for p in ps:
            assert p.start == at and p.ids_crc32 == zlib.crc32(array("I", whole[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(whole)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert len(by_seq) <= 1.03 * sum(r.length for r in rows) / 64 + 1


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configurations_use_up_the_counts(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, dtype=np.int64)
    for x, n in zip(rng.integers(1, 101, 30), rng.integers(1, 400, 30), strict=True):
        counts[x] += n
    found = packing.configurations(counts, 100)
    used = Counter()
    for key, n in found:
        assert sum(key) <= 100
        for x in key:
            used[x] += n
    assert used == {int(i): int(counts[i]) for i in np.flatnonzero(counts)}
    best = sum(n for _, n in packing.best_fit(Counter({int(i): int(counts[i]) for i in np.flatnonzero(counts)}), 100))
    assert sum(n for _, n in found) <= 1.02 * best + 1


def test_ranks_in_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    docs = spark.createDataFrame([(i, "same text") for i in range(200)], "doc_id long, text string")
    rows = packing.packed(docs, capacity=32).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 200
    assert len({r.sequence_id for r in rows}) == -(-200 // (32 // rows[0].length))


def fewest_sequences(pieces, capacity):
    """Exact bin packing by trying everything; for a few pieces."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= pieces[i]:
                rest = list(rooms)
                rest.remove(r)
                put(i + 1, (*rest, r - pieces[i]))
        put(i + 1, (*rooms, capacity - pieces[i]))

    put(0, ())
    return best


@pytest.mark.parametrize("few", [1500, 0])
def test_tiny_packings_are_near_the_optimum(monkeypatch, few):
    monkeypatch.setattr(packing, "FEW", few)
    rng, over = np.random.default_rng(2), 0
    for _ in range(40):
        capacity = int(rng.integers(8, 20))
        pieces = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
        n = sum(k for _, k in packing.configurations(np.bincount(pieces, minlength=capacity + 1), capacity))
        best = fewest_sequences(pieces, capacity)
        assert best <= n <= best + 1
        over += n - best
    assert over <= 2


@pytest.mark.parametrize("lengths", [20, 200, 500, 530, 900])
@pytest.mark.parametrize("total", [1000, 2500, 20_000])
def test_sequences_are_near_their_lower_bound_on_both_sides_of_the_switches(lengths, total):
    """Few and many lengths (SPARSE), and leftovers below and above what best fit takes at once (FEW)."""
    rng, capacity = np.random.default_rng(lengths + total), 1024
    chosen = rng.choice(np.arange(1, capacity), lengths, replace=False)
    counts = np.bincount(rng.choice(chosen, total, p=(w := 1 / chosen) / w.sum()), minlength=capacity + 1)
    n = sum(k for _, k in packing.configurations(counts, capacity))
    assert n <= 1.035 * lower_bound(counts, capacity) + 2


def test_best_fit_of_few_pieces_is_as_good_as_the_program(monkeypatch):
    rng, capacity = np.random.default_rng(1200), 1024
    chosen = rng.choice(np.arange(1, capacity), 200, replace=False)
    counts = np.bincount(rng.choice(chosen, 1000, p=(w := 1 / chosen) / w.sum()), minlength=capacity + 1)
    found = []
    for few in (1500, 200):
        monkeypatch.setattr(packing, "FEW", few)
        found.append(sum(k for _, k in packing.configurations(counts, capacity)))
    assert abs(found[0] - found[1]) <= 1


def lower_bound(counts, capacity):
    """Sequences that large pieces need, and what smaller ones need beside them (Martello and Toth's second bound)."""
    x, best = np.arange(capacity + 1), 0
    for k in range(1, capacity // 2 + 1):
        huge, large, small = x > capacity - k, (x > capacity // 2) & (x <= capacity - k), (x >= k) & (x <= capacity // 2)
        n = int(counts[huge].sum() + counts[large].sum())
        over = int((counts * x)[small].sum()) - (int(counts[large].sum()) * capacity - int((counts * x)[large].sum()))
        best = max(best, n + max(0, -(-over // capacity)))
    return best
