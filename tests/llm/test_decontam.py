import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushgrad.llm import decontam
from hushgrad.llm.automaton import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def brute(doc, items, window):
    ws, hit, names = words(doc), set(), set()
    for name, text in items:
        iw = words(text)
        wins = {tuple(iw[i : i + window]) for i in range(len(iw) - window + 1)} if len(iw) >= window else {tuple(iw)} if iw else set()
        for w in wins:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(str(name))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton_finds_what_brute_force_finds(items, doc, window):
    a = Automaton([(str(i), [w.encode() for w in ws]) for i, ws in enumerate(items)], window)
    spans, found = a.hits([w.encode() for w in doc])
    n, hit, k, _, _ = brute(" ".join(doc), [(i, " ".join(ws)) for i, ws in enumerate(items)], window)
    assert (sum(e - b for b, e in spans), len(found)) == (hit, k)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def fixture(seed=3):
    rng = random.Random(seed)
    vocabulary = ["Ab", "cé", "d1", "x'y", "Zz", "ñ", "漢字", "w"]
    text = lambda n: rng.choice([" ", "\n", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 5, 9, 10, 14, 30]))) for i in range(12)] + [(12, None), (3, "again here")]
    docs = [(i, text(rng.choice([0, 3, 20, 60])) + " " + rng.choice(items)[1:][0].__str__() * rng.randint(0, 1) + " " + text(4)) for i in range(60)] + [(60, None), (61, ""), (61, "w")]
    return docs, items


def test_query_equals_brute_force(spark, monkeypatch):
    docs, items = fixture()
    for size, part in ((8_000_000, 20_000), (400, 20_000), (400, 12), (8_000_000, 11)):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontam, "PART_WORDS", part)
        got = decontam.measured(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(tuple(r) for r in got) == sorted((d, *brute(x, items, 10)) for d, x in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.measured(docs, none).collect()] == [(1, 2, 0, 0)]
    assert decontam.measured(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("size", [8_000_000, 20])
def test_runs_are_cut_and_covered_texts_go(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"keep this, {item.upper()}! and also é this text of some more words, so that it is long enough", "en", 5), (2, item, "en", 5), (3, "clean", "en", 5), (4, None, "en", None), (5, "", "en", 0)],
        "doc_id long, text string, lang string, n_chars long",
    )
    out = {r.doc_id: r for r in decontam.decontaminated(docs, spark.createDataFrame([(1, item), (2, "other words that no text holds at all but which make another block"), (3, None)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1].text == "keep this, ! and also é this text of some more words, so that it is long enough" and out[1].n_chars == len(out[1].text)
    assert out[3] == (3, "clean", "en", 5) and out[4].text is None and out[5].text == ""


def test_an_item_of_any_length_is_one_item(spark, monkeypatch):
    rng = random.Random(8)
    words_ = [f"w{i}" for i in range(3000)]
    rng.shuffle(words_)
    monkeypatch.setattr(decontam, "PART_WORDS", 100)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    docs = [(i, "x " + " ".join(words_[b : b + n]) + " y") for i, (b, n) in enumerate([(0, 3000), (85, 30), (95, 10), (95, 9), (2990, 10)])]
    got = decontam.measured(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("big", " ".join(words_))], "item_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == [(0, 3002, 3000, 1), (1, 32, 30, 1), (2, 12, 10, 1), (3, 11, 0, 0), (4, 12, 10, 1)]


def test_clashing_columns_pass_through(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"{item} a b c d e f g h i j k l", "r", 3, "s"), (2, "clean", "r", 4, "s")], "doc_id long, text string, row string, spans int, items string")
    items = spark.createDataFrame([(1, item), (2, "p q r s t u v w x y z")], "item_id long, text string")
    for size in (1_000_000, 20):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        out = decontam.decontaminated(docs, items)
        assert out.schema == docs.schema
        assert sorted(tuple(r) for r in out.collect()) == [(1, " a b c d e f g h i j k l", "r", 3, "s"), (2, "clean", "r", 4, "s")]
