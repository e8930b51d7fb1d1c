import random
import re

import numpy as np
import pytest

from hushgrad.llm import neardup, sketches
from hushgrad.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(x):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    sets = [shingle_set(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = find(i), find(j)
                if rows[a][0] < rows[b][0]:
                    a, b = b, a
                root[a] = b
    return sorted((d, len(s), rows[find(i)][0], rows[find(i)][0] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n ", "one two", "One  TWO", "\xa0 nbsp is a word char", "a b c d e", "A B C D E f"]
    common = [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200]))] + common * rng.randint(0, 1)
        for _ in range(rng.choice([1, 2, 12])):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts += [" ".join(base)] * rng.choice([1, 1, 3])
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("large", [48, 1])
def test_components_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(neardup, "LARGE", large)
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, component_id int, band string").repartition(5)
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == brute(rows)
    kept = {r.doc_id for r in neardup.deduplicated(docs).collect()}
    assert kept == {d for d, _, _, k in brute(rows) if k}


def test_empty_table_and_repeated_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "p q r s t"), (None, "a b c d e f"), (None, "p q r s t"), (3, " \n"), (3, " \n")], "doc_id long, text string")
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 1, None, True), (None, 1, None, True), (None, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)]
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    # One row of each group, with or without an id, and all rows without words.
    assert sorted((tuple(r) for r in neardup.deduplicated(docs).collect()), key=str) == sorted([(1, "a b c d e f"), (2, None), (None, "p q r s t"), (3, " \n"), (3, " \n")], key=str)


def test_one_id_with_two_texts_keeps_all_links(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w x"), (3, "a b c d e f g h"), (5, "k l m n o p q"), (5, "A B C D E F G H I"), (None, "k l m n o p q"), (7, "k l m n o p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 5, 1, False), (3, 4, 1, False), (5, 3, 5, True), (5, 5, 1, False), (None, 3, 5, False), (7, 3, 5, False)], key=str)
    assert sorted((tuple(r) for r in neardup.deduplicated(docs).collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


def test_rows_that_repeat_do_not_multiply(spark, monkeypatch):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    docs = spark.createDataFrame([(1, a)] * 40 + [(2, b)] * 30 + [(None, b)] * 5, "doc_id long, text string").repartition(4)
    seen, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, texts: (seen.append((pairs.count(), texts.count())), confirmed(pairs, texts))[1])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 75 and {r.component_id for r in got} == {1} and all(p <= 1 and t <= 2 for p, t in seen)
    assert [r.doc_id for r in neardup.deduplicated(docs).collect()] == [1]


def passage_documents(n, own, common=80):
    return [" ".join([f"p{j}" for j in range(common)] + [f"d{i}_{j}" for j in range(own)]) for i in range(n)]


def test_a_common_passage_forms_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 1)
    texts = passage_documents(60, 20)
    rest = spark.createDataFrame([(i, i) for i in range(60)], "node long, component long")
    made = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    assert neardup._sharing(made, rest)[0].count() == 0
    both, rows = [], texts + passage_documents(3, 4) + [" ".join(f"p{j}" for j in range(80))]
    for parts in (1000, 3):
        monkeypatch.setattr(neardup, "SPLIT", parts)
        rest = spark.createDataFrame([(i, i) for i in range(len(rows))], "node long, component long")
        made = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
        both.append({tuple(r) for r in neardup._sharing(made, rest)[0].collect()})
    sets = [shingle_set(x) for x in rows]
    links = {(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert both[0] == both[1] >= links and len(both[0]) < 300
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == brute(list(enumerate(rows)))


def test_a_hot_centre_equals_brute_force(spark):
    rng = random.Random(6)
    base = [f"v{i}" for i in range(70)]
    texts = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(70)] = f"x{i}"
        texts.append(" ".join(t))
    rows = list(enumerate([*texts, *(f"lone {i} word here now and then" for i in range(40))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == brute(rows)


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "n", 2, b"k", 4), (2, "a b c d e f", "n", 2, b"k", 4)], "doc_id long, text string, node string, band int, text_key binary, component_id int")
    out = neardup.deduplicated(docs)
    assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", "n", 2, b"k", 4)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2600]), np.unique(x[400:])
    ra, rb, rc = (np.frombuffer(sketches.registers(s), np.uint8) for s in (a, b, np.union1d(a, b)))
    assert (np.maximum(ra, rb) == rc).all()
    true = 2200 / 3000
    got = sketches.estimated(np.array([len(a)]), np.array([len(b)]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0]
    assert abs(got - true) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(200, 260)] + [(259, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == 100 for x in range(100, 141)) and all(got[x] == 5 for x in (*range(200, 260), 300, 5))
