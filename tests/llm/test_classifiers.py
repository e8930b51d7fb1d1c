import random
import zlib

import numpy as np
import pytest

from hushgrad.llm import boosting, convnet, quality, toxicity


def corpus(n=900):
    rng = random.Random(2)
    clean = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "lo ma ne ti sa".split()]
    bad = ["grumf", "grumfol", "grumfit", "zzark", "zzarken"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(10, 80))] + ["the", "of"]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        good = i % 3 != 0
        text = " ".join(words if good else [w.upper() + "!!" for w in words])
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (5002, " \n "), (5003, docs[4][1]), (5003, docs[4][1]), (5004, "word " * 40_000 + "grumf zzark grumfol")]
    labels += [(4, 1, 1), (None, 1, 1), (7, None, None), (99_999, 0, 1)]
    return spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, y string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "column", "divisor", "held"), [(toxicity, 2, 5, 0), (quality, 1, 3, 1)])
def test_held_out_rows_are_told_apart(tables, operator, column, divisor, held):
    rows = operator.scored(*tables).collect()
    truth = {x[0]: x[column] for x in corpus()[1]}
    assert len(rows) == 906
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(by[5003]) == 2 and len({*by[5003], *by[4]}) == 1
    assert by[5000] == by[5001]


def test_long_texts_are_scored_to_their_end(tables):
    assert {r.doc_id: r.predicted for r in toxicity.scored(*tables).collect()}[5004] == 1
    kept = {r.doc_id for r in toxicity.accepted(*tables).collect()}
    assert 5004 not in kept and 5000 in kept and 5001 in kept


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_no_or_one_class_of_labels(spark, operator):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in operator.scored(docs, none).collect()}) == 1
    assert {r.score for r in operator.scored(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], none.schema)).collect()} == {1.0}
    assert operator.scored(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("words", [lambda i: f"w{i % 977}", lambda i: "ab"[i % 2], lambda i: "a", lambda i: "abc"[i % 3]], ids=["many", "two", "one", "three"])
def test_parts_of_a_text_score_like_the_whole(monkeypatch, words):
    net = convnet.Net.new(3)
    for n in (699, 700, 701, 702, 703, 1398, 1400, 5000):
        code = convnet.codes(" ".join(words(i) for i in range(n)))
        monkeypatch.setattr(convnet, "CHUNK", 1 << 15)
        whole = convnet.logits(net, [code])
        for chunk in (700, 101, 3):
            monkeypatch.setattr(convnet, "CHUNK", chunk)
            assert np.allclose(convnet.logits(net, [code, code[:2]])[0], whole, atol=1e-6), (n, chunk)


def plain_logit(net, code):
    """The net word by word: no batches, no layout."""
    x = [net.word[c & (convnet.WORD_BUCKETS - 1)] + net.stem[(c >> 15) & (convnet.STEM_BUCKETS - 1)] for c in code.tolist()] or [np.zeros(convnet.SIZE)]
    x += [np.zeros(convnet.SIZE)] * (convnet.WIDTHS[-1] - 1)
    tops = []
    for filters, w in zip(net.filters, convnet.WIDTHS, strict=True):
        f = filters.reshape(w, convnet.SIZE, convnet.FILTERS)
        places = [sum(x[p + i] @ f[i] for i in range(w)) for p in range(max(1, len(code)))]
        tops.append(np.max(places, axis=0))
    return np.maximum(np.concatenate(tops) + net.bias, 0) @ net.out + net.out_bias[0]


def test_logits_equal_a_plain_forward_pass():
    net, texts = convnet.Net.new(5), ["", "one", "two words", "the und a b c", "x y z " * 30]
    net.bias += 0.1
    code = [convnet.codes(t) for t in texts]
    assert np.allclose(convnet.logits(net, code), [plain_logit(net, c) for c in code], atol=1e-5)


def test_languages_with_few_labelled_rows_lean_on_the_shared_threshold():
    z = np.array([-3.0, -2, -1, 1, 2, 3, 4, 5, 6, 7])
    y = np.array([0, 0, 0, 1, 1, 1, 0, 0, 1, 1], float)
    spoken = np.array([1, 1, 1, 1, 1, 1, 2, 2, 2, 2])
    cuts = toxicity.thresholds(z, y, np.ones(10), spoken)
    shared = toxicity._cut(z, y, np.ones(10))
    assert cuts[0] == cuts[3] == shared
    for k, n, own in ((1, 6, 0.0), (2, 4, 5.5)):
        assert cuts[k] == pytest.approx((n * own + toxicity.SHRINK * shared) / (n + toxicity.SHRINK))


def test_long_labelled_texts_and_repeated_ids_give_a_bounded_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_WORDS", 128)
    long = np.arange(1000)
    assert len(toxicity._spread(long)) == 128 and {0, 999} <= set(toxicity._spread(long).tolist())
    docs, labels = corpus(200)
    docs = [(i, t) for i, t in docs for _ in range(3)] + [(3, "other text " * 400)] * 5
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for operator in (toxicity, quality):
        rows = operator.scored(*tables).collect()
        assert len(rows) == len(docs) and rows[0].score is not None
    assert 0 < toxicity.accepted(*tables).count() < len(docs)


def test_every_labelled_row_and_word_is_fitted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 1500)
    n = 7000
    docs = [(i, " ".join(["calm", "words", f"w{i % 50}"] * 3 + ["grumf"] * (i % 4 == 0))) for i in range(n)]
    # The only mark of these texts lies at one place of 6,000 words.
    docs += [(n + i, " ".join(["calm"] * (1500 + 61 * i) + ["zzark"] * (i % 2) + ["calm"] * (4500 - 61 * i))) for i in range(60)]
    labels = [(i, int(i % 4 == 0)) for i in range(n)] + [(n + i, i % 2) for i in range(60)]
    seen, saved = [], toxicity.saved

    def spy(df, name):
        out = saved(df, name)
        seen.extend((r.part, r.apart, len(r.code)) for r in out.collect())
        return out

    monkeypatch.setattr(toxicity, "saved", spy)
    tables = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(*tables)
    used = [t for i, t in docs if zlib.crc32(str(i).encode()) % toxicity.DIVISOR]
    assert sorted(len(t.split()) for t in used) == sorted(c for *_, c in seen)
    assert len({p for p, *_ in seen}) == 4 and len({a for _, a, _ in seen}) == 2
    predicted = model.score([t for _, t in docs]) >= 0.5
    right = [p == bool(y) for p, (_, y) in zip(predicted, labels, strict=True)]
    assert np.mean(right) > 0.99 and np.mean(right[n:]) > 0.9


def test_peaks_in_pieces_equal_those_of_the_whole(monkeypatch):
    net, texts = convnet.Net.new(7), ["", "a b", " ".join(f"w{i % 301}" for i in range(900)), "the und x", ""]
    laid = convnet._laid_out([convnet.codes(t) for t in texts])
    where, top = convnet.peaks(net, *laid)
    for chunk in (7, 100):
        monkeypatch.setattr(convnet, "CHUNK", chunk)
        again, high = convnet.peaks(net, *laid)
        assert np.allclose(high, top, atol=1e-6) and np.mean(np.array(again) == np.array(where)) > 0.99


def test_equal_scores_of_both_labels_get_no_threshold_between_them():
    assert toxicity._cut(np.array([1.0, 2, 2, 3]), np.array([0, 1, 0, 1]), np.ones(4)) in (1.5, 2.5)


def test_extra_columns_with_clashing_names_pass_through(spark):
    docs, labels = corpus(300)
    rows = spark.createDataFrame([(i, t, 7, "s", 0.25, [1]) for i, t in docs], "doc_id long, text string, y int, code string, score double, toxic array<int>")
    kept = toxicity.accepted(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.schema == rows.schema and 0 < kept.count() < 300
    assert {tuple(r)[2:5] for r in kept.collect()} == {(7, "s", 0.25)}


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = boosting.grown(x, y, trees=20)

    def walk(row):
        out = f.base
        for i in f.roots:
            while f.left[i] != i:
                i = f.left[i] if row[f.feature[i]] <= f.threshold[i] else f.right[i]
            out += f.value[i]
        return out

    assert np.allclose(f.margin(x), [walk(r) for r in x])
    assert ((f.margin(x) > 0) == (y == 1)).mean() > 0.9
