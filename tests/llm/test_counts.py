import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushgrad.llm import counts, tokens
from hushgrad.llm._shared import tokenizer_path

TEXTS = ["The Quick brown fox's.", "", None, "a\x1cb \x85 c\xa0d em sp", "ΣΑΣ ΟΔΟΣ É É", "<|endoftext|> mid<|startoftext|>dle", "x" * 3000, "1234 5!? 漢字 😀", " \n\t ", "word, " * 3000, "The Quick brown fox's.", "￿ ​zero‍joined"]


@pytest.mark.parametrize("frequent", [None, {}, {"The": 1, "word,": 2}])
def test_counts_equal_the_librarys(spark, monkeypatch, frequent):
    if frequent is not None:
        monkeypatch.setattr(counts, "frequent_words", lambda vocabulary: frequent)
    docs = spark.createDataFrame([(i, x, 9) for i, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    t = Tokenizer.from_file(tokenizer_path(counts.VOCABULARY))
    got = {r.doc_id: r for r in counts.counted(docs).collect()}
    for i, x in enumerate(TEXTS):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 2048), x


def test_empty_table(spark):
    assert counts.counted(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_reading_without_a_shuffle(spark, capsys):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    counts.counted(docs).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_the_frequent_words_have_the_librarys_counts():
    t = Tokenizer.from_file(tokenizer_path(counts.VOCABULARY))
    found = counts.frequent_words()
    assert 10_000 < len(found) <= t.get_vocab_size()
    assert all(n == len(t.encode(w, add_special_tokens=False).ids) for w, n in sorted(found.items())[::37])


_OWN = tokens.WordCounts(tokenizer_path(counts.VOCABULARY))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(min_size=1, max_size=8), st.sampled_from(["\x01", "a\x01b", "Σας", "ΟΔΟΣ", "\u0301x", "İ", "'s", "<|endoftext|>"])), max_size=12))
def test_words_learnt_together_count_as_alone(texts):
    words = {w for x in texts for w in tokens.words_of(x)}
    own = _OWN
    own.clear()
    own.learn(words)
    assert all(own[w] == len(own.whole.encode(w, add_special_tokens=False).ids) for w in words)
