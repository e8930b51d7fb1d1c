import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from hushgrad.llm import chat
from hushgrad.llm._shared import tokenizer_path

TEXT = st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["<", "|", "\\", ">", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|endoftext|>", "<\\|", "\n", " ", "é", "漢", "😀", "assistant"]), max_size=12).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>"]), TEXT), min_size=1, max_size=6))
def test_round_trip(turns):
    p = chat.rendered(turns, chat.chat_tokenizer(tokenizer_path(chat.VOCABULARY)))
    assert list(chat.turns_of(p.formatted)) == turns
    assert list(chat.under_loss(p)) == [x for r, x in turns if r == "assistant" and x]
    assert p.formatted.count(chat.END) == len(turns)


def test_digests(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> b"), (1, 2, "assistant", None), (1, 3, "assistant", "ñ\n"), (2, 0, None, ""), (2, 0, None, ""), (3, 1, "assistant", "x" * 5000), (3, 0, "system", "<\\|"), (None, 0, "user", "gone")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i} ") for i in range(3000)]
    for size in (1 << 20, 100):
        monkeypatch.setattr(chat, "PIECE", size)
        made = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(6)
        got = {r.conv_id: r for r in chat.digests(made).collect()}
        assert set(got) == {1, 2, 3, 4, None}
        for c, r in got.items():
            turns = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))
            said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
            loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
            assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert chat.formatted(made).where("conv_id = 1").select("formatted").first()[0].startswith("<|im_start|>user<|im_sep|>hi<|im_end|>")
    assert chat.digests(made.limit(0)).count() == 0


def test_pieces_have_the_ids_and_masks_of_the_whole(spark, monkeypatch):
    turns = [("user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(["hi", " lead", "", "<|im_end|> x", "trail ", "é 漢 \n\n", "\\", "it's", "word " * 50, "a  b\t"] * 4)]
    whole = chat.rendered(turns, chat.chat_tokenizer(tokenizer_path(chat.VOCABULARY)))
    made = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string").repartition(3)
    for size in (1 << 20, 300, 1):
        monkeypatch.setattr(chat, "PIECE", size)
        parts = chat.formatted(made).orderBy("piece").collect()
        assert (len(parts) == 1) == (size == 1 << 20)
        assert "".join(p.formatted for p in parts) == whole.formatted
        assert [x for p in parts for x in p.ids] == whole.ids
        assert [x for p in parts for x in p.loss_mask] == whole.mask.tolist()
        at, starts = 0, []
        for p in parts:
            starts += [at + x for x in p.starts]
            at += len(p.formatted)
        assert starts == whole.starts.tolist()


def test_the_conversation_of_control_strings(spark):
    from hushgrad.llm import queries

    made = spark.createDataFrame([(-1, 0, "user", queries.HOSTILE), (-1, 1, "assistant", queries.HOSTILE)], "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(made).collect()
    said = f"user\n{queries.HOSTILE}\nassistant\n{queries.HOSTILE}\n"
    assert (r.n_turns, r.turns_sha256) == (2, hashlib.sha256(said.encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(queries.HOSTILE), hashlib.sha256(queries.HOSTILE.encode()).hexdigest())
