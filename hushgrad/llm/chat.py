"""Chat formatting with loss masks aligned by offsets.

A conversation becomes one string: <|im_start|> role <|im_sep|> text <|im_end|> for each turn. Control strings inside
texts are escaped with a backslash that no unescaped text can hold in that place. The string is encoded once with
offsets; the assistant turns' spans and the token spans are both sorted, so each turn finds its tokens by two binary
searches. Turns are streamed in order: conversations of any length pass in pieces cut at turn borders, which are token
borders too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ._shared import fields, small_batches, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters of formatted text that are encoded at once; a longer single turn is encoded as it is.
PIECE = 1 << 20

#: "<", any backslashes, "|": one more backslash hides it, one fewer brings it back.
_OPENS, _HIDDEN = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")

DIGEST = fields(("conv_id", T.LongType()), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))
FORMATTED = fields(("conv_id", T.LongType()), ("piece", T.IntegerType()), ("formatted", T.StringType()), ("ids", T.ArrayType(T.IntegerType())), ("loss_mask", T.ArrayType(T.BooleanType())), ("starts", T.ArrayType(T.IntegerType())), ("ends", T.ArrayType(T.IntegerType())))


def escaped(text: str) -> str:
    return _OPENS.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _HIDDEN.sub(r"<\1|", text)


@lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.add_special_tokens([START, SEP, END])
    return t


@dataclass
class Piece:
    """Formatted turns with their tokens: which tokens are under the loss, and where each begins and ends."""

    formatted: str
    ids: list[int]
    mask: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def rendered(turns: list[tuple[str, str]], tokenizer: Tokenizer) -> Piece:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    formatted = "".join(parts)
    e = tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
    mask = np.zeros(len(offsets), bool)
    for b, x in spans:
        first = np.searchsorted(offsets[:, 1], b, side="right")
        last = np.searchsorted(offsets[:, 0], x, side="left")
        mask[first:last] = True
    return Piece(formatted, e.ids, mask, offsets[:, 0], offsets[:, 1])


def under_loss(p: Piece) -> Iterator[str]:
    """What the mask covers, read back from the formatted text: each unbroken run of masked tokens, unescaped."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], p.mask.view(np.int8), [0]))))
    for b, e in zip(edge[::2], edge[1::2], strict=True):
        yield unescaped(p.formatted[p.starts[b] : p.ends[e - 1]])


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts, read back."""
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition(SEP)
        yield unescaped(role), unescaped(text)


#: Before the first conversation; None is the one of rows without conv_id.
_NONE = object()


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer, most: int) -> Iterator[tuple[int, int, Piece]]:
    """Pieces of sorted turns, each of one conversation."""
    now, k, turns, size = _NONE, 0, [], 0
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns and (conv != now or size >= most):
                yield now, k, rendered(turns, tokenizer)
                k, turns, size = k + 1, [], 0
            if conv != now:
                now, k = conv, 0
            turns.append((role or "", text or ""))
            size += len(text or "") + 40
    if turns:
        yield now, k, rendered(turns, tokenizer)


def _sorted(conversations: DataFrame) -> DataFrame:
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of formatted conversations with token ids, offsets and loss mask, in order of turns.

    A conversation of up to PIECE characters is one piece, rendered whole and encoded once. A longer one comes in pieces
    cut between turns: control strings stand there, at which the encoding parts anyway, so ids and masks are those of
    the whole. Nulls, repeats, empty tables and other columns are as for digests().
    """
    path, most = tokenizer_path(vocabulary), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, k, p in _pieces(batches, chat_tokenizer(path), most):
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([k], pa.int32()), pa.array([p.formatted]), pa.array([p.ids], pa.list_(pa.int32())), pa.array([p.mask.tolist()], pa.list_(pa.bool_())), pa.array([p.starts.tolist()], pa.list_(pa.int32())), pa.array([p.ends.tolist()], pa.list_(pa.int32()))], names=FORMATTED.names,
            )

    return _sorted(conversations).mapInArrow(run, FORMATTED)


@dataclass
class _Digest:
    turns: int = 0
    loss: int = 0
    chars: int = 0
    of_turns: object = field(default_factory=hashlib.sha256)
    of_loss: object = field(default_factory=hashlib.sha256)


def digests(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What reading back gives for each conversation: turns, text under the loss, size of the formatted text.

    Null roles and texts count as empty; rows without conv_id are one conversation of their own; turns of equal number
    follow by role and text, those without number come first; repeated rows are turns each. An empty table gives no
    rows. Other columns are not read. The turns of one conversation are digested in order by one task, in pieces of
    bounded size, since a digest has an order.
    """
    path, most = tokenizer_path(vocabulary), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, d = _NONE, _Digest()

        def close():
            if now is not _NONE:
                rows.append((now, d.turns, d.of_turns.hexdigest(), d.loss, d.of_loss.hexdigest(), d.chars))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=DIGEST.names)
            rows.clear()
            return out

        for conv, _, p in _pieces(batches, chat_tokenizer(path), most):
            if conv != now:
                close()
                now, d = conv, _Digest()
            d.chars += len(p.formatted)
            for role, text in turns_of(p.formatted):
                d.turns += 1
                d.of_turns.update(f"{role}\n{text}\n".encode())
            for text in under_loss(p):
                d.loss += len(text)
                d.of_loss.update(text.encode())
            if len(rows) >= 1000:
                yield batch()
        close()
        if rows:
            yield batch()

    return _sorted(conversations).mapInArrow(run, DIGEST)
