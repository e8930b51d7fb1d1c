"""Token counts of whole texts by two tiers of known word lengths: one reading of the texts, and no shuffle at all.

The vocabulary drops white space, so a text's count is the sum over its words. The words that the vocabulary itself
holds whole are the frequent ones of what it was made from; their token counts are broadcast as one compact table,
whose size the vocabulary bounds. Each word is looked up there and then in the worker's own bounded cache; what
neither knows is encoded in one call for a batch of rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import arrow_map, fields, shipped, tokenizer_path
from .tokens import CACHE_CHARS, word_counts, words_of

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
COUNTS = fields(("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))


def frequent_words(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Whole words of the vocabulary and their token counts; at most as many as the vocabulary has entries."""
    known = word_counts(tokenizer_path(vocabulary))
    words = [w for w in known.whole_words() if len(w) <= CACHE_CHARS]
    known.learn(set(words))
    return {w: known[w] for w in words}


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of each row's whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row, an empty table none; other columns
    are not read. Special strings inside texts count as the library counts them. A very long text is handled as a
    whole in one task.
    """
    path = tokenizer_path(vocabulary)
    shipped(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_words(vocabulary))

    def make():
        own, frequent = word_counts(path), sent.value

        def one(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            words = [words_of(x) if x else [] for x in texts]
            n = []
            for ws in words:
                first = [frequent.get(w) for w in ws]
                new = {w for w, k in zip(ws, first, strict=True) if k is None and w not in own}
                if new:
                    own.learn(new)
                n.append(sum(own[w] if k is None else k for w, k in zip(ws, first, strict=True)))
            size = pa.array([len(x.encode()) if x else 0 for x in texts], pa.int64())
            return {"doc_id": batch.column(0), "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]}

        return one

    return arrow_map(docs.select("doc_id", "text"), make, COUNTS)
