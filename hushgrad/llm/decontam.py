"""Benchmark decontamination by a generalised suffix automaton.

The items' normalised words build one automaton for each block of items of bounded size; blocks are broadcast one after
the other. Tasks stream each text's words through the automaton and track the longest match: a match of at least a
window's length marks words as hit. Runs of hit words can then be removed, and texts that are mostly hit rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_map, dropped, fields, saved, small_batches
from .automaton import Automaton

WINDOW = 10
#: Bytes of item words in one automaton, about, and the words of an item that go together at most. More items make more
#: automata, and the texts pass through them one after the other.
BLOCK_BYTES, PART_WORDS = 1_000_000, 20_000
#: A text with at least this share of hit words goes as a whole.
COVERAGE = 0.5

#: All bytes that separate words become spaces: below "0", between "9" and "a" (after lower-casing), and above "z" in ASCII.
_TO_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")

HITS = fields(("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()))


def normalised(text: str | None) -> bytes:
    """Lower-cased A-Z, separators as spaces; each byte stays in its place."""
    return text.encode().lower().translate(_TO_SPACE) if text else b""


def _blocks(items: DataFrame, window: int) -> Iterator[Automaton]:
    """Automata over blocks of items (item_id, text), each of bounded size, one after the other.

    Items are cut into parts that overlap by all but one word of a window, so every window lies in one part; parts go
    to blocks by a hash, and only one block's parts are on the driver at a time.
    """
    step = PART_WORDS - window + 1

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            names, parts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised(text).split()
                for k in range(0, max(1, len(words) - window + 1), step):
                    if words:
                        names.append(name or "")
                        parts.append(b" ".join(words[k : k + PART_WORDS]))
            return {"item": names, "part": parts}

        return one

    parts = arrow_map(items.select(F.col("item_id").cast("string"), "text"), make, fields(("item", T.StringType()), ("part", T.BinaryType()))).distinct()
    parts = saved(parts, "items")
    n = -(-(parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0) // BLOCK_BYTES)
    for i in range(n):
        rows = parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(n)) == i).orderBy("item", "part").collect()
        if rows:
            yield Automaton([(r.item, bytes(r.part).split(b" ")) for r in rows], window)
    dropped(parts)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _matched(words: list[bytes], block: Automaton | None) -> tuple[list[tuple[int, int]], set[str]]:
    if block is None:
        return [], set()
    spans, found = block.hits(words)
    return spans, {block.items[i] for i in found}


def _waves(rows: DataFrame, blocks: Iterator[Automaton]) -> DataFrame:
    """(row, spans, items) of every row with hits, for rows (row, text): one wave for each block, written to the shared
    folder, so that driver and workers hold one automaton at a time."""
    schema = fields(("row", T.LongType()), ("spans", T.ArrayType(T.IntegerType())), ("items", T.ArrayType(T.StringType())))
    parts = []
    for block in blocks:
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            def one(batch: pa.RecordBatch) -> dict:
                out: dict[str, list] = {"row": [], "spans": [], "items": []}
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    spans, names = _matched(normalised(text).split(), sent.value)
                    if spans:
                        for c, x in zip(out.values(), (row, [x for s in spans for x in s], sorted(names)), strict=True):
                            c.append(x)
                return out

            return one

        parts.append(saved(arrow_map(rows, make, schema), "hits"))
        sent.destroy()
    found = reduce(DataFrame.union, parts)
    return found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _pairs(flat: list[int] | None) -> list[tuple[int, int]]:
    return _merged(list(zip(flat[::2], flat[1::2], strict=True))) if flat else []


def _measure(doc: int, n_words: int, spans: list[tuple[int, int]], names: set[str]) -> tuple:
    n = sum(e - b for b, e in spans)
    return doc, n_words, n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0


def _columns(rows: list[tuple]) -> dict[str, list]:
    return {f.name: [r[i] for r in rows] for i, f in enumerate(HITS)}


def measured(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, hit words and items of each row's whole text.

    Null and empty texts and items have no words; repeated items count by their item_id once; a null item_id counts as
    an empty one; without items nothing is hit. Each repeated document row gives a row; other columns are not read.
    Items and texts may be of any length. One block of items takes one pass over the texts; more blocks pass in waves.
    """
    blocks = _blocks(items, window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def make():
            def one(batch: pa.RecordBatch) -> dict:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = normalised(text).split()
                    out.append(_measure(doc, len(words), *_matched(words, sent.value)))
                return _columns(out)

            return one

        return arrow_map(docs.select("doc_id", "text"), make, HITS)

    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    hits = _waves(rows.select("row", "text"), chain((first, second), blocks))

    def count():
        return lambda batch: {"row": batch.column(0), "doc_id": batch.column(1), "n_words": [len(normalised(t).split()) for t in batch.column(2).to_pylist()]}

    sizes = arrow_map(rows, count, fields(("row", T.LongType()), ("doc_id", T.LongType()), ("n_words", T.LongType())))

    def finish():
        return lambda batch: _columns([_measure(r["doc_id"], r["n_words"], _pairs(r["spans"]), set(r["items"] or ())) for r in batch.to_pylist()])

    return arrow_map(sizes.join(hits, "row", "left").select("doc_id", "n_words", "spans", "items"), finish, HITS)


def _cleaned(text: str, words: list[tuple[int, int]], spans: list[tuple[int, int]], coverage: float) -> str | None:
    """The text without its hit words and what stands between them; None if too much of it is hit."""
    if not spans:
        return text
    if sum(e - b for b, e in spans) >= coverage * len(words):
        return None
    whole, kept, at = text.encode(), [], 0
    for b, e in spans:
        kept.append(whole[at : words[b][0]])
        at = words[e - 1][1]
    return b"".join([*kept, whole[at:]]).decode()


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Rows with hit runs cut out of their texts; rows whose hit words reach the coverage limit are gone.

    All columns stay as they are, whatever they are called, but for text and, where present, n_chars. Null and empty
    texts are kept; repeated rows share their fate; without items, and on an empty table, nothing changes. Items and
    texts may be of any length.
    """
    blocks = _blocks(items, window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _cut(docs, docs.sparkSession.sparkContext.broadcast(first), docs.schema, coverage)
    row, spans = "hushgrad_row", "hushgrad_spans"
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hits = _waves(rows.select(F.col(row).alias("row"), "text"), chain((first, second), blocks))
    joined = rows.join(hits.select(F.col("row").alias(row), F.col("spans").alias(spans)), row, "left")
    return _cut(joined.select(*docs.columns, spans), None, docs.schema, coverage)


def _cut(docs: DataFrame, sent: Broadcast | None, schema: T.StructType, coverage: float) -> DataFrame:
    """docs of a schema, followed by their spans where no automaton is sent."""
    at = schema.names.index("text")
    size = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns
            texts, new = cols[at].to_pylist(), []
            given = cols.pop().to_pylist() if sent is None else [None] * len(texts)
            for x, flat in zip(texts, given, strict=True):
                if not x:
                    new.append(x)
                    continue
                raw = normalised(x)
                words = [m.span() for m in _WORD.finditer(raw)]
                spans = _pairs(flat) if sent is None else _matched([raw[b:e] for b, e in words], sent.value)[0]
                new.append(_cleaned(x, words, spans, coverage))
            types = [batch.schema.field(i) for i in range(len(cols))]
            cols[at] = pa.array(new, types[at].type)
            if size is not None:
                cols[size] = pa.array([n if x == y else len(y) if y is not None else None for n, x, y in zip(cols[size].to_pylist(), texts, new, strict=True)], types[size].type)
            keep = pa.array([y is not None or x is None for x, y in zip(texts, new, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(types)).filter(keep)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
