"""The pipeline's rows against the stages' rules, applied one by one in plain Python."""

import random
import zlib
from array import array
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from hushgrad.llm import packing
from hushgrad.llm._shared import tokenizer_path

ITEM = "one two three four five six seven eight nine ten eleven"
BAD = ["grumf", "grumfol", "zzark"]


def tables(folder, spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("balo cema dine foti gusa lare mone piru".split()) + rng.choice(["lo", "ma", "ne", "ti", "sa"]) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        t = text(rng.randint(20, 60))
        if i % 4 == 0:
            t = f"{t} {rng.choice(BAD)} {text(5)} {rng.choice(BAD)} {rng.choice(BAD)}"
        docs.append((i, t))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000, docs[1][1]), (1001, docs[1][1].upper()), (1002, f"{text(30)} {ITEM} {text(5)}"), (1003, ITEM), (1004, f"{text(12)} joe@example.com {text(3)} 4111111111111111"), (1005, None), (1006, ""), (1007, text(3000))]
    spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs)


def test_pipeline_equals_its_rules(spark, tmp_path):
    docs = tables(tmp_path, spark)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    want = {d: t for d, t in docs.items() if not any(b in (t or "").split() for b in BAD)}
    for d in (1000, 1001, 1003):  # copies, and a text that is all benchmark
        del want[d]
    want[1002] = want[1002].replace(ITEM, "")
    want[1004] = want[1004].replace("joe@example.com", "[EMAIL]").replace("4111111111111111", "[CARD]")
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(want)
    for d, ps in by.items():
        whole = [*ids.encode(want[d] or "", add_special_tokens=False).ids, 0]
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(array("I", whole[p.start : p.start + p.length]).tobytes()), d
        assert sum(p.length for p in ps) == len(whole)


def test_stage_names_and_columns(spark, tmp_path):
    tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    tables(tmp_path / "a", spark)
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    (tmp_path / "b").mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").write.parquet(f"{tmp_path}/b/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    extra = docs.where("doc_id % 40 < 2").withColumnsRenamed({"lang": "node", "source": "spans"}).selectExpr("*", "1 as score", "2 as component_id", "'k' as text_key", "3 as y", "4 as row")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, extra, f"{tmp_path}/a")
        assert out.columns == extra.columns and 0 < out.count() <= extra.count()
        assert {(r.score, r.component_id, r.text_key, r.y, r.row) for r in out.collect()} == {(1, 2, "k", 3, 4)}
