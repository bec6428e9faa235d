"""The pipeline against a brute-force version, stage by stage, and its handling of odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm.packing import word_bpe
from cairn.plans.durable import durable
from tests.llm.conftest import DOCUMENT, words
from tests.llm.test_documents import clean, covered, near, split


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, data), "test")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.schema.simpleString() == stages[0].schema.simpleString()
        assert all(r.n_chars == len(r.text) for r in s.collect())


def test_quality(stages):
    want = {i: t for i, (kept, t) in ((i, clean(t)) for i, t in rows(stages[0]).items()) if kept}
    assert rows(stages[1]) == want and 0 < len(want) < stages[0].count()


def test_near_copies(stages):
    before = rows(stages[1])
    top, _ = near(before.items(), 5)
    assert rows(stages[2]) == {i: t for i, t in before.items() if top[i] == i}


def test_passages(stages):
    before = rows(stages[2])
    want = {i: kept.decode().split() for i, _, _, kept in covered(before.items())}
    after = rows(stages[3])
    assert {i: [w.decode() for w in split(t)] for i, t in after.items()} == want
    assert any(before[i] != after[i] for i in before)


def test_packing(stages):
    from tokenizers import Tokenizer

    t, before = Tokenizer.from_file(word_bpe()), rows(stages[3])
    got = stages[4].collect()
    assert {r.doc_id for r in got} == set(before)
    for r in got:
        ids = [*t.encode(before[r.doc_id], add_special_tokens=False).ids, 2]
        part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part)


def test_run(spark, data, stages):
    """All of it, against brute force from the documents to the ids of every piece."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    docs = {i: x for i, (kept, x) in ((i, clean(x)) for i, x in rows(stages[0]).items()) if kept}
    top, _ = near(docs.items(), 5)
    docs = {i: x for i, x in docs.items() if top[i] == i}
    kept = {i: x.decode().split() for i, _, _, x in covered(docs.items())}
    pieces = {}
    for r in corpus_pipeline.run(spark, data).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert set(pieces) == set(docs)
    for i, parts in pieces.items():
        ids = [x for _, part in sorted(parts) for x in part]
        assert ids[-1] == 2 and t.decode(ids[:-1]).split() == t.decode(t.encode(" ".join(kept[i]), add_special_tokens=False).ids).split()


def test_odd_rows(spark, odd, none):
    # Parquet has no columns that differ only in case.
    wide = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["a.b", "_id", "_text", "kept", "clean_text", "n_words", "ranges", "_key", "text_key"])])
    for docs in (odd, wide):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = durable(stage(spark, docs, ""), "test")
            assert after.columns == docs.columns
            assert after.count() <= docs.count()
    kept = corpus_pipeline.one_of_each_group(spark, odd, "").collect()
    assert sum(r.doc_id == 2 for r in kept) == 0 and sum(r.doc_id == 1 for r in kept) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_one_of_tied_and_null_ids(spark):
    """Near copies that share the least id, or have none, leave one document a group."""
    texts = {x: [words(80, x) + f" {end}" for end in ("one", "two", "three")] for x in "abc"}
    rows = [*[(1, t) for t in texts["a"][:2]], (2, texts["a"][2]), *[(None, t) for t in texts["b"]], (None, texts["c"][0]), (9, texts["c"][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENT)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert len(kept) == 3
    assert Counter(r.doc_id for r in kept) == {1: 1, None: 1, 9: 1}
    assert {x for r in kept for x in "abc" if r.text in texts[x]} == set("abc")
