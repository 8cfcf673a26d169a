"""The pipeline against plain Python for each stage's decisions, on the smallest documents."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, docs, tmp_path):
    from tokenizers import Tokenizer

    from tidelog.llm import bpe, langid, mixing, pii, simhash

    now, kept = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        kept[name] = (now, spark.read.parquet(str(tmp_path / name)))
        now = kept[name][1]
    before, after = kept["language"]
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(before, langid.train(before)).collect()}
    assert {r.doc_id: r.lang for r in after.collect()} == {i: k for i, (k, s) in told.items() if k != "und" and s >= langid.MIN_SCORE}
    before, after = kept["near_dedup"]
    want = {r.component_id for r in simhash.simhash(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = kept["private_data"]
    clean = {r.doc_id: r.text for r in pii.pseudonymise(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == clean and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["mix"]
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in now.collect()}
    rows = pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert len(rows) == now.count()
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, dtype="<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    ran = pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, rows))


def test_wrong_label_is_mended(spark, docs):
    french = docs.where("lang = 'fr' and length(text) > 500").first()
    x = docs.where(f"doc_id <> {french.doc_id}").unionByName(docs.where(f"doc_id = {french.doc_id}").withColumn("lang", F.lit("en")))
    got = pipeline.language(spark, x, "").where(f"doc_id = {french.doc_id}").first()
    assert got.lang == "fr" and got.text == french.text


def test_odd_rows(spark, odd):
    now, kept = odd.drop("size", "component_id"), {}
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, "")
        kept[name] = sorted((r.doc_id or 0) for r in now.collect())
        if name != "tokens":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "private_data":
            changed = now.where("doc_id is null").first()
            assert "555-7216" not in changed.text and changed.n_chars == len(changed.text) and now.where("doc_id = 5").first().n_chars == 55 * 4000
    assert kept["language"] == [0, 1, 4, 4, 5]  # no text, and texts without a letter, are gone
    assert kept["near_dedup"] == kept["private_data"] == [0, 1, 5]
    assert kept["mix"] == kept["tokens"] == [0, 0, 0, 1, 1, 1]  # 5 is longer than what is left of the budget


def test_empty_table(spark, none):
    now = none.drop("size", "component_id")
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0
    assert now.columns[:2] == ["doc_id", "n_tokens"]


def test_nothing_to_learn_from(spark):
    x = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "12", None, "a", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.doc_id, r.lang) for r in pipeline.language(spark, x, "").collect()] == [(1, None)]
