import pytest

from tidelog.llm import license as lic


@pytest.fixture(scope="module")
def model(docs):
    return lic.train(lic.corpus_words(docs))


def test_notices_and_talk(spark, model):
    rows = [(i, t) for i, t in enumerate(t for ts in lic.TEMPLATES.values() for t in ts)]
    want = [f for f, ts in lic.TEMPLATES.items() for _ in ts]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].family == f and got[i].confirmed for i, f in enumerate(want))
    talk = spark.createDataFrame([(i, t) for i, t in enumerate([*lic.TALK, "my driving license expired", "the copyright office is closed today", "permission to land"])], "doc_id long, text string")
    assert lic.scan(talk, model).where("confirmed").count() == 0


def test_native_scores_are_the_models(spark, model):
    text = "Part of this text was Released under the MIT License. see below"
    got = lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    p = model.probabilities(lic._words(text))
    assert got.family == model.families[p.argmax()] == "MIT" and abs(got.probability - p.max()) < 1e-9


def test_query_finds_every_notice(spark, sf, docs):
    """Lines of the documents that name a licence in words, found by hand-written patterns."""
    import re

    found = {(r.doc_id, r.paragraph) for r in lic.op5_license(spark, sf).collect() if r.confirmed}
    named = re.compile(r"^(Released under the MIT License|This work is licensed under the GNU|Licensed under CC BY|Licensed under the Apache)")
    want = {(r.doc_id, i) for r in docs.collect() for i, line in enumerate((r.text or "").split("\n")) if named.search(line)}
    assert want and want <= found


def test_odd_rows(spark, model, odd, none):
    assert lic.scan(odd, model).count() == 0 and lic.scan(none, model).count() == 0
    twice = spark.createDataFrame([(1, "x\nReleased under the MIT License.\n\nReleased under the MIT License.", 0.5)] * 2 + [(None, "Released under the MIT License.", 0.1)], "doc_id long, text string, probability double")
    assert sorted((r.doc_id or 0, r.paragraph) for r in lic.scan(twice, model).collect()) == [(0, 0), (1, 1), (1, 1), (1, 3), (1, 3)]
