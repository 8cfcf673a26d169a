import re

import pytest

from tidelog.llm import license as lic


@pytest.fixture(scope="module")
def words(docs):
    return lic.corpus_words(docs)


@pytest.fixture(scope="module")
def model(words):
    return lic.train(words)


def _scan(spark, model, *texts):
    return lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).where("confirmed").collect()


def test_notices_without_the_usual_words(spark, model):
    texts = {"Text available under CC-BY-SA 4.0.": "CC-BY-SA", "Released under Apache 2.0": "Apache-2.0", "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA"}
    got = {r.text: r.family for r in _scan(spark, model, *texts)}
    assert got == {t: f for t, f in texts.items() if model.families[model.probabilities(lic._words(t)).argmax()] == f} and len(got) > 1


def test_wrapped_notices(spark, model):
    """One row for a notice, whatever its lines, and none over a blank line."""
    bsd = lic.TEMPLATES["BSD"][0]
    a = bsd[: bsd.index("modification")].strip() + "\n" + bsd[bsd.index("modification") :]
    got = [(r.doc_id, r.paragraph, r.family, r.similarity) for r in _scan(spark, model, f"First\n\n{a}\n\nlast", bsd.replace(" ", "\n"), a.replace("\n", "\n\n"))]
    assert sorted(got) == [(0, 2, "BSD", 1.0), (1, 0, "BSD", 1.0)]


def test_anchors_lose_nothing(model, words, docs):
    """No line without an anchor is predicted to be of a family."""
    pattern = re.compile(lic._any(lic.anchors(model, words)))
    rest = {t for r in docs.collect() for t in (r.text or "").split("\n") if not pattern.search(t.lower())}
    for t in (t for ts in lic.TEMPLATES.values() for t in ts):
        kept = ""  # words of a notice as long as they make no anchor
        for w in lic._words(t):
            if not pattern.search(f"{kept} {w}"):
                kept = f"{kept} {w}".strip()
        rest.add(kept)
    assert len(rest) > 100 and all(model.families[model.probabilities(lic._words(t)).argmax()] == lic.UNKNOWN for t in rest)


def test_query_against_the_model_on_every_line(spark, sf, docs, words, model):
    """Every line of every document scored in Python: the same lines, families, probabilities and similarities."""
    def similarity(text, family):
        found = set(lic.grams(lic._words(text)))
        return max(len(found & set(p)) / len(p) for p in map(lic._pairs, lic.TEMPLATES[family]))

    want = {}
    for r in docs.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            p = model.probabilities(lic._words(line))
            family = model.families[p.argmax()]
            if family != lic.UNKNOWN and p.max() >= lic.MIN_PROBABILITY:
                want[r.doc_id, i] = (family, p.max(), similarity(line, family))
    got = {(r.doc_id, r.paragraph): (r.family, r.probability, r.similarity, r.confirmed) for r in lic.op5_license(spark, sf).collect() if "\n" not in r.text}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[k][0] == f and abs(got[k][1] - p) < 1e-9 and abs(got[k][2] - s) < 1e-12 and got[k][3] == (s >= lic.CONTAINED) for k, (f, p, s) in want.items())


def test_clean_lines_stay_clean(docs, model):
    """Lines without a notice's rare words are never confirmed: precision over the whole table."""
    pattern = re.compile(r"licen|copyright|rights reserved|redistribut|permission|public domain|unencumbered|spdx|creative commons|governed by", re.I)
    lines = {t for r in docs.collect() for t in (r.text or "").split("\n") if t and not pattern.search(t)}
    assert len(lines) > 100
    for t in lines:
        p = model.probabilities(lic._words(t))
        if model.families[p.argmax()] != lic.UNKNOWN and p.max() >= lic.MIN_PROBABILITY:
            found = set(lic.grams(lic._words(t)))
            assert max(len(found & set(q)) / len(q) for q in map(lic._pairs, lic.TEMPLATES[model.families[p.argmax()]])) < lic.CONTAINED
