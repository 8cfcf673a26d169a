import re

from pyspark.sql import functions as F

from tidelog.llm import pii

KINDS = [
    r"[\w.]+@[\w.]+\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<!\d)\d{16}(?!\d)", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d])", r"AKIA[0-9A-Z]{16}", r"(?:password=|token = \")([0-9a-f]+)",
]


def found(text):
    return {m.group(1) if m.groups() else m.group() for p in KINDS for m in re.finditer(p, text or "")}


def test_query_removes_and_keeps(spark, sf, docs):
    """Entities found by plain patterns are gone; documents without any are untouched; the rest of a text stays."""
    new = {r.doc_id: r for r in pii.op9_pii(spark, sf).collect()}
    seen = 0
    for r in docs.collect():
        old = found(r.text)
        if not old and not new[r.doc_id].n_entities:
            assert new[r.doc_id].text == r.text
        for e in old:
            seen += 1
            assert e not in new[r.doc_id].text
        plain = re.sub("|".join(KINDS), "#", r.text or "")
        assert re.sub("|".join(KINDS), "#", re.sub(r"@[a-p]{14}\.example\.com", "@x.com", new[r.doc_id].text or "")) == plain
    assert seen > 10


def test_formats(spark):
    text = "Call +1 (462) 555-7216 or +1 462 555 7216. Bob.84@mail0.example.com, bob.84@MAIL0.example.com; 4111 1111 1111 1111 and 4111111111111111; 10.1.2.3 240.0.0.1 123-45-6789 password=ab12cd"
    new = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    shape = lambda s: re.sub("[0-9]", "9", s)
    a, b = re.findall(r"\+1[ ()\d-]+\d", new)
    assert shape(a) == "+9 (999) 999-9999" and re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "14625557216"
    mails = re.findall(r"\S+@[\w.]+\w", new)
    assert mails[0] == mails[1] and re.fullmatch(r"[a-z]{3}\.\d\d@\w+\.example\.com", mails[0])
    cards = re.findall(r"(?<!\d)4\d{3} ?\d{4} ?\d{4} ?\d{4}", new)
    assert cards[0].replace(" ", "") == cards[1] and shape(cards[0]) == "9999 9999 9999 9999"
    digits = [int(d) for d in cards[1]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    ips = re.findall(r"(?:\d+\.){3}\d+", new)
    assert len(ips) == 2 and ips[1].startswith("240.") and all(0 <= int(o) < 256 for i in ips for o in i.split("."))
    assert re.search(r"password=[0-9a-f]{16}$", new)


def test_names(spark):
    text = "Mr. John Smith met Mrs. Anna Jones, Frau Müller and Госпожа Анна Петрова. Mr. John Smith left."
    new = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+), Frau (\w+) and Госпожа (\w+) (\w+)\. Mr\. (\w+) (\w+) left\.", new)
    assert m and m[1] in pii.GIVEN["male"] and m[3] in pii.GIVEN["female"] and m[6] in pii.GIVEN["female cyrillic"]
    assert (m[1], m[2]) == (m[8], m[9]) and m[2] != m[4] and re.fullmatch("[А-Яа-яё]+", m[7])


def test_permutations_are_one_to_one(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert d.select(pii._digits("k", F.col("d"), F.lit("s")).alias("x")).distinct().count() == 1000
    a = d.select(pii._digits("other", F.col("d"), F.lit("s")).alias("x"), "d").where("x = d").count()
    assert a < 20
    ip = spark.range(0, 3000).select(F.concat(F.lit("9.8."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("m"))
    assert ip.select(pii._ip("k", F.col("m")).alias("x")).distinct().count() == 3000


def test_odd_rows(spark, odd, none):
    got = pii.pseudonymise(odd)
    rows = {(r.doc_id, r.text) for r in got.where("tl_entities = 0").collect()}
    assert rows == {(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()} and got.columns == [*odd.columns, "tl_entities"]
    changed = got.where("tl_entities > 0").collect()
    assert len(changed) == 1 and changed[0].doc_id is None and "555-7216" not in changed[0].text
    assert pii.pseudonymise(none).count() == 0
