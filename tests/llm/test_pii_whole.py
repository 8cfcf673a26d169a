import re

from tidelog.llm import pii


def _new(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(d).orderBy("doc_id").collect()]


def test_secrets_of_any_length(spark):
    """No end of a long secret stays, and secrets that differ late are two."""
    a, b = "aB3" * 100 + "tail1", "aB3" * 100 + "tail2"
    x, y, z = _new(spark, f"token={a} end", f"token={b} end", f"password: '{a}'")
    assert re.fullmatch(r"token=[a-zA-Z0-9]{305} end", x) and "tail" not in x + y + z
    assert x != y and z == f"password: '{x[6:-4]}'"


def test_separators_inside_secrets(spark):
    texts = ["password=ab:cdef,gh1 end", 'token = "x,y=z:1234", next', "secret: hunter22, next", 'pwd="correct horse battery" end', "token::parse_value == 1", "password=пароль-секрет end"]
    new = _new(spark, *texts)
    assert not re.search("cdef|gh1|1234|hunter|horse|battery|пароль|секрет", " ".join(new))
    assert new[0].endswith(" end") and new[1].endswith('", next') and new[2].endswith(", next") and new[3].endswith('" end') and new[4] == texts[4]


def test_cards_of_the_2_series(spark):
    new = _new(spark, "2221000000000009 and 2221 0000 0000 0009, 2720990000000007; 2220000000000000 and 2721000000000000 are none")[0]
    a, b, c = re.match(r"(\d{16}) and (\d{4} \d{4} \d{4} \d{4}), (\d{16}); 2220000000000000 and 2721000000000000 are none$", new).groups()
    assert a == b.replace(" ", "") != "2221000000000009" and c not in (a, "2720990000000007")
    for n in (a, c):
        d = [int(x) for x in n][::-1]
        assert 2221 <= int(n[:4]) <= 2720 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
