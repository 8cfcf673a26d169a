"""Operator 9: private data replaced by keyed surrogates of the same type and format. DataFrame functions only.

Kinds: private key blocks, secrets after a name such as password or token, JSON web tokens, access keys, e-mail addresses, IBANs (only with
right check digits), payment cards, phone numbers, social security numbers, MAC addresses, IPv6 and IPv4 addresses, and person names after
a title. A detected entity is reduced to a canonical form (case and separators dropped, addresses written out), and its surrogate depends on the key,
the kind and that form alone, so all mentions of an entity get the same surrogate, in whatever format each of them is written (coreference).
A token or access key that stands behind a name is the same entity as one that stands alone.

Numbers go through a keyed Feistel network over their digits, a permutation, so two numbers rarely meet: phones keep their
country code, cards their first digit (those of the 2-series its range 2221 to 2720) and whether the check digit is right, IPv4 addresses stay in the
range of their first octet, MAC addresses keep their first octet. IPv6 addresses keep their first group and their zero groups. Other kinds get
characters of the same classes from a keyed hash; IBANs keep the country and get right check digits; surrogates too short to be distinct are
lengthened (an address gets a domain of its own, a secret at least 16 characters). Names keep their title and number of words; given names agree with
the gender of the title and, as surnames do, with the script. A secret that is one symbol repeated is a mask and no secret.

Collision check: the distinct entities of all documents and their surrogates are compared. An entity whose surrogate is a real entity, or is taken by an
entity of a smaller canonical form, gets the surrogate of its next attempt, and only such entities are tried again. So one surrogate never
stands for two entities, nor, while the range of the kind has room (the first AVOID attempts), for an entity that occurs. What is known of
each such entity is its attempt, joined to the texts that hold one; without any, the texts are never shuffled.

Defined results: null text stays null with no entities; documents without entities come back byte for byte; repeated rows give repeated
rows; ties between kinds go to the earlier one in the list above; texts of any length are read whole; a null doc_id, and any other column, passes as it
is; a column that has the name of the count is replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

KEY = "tidelog"
ROUNDS = 6
#: Attempts that avoid all real entities, and attempts in all.
AVOID, ATTEMPTS = 16, 48

# Titles by gender and script.
MALE = ("Mr", "Herr", "Señor", "Monsieur")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame")
MALE_CYRILLIC = ("Господин",)
FEMALE_CYRILLIC = ("Госпожа",)

# Surrogate given names by gender and script, and syllables of surnames.
GIVEN = {
    "male": ["Adam", "Bruno", "Conrad", "David", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nico", "Oscar", "Paul"],
    "female": ["Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"],
    "male cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    "female cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Тамара"],
}
SYLLABLES = ["ba", "do", "fe", "ga", "ki", "lo", "me", "na", "po", "ra", "si", "ta", "ve", "wi", "zu", "len"]
SYLLABLES_CYRILLIC = ["ба", "до", "фе", "га", "ки", "ло", "ме", "на", "по", "ра", "си", "та", "ве", "ви", "зу", "лен"]
NAME_SYLLABLES = 10

_TITLES = "|".join(sorted(MALE + FEMALE + MALE_CYRILLIC + FEMALE_CYRILLIC, key=len, reverse=True))
_HEX = "[0-9A-Fa-f]"
PATTERNS = {
    # a closed block, or lines of base64 behind an opening one
    "private_key": r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----(?:[\s\S]{1,40000}?-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----|(?:\s{1,4}[A-Za-z0-9+/=]{16,128}(?![A-Za-z0-9+/=]))++)",
    # up to the closing quote of the line, or else up to white space, a quote, or separators before them
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}(?![\"']?(?<mask>[^\sA-Za-z0-9\"'])\k<mask>*+[\"',;:]*(?:\s|$))(?:\"[^\"\r\n]{6,}(?=\"|$)|'[^'\r\n]{6,}(?='|$)|[\"']?(?![=:])[^\s\"']{5,}[^\s\"',;:])",
    "jwt": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])(?:[3-6][0-9]{3}(?:[0-9]{9,15}|(?:[ -][0-9]{4}){3}|[ -][0-9]{6}[ -][0-9]{5})|(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)(?:[0-9]{12}|(?:[ -][0-9]{4}){3}))(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "mac": rf"(?<![A-Za-z0-9:.-])(?:(?:{_HEX}{{2}}:){{5}}|(?:{_HEX}{{2}}-){{5}}){_HEX}{{2}}(?![A-Za-z0-9:-])",
    # written out, or short with three groups and a digit at least
    "ipv6": rf"(?<![A-Za-z0-9:.])(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?=[A-Fa-f:]{{0,30}}[0-9])(?=(?:{_HEX}{{1,4}}::?){{2}}{_HEX})(?!(?:{_HEX}{{1,4}}::?){{7}}){_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,5}}::{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,5}})(?![A-Za-z0-9:])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'’-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’-]{{1,40}}){{0,2}}",
}
PATTERN = "|".join(PATTERNS.values())
#: What any match holds; most documents hold none of it.
HINT = rf"[0-9@=:]|eyJ|PRIVATE KEY|(?:{_TITLES})"
# Country calling codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _kind(m: Column) -> Column:
    """The kind of a match, told by its own form; each pattern is tried as a whole in order. Null if it is none after all (an IBAN's check digits)."""
    whole = None
    for kind, p in PATTERNS.items():
        test = m.rlike(rf"^(?:{p})$")
        if kind == "iban":
            test = test & (_mod97(F.regexp_replace(m, " ", "")) == 1)
        whole = F.when(test, F.lit(kind)) if whole is None else whole.when(test, F.lit(kind))
    return whole


def _core(kind: Column, m: Column) -> Column:
    """The part of a match that is replaced, and in a key block the closing line."""
    return (
        F.when(kind == "private_key", F.regexp_extract(m, r"(?s)^-----[A-Z0-9 ]+-----(.*)$", 1))
        .when(kind == "secret", F.regexp_extract(m, r"(?s)^[A-Za-z_-]+[\"']?[ \t]*[=:][ \t]*[\"']?(.*)$", 1))
        .when(kind == "name", F.regexp_extract(m, rf"^(?:{_TITLES})\.? (.*)$", 1))
        .otherwise(m)
    )


def _own_kind(kind: Column, core: Column) -> Column:
    """The kind of a secret that has one of its own."""
    named = lambda k: (kind == "secret") & core.rlike(rf"^(?:{PATTERNS[k]})$")
    return F.when(named("jwt"), "jwt").when(named("access_key"), "access_key").otherwise(kind)


def _canonical(kind: Column, core: Column) -> Column:
    return (
        F.when(kind == "phone", F.regexp_replace(core, r"\(0\)|[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(core, "[^0-9]", ""))
        .when(kind.isin("email", "name"), F.lower(core))
        .when(kind == "mac", F.lower(F.regexp_replace(core, "[:-]", "")))
        .when(kind == "iban", F.regexp_replace(core, " ", ""))
        .when(kind == "private_key", F.regexp_replace(F.regexp_replace(core, r"-----END [A-Z0-9 ]*-----$", ""), r"\s", ""))
        .when(kind == "ipv6", F.array_join(F.transform(_groups(core), lambda g: F.lower(F.lpad(g, 4, "0"))), ":"))
        .otherwise(core)
    )


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, short or written out."""
    sides = F.transform(F.split(address, "::"), lambda side: F.split(side, ":"))
    short = F.concat(sides[0], F.transform(F.sequence(F.size(sides[0]) + F.size(F.get(sides, 1)), F.lit(7)), lambda i: F.lit("0")), F.get(sides, 1))
    return F.when(address.contains("::"), short).otherwise(F.split(address, ":"))


def _mod97(code: Column) -> Column:
    """The remainder by 97 of an IBAN read as a number, 1 if its check digits are right."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    digits = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.conv(c, 36, 10).cast("int"), F.lit(97)).cast("int"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str | Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _feistel(key: str | Column, left: Column, right: Column, wide: Column, high: Column, salt: Column) -> Column:
    """(left < wide, right < high) permuted under the key: a struct of l and r, of the same ranges."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), wide.cast("long").alias("w"), high.cast("long").alias("h"))

    def step(a: Column, i: Column) -> Column:
        f = _number(F.substring(_hash(key, salt, i.cast("string"), a["r"].cast("string")), 1, 15))
        return F.struct(a["r"].alias("l"), F.pmod(a["l"] + f, a["w"]).alias("r"), a["h"].alias("w"), a["w"].alias("h"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)  # an even number of rounds: sides are back in place


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), (n + 1).cast("int"))


def _digits(key: str | Column, digits: Column, salt: Column) -> Column:
    """A string of up to 36 digits permuted among those of its length; one digit stays."""
    n = F.length(digits)
    a = F.floor(n / 2)
    left, right = F.substring(digits, F.lit(1), a.cast("int")), F.substring(digits, (a + 1).cast("int"), F.lit(20))
    x = _feistel(key, left, right, _power(a), _power(n - a), F.concat_ws(":", salt, n.cast("string")))
    return F.when(n < 2, digits).otherwise(F.concat(F.lpad(x["l"].cast("string"), a.cast("int"), "0"), F.lpad(x["r"].cast("string"), (n - a).cast("int"), "0")))


def _fill(shape: Column, digits: Column, places: str = "[0-9]") -> Column:
    """The shape with its digits, or the characters that `places` names, replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike(places)
        return F.struct(F.concat(a["s"], F.when(digit, F.substring(digits, a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step)["s"]


SYMBOLS = "!#$%&*+-.?@^_~"


def _characters(text: Column, stream: Column, symbols: Column | None = None) -> Column:
    """Characters of the same classes, drawn from the stream of hex digits, two for each; hex strings with a letter stay hex. Where `symbols`, those are drawn too."""
    hexes = text.rlike("^(?=[0-9]*[a-f])[0-9a-f]+$")

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        # the stream repeats after 64 digits: later characters also depend on their place
        x = _number(F.substring(stream, F.pmod(2 * (i - 1), F.lit(60)) + 1, F.lit(4))) + F.floor((i - 1) / 30) * 7919
        letters = lambda a, n: F.substring(F.lit(a), (F.pmod(x, F.lit(n)) + 1).cast("int"), F.lit(1))
        out = F.when(hexes, letters("0123456789abcdef", 16)).when(c.rlike("[0-9]"), letters("0123456789", 10)).when(c.rlike("[a-z]"), letters("abcdefghijklmnopqrstuvwxyz", 26)).when(c.rlike("[A-Z]"), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26)).when(c.rlike(r"[^\x00-\x7f]"), letters("abcdefghijklmnopqrstuvwxyz", 26))
        return (out if symbols is None else out.when(symbols & (c != " "), letters(SYMBOLS, len(SYMBOLS)))).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(text)


def _check_digit(body: Column) -> Column:
    return F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: F.call_function("luhn_check", F.concat(body, c)))[0].cast("int")


def _detail(m: Column) -> Column:
    """A match with its kind, the part that is replaced, and that part's canonical form; m may be any expression and is computed once."""
    kind = lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))
    core = lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _core(x["kind"], x["m"]).alias("core"))
    own = lambda x: F.struct(x["m"].alias("m"), _own_kind(x["kind"], x["core"]).alias("kind"), x["core"].alias("core"))
    whole = lambda y: F.struct(y["m"].alias("m"), y["kind"].alias("kind"), y["core"].alias("core"), _canonical(y["kind"], y["core"]).alias("canonical"))
    return _let(_let(_let(_let(m, kind), core), own), whole)


def _card(key: str | Column, card: Column) -> Column:
    n = F.length(card)
    two = _feistel(key, F.substring(card, 1, 4).cast("long") - 2221, F.substring(card, 5, 11), F.lit(500), F.lit(10**11), F.lit("card:2"))
    two = _let(two, lambda x: F.concat((x["l"] + 2221).cast("string"), F.lpad(x["r"].cast("string"), 11, "0")))
    body = F.when(card.startswith("2"), two).otherwise(F.concat(F.substring(card, 1, 1), _digits(key, F.substring(card, F.lit(2), n - 2), F.lit("card"))))
    offset = F.substring(card, -1, 1).cast("int") - _check_digit(F.substring(card, F.lit(1), n - 1))
    return _let(body, lambda b: F.concat(b, F.pmod(_check_digit(b) + offset, F.lit(10)).cast("string")))


def _phone(key: str | Column, m: Column, canonical: Column) -> Column:
    """The digits of a number, its country code kept, in the format of the match; a trunk zero in brackets stays."""

    def number(code: Column) -> Column:
        return F.concat(code, _digits(key, F.substring(F.regexp_replace(canonical, r"\+", ""), F.length(code) + 1, F.lit(40)), F.concat(F.lit("phone"), code)))

    digits = _let(F.regexp_extract(canonical, COUNTRY_CODE, 1), number)
    return _let(digits, lambda d: F.replace(_fill(F.replace(m, F.lit("(0)"), F.lit("(o)")), d), F.lit("(o)"), F.lit("(0)")))


def _mac(key: str | Column, m: Column, canonical: Column) -> Column:
    half = lambda at: F.conv(F.substring(canonical, at, 5), 16, 10).cast("long")
    x = _feistel(key, half(3), half(8), F.lit(1 << 20), F.lit(1 << 20), F.concat(F.lit("mac"), F.substring(canonical, 1, 2)))
    code = _let(x, lambda x: F.concat(F.substring(canonical, 1, 2), F.lower(F.lpad(F.hex(x["l"]), 5, "0")), F.lower(F.lpad(F.hex(x["r"]), 5, "0"))))
    return _let(code, lambda c: F.when(m.rlike("[A-F]"), F.upper(_fill(m, c, _HEX))).otherwise(_fill(m, c, _HEX)))


def _ipv6(key: str | Column, m: Column, canonical: Column) -> Column:
    """Groups other than the first one and zeros are drawn from 1000 to ffff, so that they are written in four digits."""
    written = F.split(m, ":")

    def group(g: Column, i: Column) -> Column:
        gap = F.array_position(written, "")  # 0: written out
        place = F.when((gap == 0) | (i < gap), i).otherwise(8 - F.size(written) + i)
        new = F.hex(F.pmod(_number(F.substring(_hash(key, F.lit("ipv6"), canonical, place.cast("string")), 1, 15)), F.lit(0xF000)) + 0x1000)
        return F.when((i == 0) | g.rlike("^0*$"), g).otherwise(F.when(m.rlike("[A-F]"), new).otherwise(F.lower(new)))

    return F.array_join(F.transform(written, group), ":")


def _iban(m: Column, canonical: Column, stream: Column) -> Column:
    def checked(body: Column) -> Column:
        zero = F.concat(F.substring(canonical, 1, 2), F.lit("00"), body)
        return F.concat(F.substring(canonical, 1, 2), F.lpad((98 - _mod97(zero)).cast("string"), 2, "0"), body)

    code = _let(_let(_characters(F.substring(canonical, F.lit(5), F.length(canonical)), stream), lambda b: b), checked)
    return _let(code, lambda c: _fill(m, c, "[0-9A-Z]"))


def _ip(key: str | Column, m: Column) -> Column:
    def moved(o: Column) -> Column:
        usual = o[0].between(1, 223)
        left = F.when(usual, (o[0] - 1) * 256 + o[1]).otherwise(o[1])
        x = _feistel(key, left, o[2] * 256 + o[3], F.when(usual, F.lit(223 * 256)).otherwise(F.lit(256)), F.lit(65536), F.concat(F.lit("ip"), F.when(usual, "").otherwise(o[0].cast("string"))))
        return _let(x, lambda x: F.concat_ws(".", F.when(usual, F.floor(x["l"] / 256) + 1).otherwise(o[0]).cast("string"), F.pmod(x["l"], F.lit(256)).cast("string"), F.floor(x["r"] / 256).cast("string"), F.pmod(x["r"], F.lit(256)).cast("string")))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), moved)


def _name(m: Column, core: Column, stream: Column) -> Column:
    title, cyrillic = F.regexp_extract(m, rf"^({_TITLES})", 1), core.rlike(r"\p{IsCyrillic}")
    pick = F.pmod(_number(F.substring(stream, 1, 8)), F.lit(16)).cast("int") + 1
    lists = {k: F.array(*[F.lit(n) for n in v]) for k, v in GIVEN.items()}
    woman = title.isin(*FEMALE, *FEMALE_CYRILLIC)
    names = F.when(cyrillic & woman, lists["female cyrillic"]).when(cyrillic, lists["male cyrillic"]).when(woman, lists["female"]).otherwise(lists["male"])
    parts = F.when(cyrillic, F.array(*[F.lit(s) for s in SYLLABLES_CYRILLIC])).otherwise(F.array(*[F.lit(s) for s in SYLLABLES]))
    surname = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(NAME_SYLLABLES)), lambda i: F.element_at(parts, (_number(F.substring(stream, 8 + i, F.lit(1))) + 1).cast("int"))), ""))
    words = F.size(F.split(core, " "))
    return F.when(words == 1, surname).when(words == 2, F.concat_ws(" ", F.element_at(names, pick), surname)).otherwise(F.concat_ws(" ", F.element_at(names, pick), F.element_at(names, 17 - pick), surname))


def _email(key: str | Column, canonical: Column, stream: Column) -> Column:
    domain = F.translate(F.substring(_hash(key, F.lit("domain"), canonical), 1, 14), "0123456789", "ghijklmnop")
    top = F.regexp_extract(canonical, r"\.(com|org|net)$", 1)
    return F.concat(_characters(F.regexp_extract(canonical, "^([^@]*)@", 1), stream), F.lit("@"), domain, F.lit(".example."), F.when(top != "", top).otherwise("net"))


def _surrogate(key: str | Column, d: Column) -> Column:
    """The surrogate of a match, from its _detail(), as a struct of the whole match and of the replaced part; for one canonical form it differs only in format."""

    def made(x: Column) -> Column:
        m, kind, core, canonical = (x["d"][k] for k in ("m", "kind", "core", "canonical"))
        stream = x["stream"]
        drawn = F.length(F.regexp_replace(core, r"[\x00-/:-@\[-`{-\x7f]", ""))  # characters that are replaced
        long = F.when(drawn < 16, F.concat(core, F.substring(stream, F.lit(1), 16 - drawn))).otherwise(core)
        last = F.regexp_extract(core, r"(-----END [A-Z0-9 ]*-----)$", 1)
        parts = F.split(core, r"\.")
        new = (
            F.when(kind == "card", _fill(m, _card(key, canonical)))
            .when(kind == "phone", _phone(key, m, canonical))
            .when(kind == "ssn", _fill(m, _digits(key, canonical, F.lit("ssn"))))
            .when(kind == "ip", _ip(key, m))
            .when(kind == "email", _email(key, canonical, stream))
            .when(kind == "access_key", F.concat(F.substring(core, 1, 4), _characters(F.substring(core, 5, 16), stream)))
            .when(kind == "jwt", F.concat_ws(".", *[F.concat(F.lit("eyJ"), _characters(F.substring(F.get(parts, i), F.lit(4), F.length(core)), _hash("", stream, F.lit(str(i))))) for i in (0, 1)], _characters(F.get(parts, 2), stream)))
            .when(kind == "mac", _mac(key, m, canonical))
            .when(kind == "ipv6", _ipv6(key, m, canonical))
            .when(kind == "iban", _iban(m, canonical, stream))
            .when(kind == "private_key", F.concat(_fill(F.substring(core, F.lit(1), F.length(core) - F.length(last)), _characters(canonical, stream), r"\S"), last))
            .when(kind == "secret", _characters(long, stream, drawn == 0))
            .when(kind == "name", _name(m, core, stream))
            .otherwise(core)
        )
        return _let(new, lambda n: F.struct(F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(core)), n).alias("text"), n.alias("core")))

    return _let(F.struct(d.alias("d"), _hash(key, d["kind"], d["canonical"]).alias("stream")), made)


def matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _numbered(key: str, attempt: Column) -> Column:
    return F.concat(F.lit(f"{key}:"), attempt.cast("string"))


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs(text) -> kind, canonical, attempt, new: the distinct entities, and the canonical form of the surrogate of each, all distinct within a kind."""
    found = docs.select(F.explode(matches(F.col("text"))).alias("m")).distinct().select(_detail(F.col("m")).alias("d")).where("d.kind is not null")
    # few bytes but much work for each entity: as many tasks as shuffle partitions, whatever the size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.groupBy("d.kind", "d.canonical").agg(F.min("d").alias("d")).repartition(parts)
    columns = ["kind", "canonical", "d", "attempt", "new"]

    def drawn(x: DataFrame) -> DataFrame:
        new = _let(_surrogate(_numbered(key, F.col("attempt")), F.col("d"))["core"], lambda n: _canonical(F.col("kind"), n))
        return x.withColumn("new", new).select(*columns)

    now = keep(drawn(found.withColumn("attempt", F.lit(0))), "entities")
    for attempt in range(ATTEMPTS):
        claims = now.select("kind", "new", F.col("canonical").alias("by"), F.lit(0).alias("real"))
        real = now.select("kind", F.col("canonical").alias("new"), F.lit(None).cast("string").alias("by"), F.lit(1).alias("real"))
        if attempt >= AVOID:
            real = real.limit(0)
        bad = claims.unionByName(real).groupBy("kind", "new").agg(F.max("real").alias("real"), F.min("by").alias("first"), F.count("by").alias("n"))
        bad = bad.where("n > 1 or n > 0 and real = 1")
        x = now.join(bad, ["kind", "new"], "left").withColumn("again", F.coalesce((F.col("real") == 1) | (F.col("first") != F.col("canonical")), F.lit(False)) | (F.col("new") == F.col("canonical")))
        if x.where("again").isEmpty():
            return now.drop("d")
        again = drawn(x.where("again").withColumn("attempt", F.col("attempt") + 1))
        now = keep(x.where("not again").select(*columns).unionByName(again), "entities")
    raise ValueError("more entities of a kind than its surrogates can tell apart")


def _name_of(d: Column) -> Column:
    return F.concat_ws("\x1f", d["kind"], d["canonical"])


def pseudonymise(docs: DataFrame, key: str = KEY, count: str = "tl_entities") -> DataFrame:
    """docs with text rewritten, and a column `count`: the number of entities in it."""
    late = keep(surrogates(docs.select("text"), key).where("attempt > 0").select(_name_of(F.struct("kind", "canonical")).alias("entity"), "attempt"), "late")
    tag = "tl_"
    while any(c.lower().startswith(tag) for c in docs.columns if c != count):
        tag += "_"
    columns, text, found = [c for c in docs.columns if c != count], F.col("text"), F.col(f"{tag}found")
    x = docs.select(*[f"`{c}`" for c in columns]).withColumn(f"{tag}found", F.transform(matches(text), _detail))
    attempt = lambda d: F.lit(0)
    if not late.isEmpty():  # rare: the attempts of the late entities of each text that holds one
        held = docs.where(text.rlike(HINT)).select(F.sha2("text", 256).alias(f"{tag}t"), F.explode(F.array_distinct(F.transform(matches(text), lambda m: _let(_detail(m), _name_of)))).alias("entity"))
        held = held.join(late, "entity").groupBy(f"{tag}t").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(f"{tag}late"))
        x = x.join(held, F.sha2("text", 256) == F.col(f"{tag}t"), "left")
        attempt = lambda d: F.coalesce(F.try_element_at(F.col(f"{tag}late"), _name_of(d)), F.lit(0))
    new = F.transform(found, lambda d: F.when(d["kind"].isNull(), d["m"]).otherwise(_surrogate(_numbered(key, attempt(d)), d)["text"]))
    between = F.split(text, PATTERN, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    n = F.size(F.filter(found, lambda d: d["kind"].isNotNull()))
    return x.select(*[F.when(n > 0, woven).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], n.alias(count))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_entities and the rewritten text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", F.col("tl_entities").cast("long").alias("n_entities"), "text")
