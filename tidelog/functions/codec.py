"""Key and record codecs as Column expressions. Binary columns in, binary columns out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n), digits, "0")


def pack(seq: Column, kind: Column) -> Column:
    """Sequence and kind in 8 bytes, big endian: the sequence in the upper 56 bits."""
    return F.unhex(_hex(F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long")), 16))


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    return F.concat(key, pack(seq, kind))


def internal_parts(ikey: Column) -> Column:
    """struct(key, seq, kind) of an internal key."""
    n = F.length(ikey)
    tail = F.hex(F.substring(ikey, n - 7, F.lit(8)))
    return F.struct(F.substring(ikey, F.lit(1), n - 8).alias("key"), F.conv(F.substring(tail, 1, 14), 16, 10).cast("long").alias("seq"), F.conv(F.substring(tail, 15, 2), 16, 10).cast("int").alias("kind"))


def element(part: Column) -> Column:
    """A tuple element: bytes 00 as 00 FF, closed by 00 01; the order of encodings is the order of tuples."""
    h = F.hex(part)
    pairs = F.transform(F.sequence(F.lit(1), F.length(part)), lambda i: F.substring(h, 2 * i - 1, F.lit(2)))
    escaped = F.array_join(F.transform(pairs, lambda p: F.when(p == "00", "00FF").otherwise(p)), "")
    return F.unhex(F.concat(F.when(F.length(part) > 0, escaped).otherwise(""), F.lit("0001")))


def tuple_key(*parts: Column) -> Column:
    return F.concat(*[element(p) for p in parts])


def tuple_parts(code: Column) -> Column:
    """array<binary> of the elements of a tuple key."""
    h = F.hex(code)
    pairs = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.substring(h, 2 * i - 1, F.lit(2)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("zero"))

    def step(a: Column, p: Column) -> Column:
        closed = a["zero"] & (p == "01")
        done = F.when(closed, F.array_append(a["done"], a["now"])).otherwise(a["done"])
        now = F.when(closed, "").when(a["zero"], F.concat(a["now"], F.lit("00"))).when(p == "00", a["now"]).otherwise(F.concat(a["now"], p))
        return F.struct(done.alias("done"), now.alias("now"), (~a["zero"] & (p == "00")).alias("zero"))

    return F.transform(F.aggregate(pairs, start, step)["done"], F.unhex)


def prefix_free(key: Column, seq: Column, kind: Column) -> Column:
    """[length, 4 bytes][key][inverted sequence, 8 bytes][kind]; decode before comparing keys of other lengths."""
    return F.concat(F.unhex(_hex(F.length(key).cast("long"), 8)), key, F.unhex(_hex(F.bitwise_not(seq.cast("long")), 16)), F.unhex(_hex(kind.cast("long"), 2)))


def prefix_free_parts(code: Column) -> Column:
    n = F.conv(F.hex(F.substring(code, 1, 4)), 16, 10).cast("int")
    seq = F.hex(F.substring(code, n + 5, F.lit(8)))
    # an inverted sequence has its top bits set: read it as two halves
    high, low = (F.conv(F.substring(seq, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.struct(F.substring(code, F.lit(5), n).alias("key"), F.bitwise_not(F.shiftleft(high, 32).bitwiseOR(low)).alias("seq"), F.conv(F.hex(F.substring(code, n + 13, F.lit(1))), 16, 10).cast("int").alias("kind"))


def family_key(cf: Column, key: Column) -> Column:
    """The default family may be raw; others are name, NUL, key."""
    return F.when(cf == "default", key).otherwise(F.concat(cf.cast("binary"), F.lit(b"\0"), key))


def family_parts(code: Column) -> Column:
    """struct(cf, key): the family is what comes before the first NUL, `default` if there is none."""
    h = F.hex(code)
    pairs = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.substring(h, 2 * i - 1, F.lit(2)))
    at = F.when(F.length(code) > 0, F.array_position(pairs, "00")).otherwise(0).cast("int")
    return F.struct(F.when(at > 0, F.substring(code, F.lit(1), at - 1).cast("string")).otherwise("default").alias("cf"), F.when(at > 0, F.substring(code, at + 1, F.length(code))).otherwise(code).alias("key"))


def tenant_key(tenant: Column, key: Column) -> Column:
    """8 bytes of the tenant, big endian, before the key."""
    return F.concat(F.unhex(_hex(tenant.cast("long"), 16)), key)


def tenant_parts(code: Column) -> Column:
    return F.struct(F.conv(F.hex(F.substring(code, 1, 8)), 16, 10).cast("long").alias("tenant"), F.substring(code, F.lit(9), F.length(code)).alias("key"))


def in_tenant(code: Column, tenant: Column) -> Column:
    return F.substring(code, 1, 8) == F.unhex(_hex(tenant.cast("long"), 16))


def canonical(key: Column) -> Column:
    """A text key without ASCII white space at its ends, A-Z in lower case and nothing else changed."""
    return F.translate(F.regexp_replace(key, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fnv1a(key: Column) -> Column:
    """64-bit FNV-1a of bytes, as the signed long of its bits."""
    h = F.hex(key)
    data = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    # the prime is 2^40 + 0x1B3; products wrap, so they are built from shifts and 32-bit halves
    mask = F.lit(0xFFFFFFFF)

    def times(x: Column) -> Column:
        low, high = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        small = low * 0x1B3
        upper = (high * 0x1B3 + F.shiftrightunsigned(small, 32)).bitwiseAND(mask)
        upper = (upper + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(mask)
        return F.shiftleft(upper, 32).bitwiseOR(small.bitwiseAND(mask))

    return F.when(F.length(key) > 0, F.aggregate(data, F.lit(-3750763034362895579), lambda a, b: times(a.bitwiseXOR(b)))).otherwise(F.lit(-3750763034362895579))


def with_length(part: Column) -> Column:
    """A part behind its length in 4 bytes, big endian."""
    return F.concat(F.unhex(_hex(F.length(part).cast("long"), 8)), part)


def fold_record(value: Column, version: Column) -> Column:
    """[length of version, 1 byte][version][value]."""
    return F.concat(F.unhex(_hex(F.length(version).cast("long"), 2)), version, value)


def fold_parts(record: Column) -> Column:
    n = F.conv(F.hex(F.substring(record, 1, 1)), 16, 10).cast("int")
    return F.struct(F.substring(record, F.lit(2), n).alias("version"), F.substring(record, n + 2, F.length(record)).alias("value"))


def take(data: Column, at: Column | int, size: Column | int) -> Column:
    """`size` bytes at a 1-based place, null if they aren't all there."""
    at, size = (x if isinstance(x, Column) else F.lit(x) for x in (at, size))
    return F.when((at >= 1) & (size >= 0) & (at + size - 1 <= F.length(data)), F.substring(data, at, size))


def number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of up to 16 bytes at a 1-based place, null if it isn't all there: a long up to 7 bytes, else decimal(38), null from 10^38 on."""
    h = F.hex(take(data, at, size))
    if little:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    if size < 8:
        return F.conv(h, 16, 10).cast("long")
    # parts of 7 bytes from the right
    parts = [F.conv(F.substring(h, max(0, e - 14) + 1, min(14, e)), 16, 10).cast("decimal(38,0)") for e in range(2 * size, 0, -14)]
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = F.try_add(F.try_multiply(out, F.lit(1 << 56).cast("decimal(38,0)")), p).cast("decimal(38,0)")
    return out


def length_prefixed(data: Column, at: Column | int) -> Column:
    """struct(part, next) of a part behind its length in 4 bytes, big endian, at a 1-based place; null if it isn't all there."""
    at = at if isinstance(at, Column) else F.lit(at)
    size = F.conv(F.hex(take(data, at, 4)), 16, 10).cast("int")
    part = take(data, at + 4, size)
    return F.when(part.isNotNull(), F.struct(part.alias("part"), (at + 4 + size).alias("next")))


def _crc_table() -> list[int]:
    """Of the Castagnoli polynomial, reflected."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C of bytes as an unsigned number."""
    h, table = F.hex(data), F.array(*[F.lit(x).cast("long") for x in _crc_table()])
    octets = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda a, b: F.shiftright(a, 8).bitwiseXOR(F.element_at(table, (a.bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int")))
    start = F.lit(0xFFFFFFFF).cast("long")
    return F.when(F.length(data) > 0, F.aggregate(octets, start, step).bitwiseXOR(F.lit(0xFFFFFFFF))).when(F.length(data) == 0, F.lit(0))


def crc_masked(crc: Column) -> Column:
    """A checksum stored beside what it covers: rotated right by 15 bits, plus a fixed number."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (turned + F.lit(0xA282EAD8)).bitwiseAND(F.lit(0xFFFFFFFF))


def crc_unmasked(masked: Column) -> Column:
    x = (masked - F.lit(0xA282EAD8)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(x, 17).bitwiseOR(F.shiftleft(x, 15).bitwiseAND(F.lit(0xFFFFFFFF)))


def upgrade(record: Column) -> Column:
    """A record of the first form (id int, key, value) as one of the second: id long, no time to live."""
    return F.struct(record["id"].cast("long").alias("id"), record["key"].alias("key"), record["value"].alias("value"), F.lit(None).cast("long").alias("ttl_seconds"))


def merge_fields(known: Column, unknown: Column) -> Column:
    """Tagged fields: known ones, and those that this reader does not know, which survive."""
    return F.map_concat(F.map_filter(unknown, lambda k, v: ~F.map_contains_key(known, k)), known)


def row_key(key: Column, version: Column) -> Column:
    """A text key and the big-endian version as 16 hex digits behind it."""
    return F.concat(key, _hex(version.cast("long"), 16))


def _places(key: Column, size: int, hashes: int) -> Column:
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    # 31 bits of each, so that the sums stay in a long
    low = lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF))
    return F.array(*[F.pmod(low(h1) + F.lit(i) * low(h2), F.lit(size)) for i in range(hashes)])


def bloom(keys: DataFrame, key: str, by: list[str], size: int, hashes: int = 6) -> DataFrame:
    """keys -> (by..., word, bits): the filter of each group as 64-bit words, by a map-side combined or; words without a bit are left out."""
    x = keys.select(*by, F.explode(_places(F.col(key), size, hashes)).alias("p"))
    return x.groupBy(*by, F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))


def bloom_array(words: DataFrame, by: list[str], size: int) -> DataFrame:
    """bloom()'s rows -> (by..., bits): one array of all words a group, for may_contain()."""
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(-(-size // 64) - 1).cast("long"))
    return words.groupBy(*by).agg(held.alias("m")).select(*by, F.transform(every, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("bits"))


def may_contain(bits: Column, key: Column, size: int, hashes: int = 6) -> Column:
    """Bloom filter test: bits is array<long> of `size` bits in 64-bit words."""
    return F.forall(_places(key, size, hashes), lambda p: F.getbit(F.element_at(bits, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a partitioned filter, or of a routed key: its FNV-1a hash, unsigned, by the number of partitions."""
    h = fnv1a(key)
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(partitions)) * F.lit((1 << 32) % partitions) + low, F.lit(partitions)).cast("int")


def bloom_bits(run_keys: int) -> int:
    """Bits a key: more for small runs, which are probed first."""
    return 16 if run_keys <= 1 << 16 else 12 if run_keys <= 1 << 22 else 10
