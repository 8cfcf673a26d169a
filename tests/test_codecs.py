"""Checksums, bounded reads, filters and axioms against plain Python."""

import random

from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import compact, fold


def test_crc32c(spark):
    d = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (bytearray(32),), (None,)], "b binary")
    c = codec.crc32c(F.col("b"))
    got = [tuple(r) for r in d.select(c, codec.crc_unmasked(codec.crc_masked(c))).collect()]
    assert got == [(0xE3069283,) * 2, (0, 0), (0x8A9136AA,) * 2, (None, None)]


def test_bounded_reads(spark):
    raw = bytes(range(200, 220))
    d = spark.createDataFrame([(bytearray(raw),)], "b binary")
    for size in (1, 2, 4, 7, 8, 15):
        for little in (False, True):
            got = d.select(codec.number(F.col("b"), 3, size, little)).first()[0]
            assert int(got) == int.from_bytes(raw[2 : 2 + size], "little" if little else "big")
    assert d.select(codec.number(F.col("b"), 18, 4), codec.number(F.col("b"), 1, 16), codec.take(F.col("b"), 0, 1)).first()[:] == (None, None, None)
    framed = spark.createDataFrame([(bytearray(b"\0\0\0\x02ab\0\0\0\x09x"),)], "b binary")
    one = framed.select(codec.length_prefixed(F.col("b"), 1).alias("x"), codec.length_prefixed(F.col("b"), 7).alias("y")).first()
    assert bytes(one.x.part) == b"ab" and one.x.next == 7 and one.y is None


def test_bloom(spark):
    size = 1 << 12
    keys = spark.range(300).select((F.col("id") % 2).alias("g"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bits = codec.bloom_array(codec.bloom(keys, "key", ["g"], size), ["g"], size)
    x = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id").crossJoin(F.broadcast(bits)).withColumn("held", codec.may_contain(F.col("bits"), F.col("key"), size))
    rows = x.select("g", "id", "held").collect()
    assert all(r.held for r in rows if r.id < 300 and r.id % 2 == r.g)
    assert sum(r.held for r in rows if r.id >= 300) < 0.02 * 3400


def test_axioms(spark):
    v = spark.createDataFrame([(x,) for x in (0, 1, 2, 5, None)], "value int")
    assert fold.axiom_faults(v, lambda a, b: F.greatest(a, b)).first()[:] == (0, 0, 0)
    bad = fold.axiom_faults(v, lambda a, b: a - b).first()
    assert bad.commutative and bad.associative and bad.idempotent


def test_bytes_of_other_lengths(spark):
    rnd, rows, want = random.Random(1), [], {}
    for i in range(200):
        k, b = i % 7, rnd.randbytes(rnd.randrange(0, 30))
        rows.append((k, bytearray(b)))
        old = want.get(k, b"")
        n = max(len(old), len(b))
        want[k] = bytes(x | y for x, y in zip(old.ljust(n, b"\0"), b.ljust(n, b"\0"), strict=True))
    got = {r.key: bytes(r.bits) for r in fold.fold_bytes(spark.createDataFrame(rows, "key int, value binary")).collect()}
    assert got == want


def test_slices(spark):
    v = spark.createDataFrame([(f"k{i % 40:02}", i) for i in range(200)], "key string, seq long")
    x = compact.slices(v, 4).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    assert compact.slice_faults(x).first()[:] == (0, 0, 0)
    assert compact.slice_faults(x.withColumn("part", F.floor(F.col("seq") / 40) % 2)).first()["split"] > 0


def test_clock_over_bins(spark):
    rnd = random.Random(3)
    walls = [rnd.randrange(100) for _ in range(60)]
    want, now = [], None
    for w in walls:
        now = w if now is None else max(w, now + 1)
        want.append(now)
    d = spark.createDataFrame([(i, w) for i, w in enumerate(walls)], "n long, wall long")
    for block in (7, 4096):
        assert [r.time for r in fold.hybrid_clock(d, block=block).orderBy("n").collect()] == want
