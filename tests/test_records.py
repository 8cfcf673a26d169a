"""Byte forms, generators, locks, runs, the history tier and the feed cache against plain Python."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import random as R
from tidelog.functions import records
from tidelog.operators import recovery, txn
from tidelog.sources import runs
from tidelog.sources.shared import new_path
from tidelog.sources.store import Store
from tidelog.sources.tier import HistoryTier
from tidelog.streaming import feed

OPS = "id int, ops array<struct<kind: int, seq: long, key: binary, value: binary>>"


def plain(ops):
    out = struct.pack("<BI", 1, len(ops))
    for kind, seq, key, value in ops:
        out += struct.pack("<BqI", kind, seq, len(key)) + key + struct.pack("<I", len(value or b"")) + (value or b"")
    return out


def test_write_records(spark):
    rnd = random.Random(5)
    rows = [(i, [(rnd.choice((0, 1, 2)), rnd.randrange(1 << 62), rnd.randbytes(rnd.randrange(9)), rnd.choice((None, b"", b"same", rnd.randbytes(300)))) for _ in range(i % 13)]) for i in range(60)]
    d = spark.createDataFrame(rows, OPS)
    one = {r.id: r for r in d.select("id", records.write_record(F.col("ops"), share=False).alias("p"), records.write_record(F.col("ops")).alias("s")).collect()}
    want = []
    for i, ops in rows:
        assert bytes(one[i].p) == plain(ops)
        repeats = sum(a[3] == b[3] and bool(a[3]) for a, b in zip(ops, ops[1:]))
        assert (bytes(one[i].s) == plain(ops)) == (repeats == 0)
        want += [(i, n, k, s, key, v or b"", None) for n, (k, s, key, v) in enumerate(ops)]
    for share in (False, True):
        x = records.write_record_ops(d.withColumn("r", records.write_record(F.col("ops"), share)), "r", ["id"])
        got = sorted(tuple(bytes(c) if isinstance(c, bytearray) else c for c in r) for r in x.collect())
        assert got == sorted(want)


def test_damaged_records(spark):
    good = plain([(1, 7, b"key", b"value"), (0, 8, b"k", b"")])
    bad = [good[:n] for n in range(len(good))] + [good + b"x", b"\3" + good[1:], struct.pack("<BI", 1, 1 << 31), struct.pack("<BIBqI", 2, 1, 0x81, 1, 0), struct.pack("<BIBqII", 1, 1, 3, 1, 0, 0), None]
    d = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(bad)], "id int, r binary")
    rows = records.write_record_ops(d, "r", ["id"]).collect()
    assert len(rows) == len(bad) and all(r.error and r.key is None for r in rows)
    assert records.write_record_ops(d.limit(0), "r", ["id"]).count() == 0
    with pytest.raises(ValueError):
        records.write_record_ops(d.withColumn("pos", F.lit(1)), "r", ["pos"])


def test_messages(spark):
    d = spark.createDataFrame([(1, {1: bytearray(b"a"), 3: bytearray(b"")}, {70: bytearray(b"zz")}), (0, {1: bytearray(b"a")}, {}), (2, {1: bytearray(b"a")}, {1: bytearray(b"b")}), (9, {}, {})], "v int, k map<int, binary>, u map<int, binary>")
    m = d.select("v", records.message(F.col("v"), F.col("k"), F.col("u")).alias("m"))
    raw = {r.v: r.m and bytes(r.m) for r in m.collect()}
    assert raw[1] == b"PEDR" + struct.pack("<HH", 1, 3) + struct.pack("<HI", 1, 1) + b"a" + struct.pack("<HI", 3, 0) + struct.pack("<HI", 70, 2) + b"zz"
    assert raw[0] is None and raw[2] is None and raw[9] == b"PEDR" + struct.pack("<HH", 9, 0)
    one = records.message_fields(m.where("v = 1"), "m", ["v"], 2).first()
    assert (one.version, {k: bytes(x) for k, x in one.known.items()}, {k: bytes(x) for k, x in one.unknown.items()}, one.error) == (1, {1: b"a"}, {3: b"", 70: b"zz"}, None)
    twice = b"PEDR" + struct.pack("<HH", 1, 2) + 2 * (struct.pack("<HI", 5, 1) + b"q")
    bad = [raw[1][:n] for n in range(len(raw[1]))] + [raw[1] + b"!", b"XXXX" + raw[1][4:], b"PEDR" + bytes(4), twice, None]
    d = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(bad)], "id int, m binary")
    rows = records.message_fields(d, "m", ["id"], 9).collect()
    assert len(rows) == len(bad) and all(r.error and r.known is None for r in rows)


def test_evolving_records(spark):
    one, two = struct.pack("<HIII", 1, 7, 1, 2) + b"kvv", struct.pack("<HqqII", 2, 1 << 40, 0, 0, 1) + b"v"
    d = spark.createDataFrame([(bytearray(x),) for x in (one, two, one[:-1], b"", struct.pack("<H", 3) + bytes(40))], "b binary")
    got = [r.e and (r.e.id, bytes(r.e.key), bytes(r.e.value), r.e.ttl_seconds) for r in d.select(records.evolved(F.col("b")).alias("e")).collect()]
    assert got == [(7, b"k", b"vv", None), (1 << 40, b"", b"v", None), None, None, None]


def test_generators(spark):
    mask = (1 << 64) - 1

    def step(x):
        x ^= x << 13 & mask
        x ^= x >> 7
        return x ^ (x << 17 & mask)

    def star(x):
        x ^= x >> 12
        x ^= x << 25 & mask
        return x ^ x >> 27

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seeds = [1, 2, mask, 0x5EED5EED5EED5EED, 1 << 63]
    d = spark.createDataFrame([(signed(s),) for s in seeds], "s long")
    s = F.col("s")
    got = d.select(R.xorshift(s), R.times(R.xorshift_star(s), R.STAR_FACTOR), R.nth(s, F.lit(3)), R.below(R.xorshift(s), 1007), R.uniform(R.xorshift(s))).collect()
    for seed, r in zip(seeds, got, strict=True):
        assert r[0] == signed(step(seed)) and r[1] == signed(star(seed) * R.STAR_FACTOR & mask) and r[2] == signed(step(step(step(seed))))
        assert r[3] == step(seed) % 1007 and r[4] == (step(seed) >> 11) / (1 << 53)


def test_zipf(spark, sf):
    records_, weights = 50, []
    for i in range(50):
        weights.append((weights[-1] if weights else 0.0) + 1 / (i + 1) ** 0.99)
    rnd = random.Random(2)
    rows = [(rnd.random(), rnd.randrange(1, 90)) for _ in range(500)]
    d = spark.createDataFrame(rows, "u double, latest long")
    got = [r[0] for r in d.select(R.zipf_pick(F.col("u"), F.col("latest"), records_)).collect()]
    for (u, latest), g in zip(rows, got, strict=True):
        n = min(latest, records_)
        assert g == records_ - n + min(next(i for i, w in enumerate(weights) if i == n - 1 or w >= u * weights[n - 1]), n - 1)
    from tidelog.plans import record_queries

    x = record_queries.zipf_picks(spark, sf)
    assert x.agg(F.sum("picks")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_properties(spark):
    tx = spark.createDataFrame([(1, True, False, 2), (2, True, False, 2), (3, False, True, 2), (4, True, True, 0), (5, True, False, 2), (6, False, False, 1), (7, True, False, 0)], "tx_id int, committed boolean, aborted boolean, staged int")
    seen = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (5, 0), (5, 2)], "tx_id int, write int")
    assert {r.tx_id: r.holds for r in recovery.all_or_nothing(tx, seen).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
    e = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 2, True), ("c", 0, True), ("d", 0, False)], "log string, pos int, acked boolean")
    s = spark.createDataFrame([("a", 1), ("b", 2)], "log string, survives int")
    assert {r.log: r.holds for r in recovery.acks_durable(e, s).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_lock_timeouts():
    t = txn.LockTable()
    assert t.lock(1, "a") and t.lock(2, "b")
    assert not t.lock(3, "a", now=0, timeout=5) and not t.lock(3, "a", now=4, timeout=5)
    with pytest.raises(TimeoutError):
        t.lock(3, "a", now=5, timeout=5)
    with pytest.raises(TimeoutError):
        t.lock(3, "a", timeout=0)
    assert not t.lock(1, "b", timeout=9) and not t.waits.get(3)
    with pytest.raises(RuntimeError, match="deadlock"):
        t.lock(2, "a", timeout=0)
    assert not t.lock(2, "a", detect=False)
    # whoever owns the key by then: 3 takes b, then waits for c, which 1 owns
    t = txn.LockTable()
    assert t.lock(1, "c") and t.lock(2, "b") and not t.lock(1, "b")
    t.release(2)
    assert t.lock(3, "b")
    with pytest.raises(RuntimeError, match="deadlock"):
        t.lock(3, "c")


def test_retries():
    counts, pauses, left = txn.Contention(), [], [1, 1]

    def body():
        if left and left.pop():
            raise KeyError
        return "done"

    assert txn.retried(body, KeyError, counts=counts, sleep=pauses.append) == "done" and len(pauses) == 2
    with pytest.raises(KeyError):
        txn.retried(lambda: {}["x"], KeyError, attempts=3, counts=counts, sleep=pauses.append)
    assert counts == txn.Contention(conflicts=5, retried_commits=1, exhausted=1)


def test_runs(spark):
    path, rows = new_path(spark, "run"), spark.range(500).select(F.format_string("k%04d", (F.col("id") * 37 % 500)).alias("key"), (F.col("id") % 5 != 0).cast("int").alias("kind"), F.lit("v").alias("value"))
    info = runs.write_run(rows, path)
    assert (info["entries"], info["smallest"], info["largest"]) == (500, "k0000", "k0499") and info["bytes"] > 0
    assert runs.run_faults(spark, path).first()[:] == (0, 0)
    for bad in (rows.union(rows.limit(1)), rows.withColumn("kind", F.lit(2)), rows.withColumn("key", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            runs.write_run(bad, new_path(spark, "run"))
    spread = new_path(spark, "run")
    rows.union(rows.limit(3)).repartition(3).write.parquet(spread)
    faults = runs.run_faults(spark, spread).first()
    assert faults.repeated == 3 and faults.overlapping
    empty = new_path(spark, "run")
    assert runs.write_run(rows.limit(0), empty)["entries"] == 0


def test_history_tier(spark):
    tier = HistoryTier(spark, new_path(spark, "tier"))
    v = spark.createDataFrame([("default", f"k{i % 7}", i, 1, f"v{i}", 1) for i in range(1, 60)], "cf string, key string, seq long, kind int, value string, commit_id long")
    assert tier.read().count() == 0 and tier.put(v.limit(0)) == "" and tier.segments() == []
    a, b = tier.put(v.where("seq <= 30")), tier.put(v.where("seq between 20 and 50"))
    assert a != b and tier.put(v.where("seq <= 30").repartition(3)) == a and [s["name"] for s in tier.segments()] == [a, b]
    assert sorted(r.seq for r in tier.read().collect()) == list(range(1, 51)) and tier.read(low=40).count() == 11
    assert tier.restore(v.where("seq > 50"), 55).count() == 55 and tier.verify() == []
    v.limit(1).write.mode("append").parquet(f"{tier.root}/segments/{a}")
    assert tier.verify() == [a]


def test_feed_cache(spark):
    assert [feed.should_store(*x) for x in ((64, 64), (63, 64), (9, 0))] == [True, False, False]
    assert feed.within_budget(100_000) and not feed.within_budget(100_001)
    v = spark.createDataFrame([(f"k{i % 7}", i, i % 3 and 1, f"v{i}") for i in range(1, 40)], "key string, seq long, kind int, value string")
    c = feed.FeedCache(spark, new_path(spark, "feed"))
    assert c.load() is None
    c.store(v, 10)
    spark.range(1).write.parquet(f"{c.root}/upto=99")
    c._fs.delete(c._path("upto=99", "_SUCCESS"), False)  # not finished
    got = c.store(v, 39)
    want = feed.changes_latest(v, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and c.load()[1] == 39
    c.store(v, 5)
    assert c._finished() == [10, 39]


def test_ingest_run(spark):
    s, path = Store.open(spark, new_path(spark, "store")), new_path(spark, "run")
    s.write(spark.createDataFrame([(1, "default", "put", "a", "old"), (2, "default", "put", "b", "old")], "pos long, cf string, op string, key string, value string"))
    runs.write_run(spark.createDataFrame([("a", 0, None), ("c", 1, "new")], runs.RUN), path)
    assert runs.ingest_run(s, path) == 4
    assert sorted((r.key, r.value) for r in s.as_of().collect()) == [("b", "old"), ("c", "new")]
