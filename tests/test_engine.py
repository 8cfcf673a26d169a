"""Rules of visibility, folds, GC, transactions, feeds and the store on small cases, and against a model."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import compact, fold, txn
from tidelog.operators import visible as reads
from tidelog.sources.store import Conflict, Store
from tidelog.streaming import feed

V, R = "key string, seq long, kind int, value string", "start string, end string, seq long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_tombstone_edges(spark):
    v = spark.createDataFrame([(k, i + 1, 1, k) for i, k in enumerate("abcd")] + [("c2", 9, 1, "new")], V)
    t = spark.createDataFrame([("b", "d", 6), ("z", "a", 7)], R)
    assert [r[0] for r in rows(reads.visible(v, t), "key")] == ["a", "c2", "d"]
    assert [r[0] for r in rows(reads.visible(v, t, 5), "key")] == ["a", "b", "c", "d"]
    assert reads.visible(v, t, 0).count() == 0


def test_newer_delete_hides_older_put(spark):
    v = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 0, None), ("e", 3, 1, ""), ("n", 4, 1, None)], V)
    t = spark.createDataFrame([], R)
    assert rows(reads.visible(v, t).select("key", "value"), "key") == [("e", ""), ("n", None)]
    got = reads.lookup(spark.createDataFrame([(0, "k"), (1, "x"), (2, "e"), (3, "k")], "pos int, key string"), v, t)
    assert [r[2] for r in rows(got, "pos")] == ["deleted", "not_found", "found", "deleted"]


@pytest.mark.parametrize("few", [2_000, 0])
def test_model(spark, few, monkeypatch):
    """Random puts, deletes and range deletes against a dictionary, by the broadcast and by the as-of way."""
    monkeypatch.setattr(reads, "FEW", few)
    rnd, model, v, t, at = random.Random(7), {}, [], [], {}
    keys = [f"key_{i:04}" for i in range(60)]
    for seq in range(1, 201):
        roll = rnd.randrange(10)
        if roll < 6:
            k = rnd.choice(keys)
            model[k] = str(seq)
            v.append((k, seq, 1, str(seq)))
        elif roll < 8:
            k = rnd.choice(keys)
            model.pop(k, None)
            v.append((k, seq, 0, None))
        else:
            a, b = sorted(rnd.sample(keys, 2))
            model = {k: x for k, x in model.items() if not a <= k < b}
            t.append((a, b, seq))
        at[seq] = dict(model)
    vs, ts = spark.createDataFrame(v, V), spark.createDataFrame(t, R)
    for seq in (50, 137, 200):
        assert dict(rows(reads.visible(vs, ts, seq).select("key", "value"), "key")) == at[seq]
    live = reads.visible(vs, ts)
    ranges = spark.createDataFrame([(i, *sorted(rnd.sample(keys, 2))) for i in range(20)] + [(99, "z", "a")], "id int, lo string, hi string")
    want = {i: len([k for k in model if lo <= k < hi]) for i, lo, hi in rows(ranges, "id")}
    assert dict(rows(reads.count_ranges(ranges, live), "id")) == want
    seen = reads.as_of(ranges.select(F.col("lo").alias("key")), live.select("key", F.col("key").alias("value")))
    for k, found in rows(seen, "key"):
        assert found == max((x for x in model if x <= k), default=None)


def test_prefix_end():
    assert reads.prefix_end(b"p\xff\xff") == b"q" and reads.prefix_end(b"\xff") is None and reads.prefix_end(b"") is None


def test_binary_prefix(spark):
    d = spark.createDataFrame([(b"p",), (b"p\xff",), (b"p\xff\x01",), (b"q",)], "key binary")
    assert d.where(reads.prefix_bounds(b"p")).count() == 3


def test_saturating_counter(spark):
    big = (1 << 63) - 1
    d = spark.createDataFrame([("a", 1, "counter_add", big), ("a", 2, "counter_add", 10), ("a", 3, "counter_add", -1), ("b", 1, "put", 5), ("b", 2, "counter_add", -7), ("c", 1, "counter_add", -big), ("c", 2, "counter_add", -big)], "key string, seq long, type string, delta long")
    for block in (1, 2, 4096):
        assert rows(fold.fold_counter(d, block), "key") == [("a", big - 1), ("b", -2), ("c", -(1 << 63))]


def test_counter_blocks_change_nothing(spark):
    rnd = random.Random(1)
    big, steps = (1 << 63) - 1, []
    for k in range(20):
        for s in range(30):
            steps.append((k, s, "put" if rnd.random() < 0.1 else "counter_add", rnd.choice([big, -big, big // 2, -(big // 3), 7])))
    want = {}
    for k, _, kind, d in sorted(steps):
        want[k] = d if kind == "put" else max(-(1 << 63), min(big, want.get(k, 0) + d))
    frame = spark.createDataFrame(steps, "key long, seq long, type string, delta long")
    for block in (1, 4, 100):
        assert dict(rows(fold.fold_counter(frame, block), "key")) == want


def test_clock_and_ttl(spark):
    d = spark.createDataFrame([(i, w) for i, w in enumerate([5, 5, 4, 20, 1])], "n int, wall int")
    assert [r[2] for r in rows(fold.hybrid_clock(d), "n")] == [5, 6, 7, 20, 21]
    e = spark.sql("select 100 as now, 2 as ne, c, ce, t from values (95, 2, 5), (96, 2, 5), (99, 1, 50), (1, 2, null) as v(c, ce, t)")
    got = e.select("c", fold.expired(F.col("now"), F.col("ne"), F.col("c"), F.col("ce"), F.col("t")).alias("x"))
    assert dict(rows(got, "c")) == {95: True, 96: False, 99: True, 1: False}


def test_gc_keeps_what_a_pin_needs(spark):
    v = spark.createDataFrame([("k", s, 1, str(s)) for s in (10, 20, 30)] + [("d", 5, 0, None)], V)
    assert [r[1] for r in rows(compact.gc(v, 25), "key", "seq")] == [5, 20, 30]
    assert [r[1] for r in rows(compact.gc(v, 25, bottom=True), "key", "seq")] == [20, 30]
    assert compact.gc(v, 25).count() + compact.archive(v, 25).count() == v.count()
    assert [r[1] for r in rows(compact.per_pin(v, [15]), "key", "seq")] == [5, 10, 30]


def test_gc_tombstone_over_pinned_version(spark):
    """A tombstone above a version that a pin holds is not lone and stays."""
    v = spark.createDataFrame([("k", 1, 1, "a"), ("k", 5, 0, None)], V)
    t = spark.createDataFrame([], R)
    assert compact.gc(v, 1, bottom=True).count() == 2
    assert compact.changed_reads(v, compact.gc(v, 5, bottom=True), t, [5, 9]).count() == 0


def test_transaction(spark):
    v = spark.createDataFrame([("a", 1, 1, "1"), ("b", 2, 1, "2")], V)
    t = spark.createDataFrame([], R)
    x = txn.Transaction(2)
    x.put("a", "own")
    x.delete("b")
    x.delete_range("q", "a")
    assert x.get(spark, v, t, "a") == "own" and x.get(spark, v, t, "b") is None and x.get(spark, v, t, "zz") is None
    state = reads.visible(v, t)
    assert rows(txn.overlay(state, x.staged(spark)), "key") == [("a", "own")]


def test_write_skew_is_a_dangerous_structure(spark):
    t = spark.createDataFrame([(1, 10, 12, ["x", "y"], ["x"]), (2, 10, 13, ["x", "y"], ["y"])], "tx_id long, snapshot_seq long, commit_seq long, reads array<string>, writes array<string>")
    e = txn.conflict_edges(t)
    assert rows(e, "reader") == [(1, 2), (2, 1)]
    assert {tuple(r) for r in txn.dangerous(e).collect()} == {(1, 2, 1), (2, 1, 2)}
    assert {r[0] for r in txn.on_cycle(e.select(F.col("reader").alias("a"), F.col("writer").alias("b"))).collect()} == {1, 2}


def test_locks_and_tokens():
    t = txn.LockTable()
    assert t.lock(1, "a") and t.lock(2, "b") and not t.lock(1, "b")
    with pytest.raises(RuntimeError):
        t.lock(2, "a")
    t.release(2)
    assert t.lock(1, "b")
    k = txn.ReadToken()
    assert k.acquire(5, 9) == 5
    for bad in (0, 4, 10):
        with pytest.raises(ValueError):
            k.acquire(bad, 9)


def test_feed(spark):
    v = spark.createDataFrame([("ada", 1, 1, "x"), ("bob", 2, 1, "y"), ("bob", 3, 0, None), ("cy", 4, 1, "z")], V)
    t = spark.createDataFrame([], R)
    assert [r[0] for r in feed.changes(v, t, 0, 3).collect()] == [1, 2, 3]
    assert feed.changes(v, t, 4).count() == 0
    with pytest.raises(txn.SnapshotTooOld):
        feed.changes(v, t, 0, retained=2)
    assert {r["key"] for r in feed.changes_latest(v, 0).collect()} == {"ada", "bob", "cy"}


def test_codecs_keep_order_and_round_trip(spark):
    rnd = random.Random(3)
    parts = [(bytes(rnd.choice(b"\x00\x01a\xff") for _ in range(rnd.randrange(4))), bytes(rnd.choice(b"\x00\xffb") for _ in range(rnd.randrange(3)))) for _ in range(200)]
    d = spark.createDataFrame(sorted(set(parts)), "a binary, b binary").withColumn("code", codec.tuple_key(F.col("a"), F.col("b")))
    got = d.withColumn("back", codec.tuple_parts(F.col("code"))).collect()
    assert all([bytes(x) for x in r["back"]] == [bytes(r["a"]), bytes(r["b"])] for r in got)
    by_code = sorted(got, key=lambda r: bytes(r["code"]))
    assert [(bytes(r["a"]), bytes(r["b"])) for r in by_code] == sorted(set(parts))
    k = spark.createDataFrame([(b"k\x00", 2**55 + 3, 1), (b"", 1, 0)], "key binary, seq long, kind int")
    for made, back in ((codec.internal_key, codec.internal_parts), (codec.prefix_free, codec.prefix_free_parts)):
        x = k.withColumn("p", back(made(F.col("key"), F.col("seq"), F.col("kind")))).collect()
        assert all((bytes(r["key"]), r["seq"], r["kind"]) == (bytes(r["p"]["key"]), r["p"]["seq"], r["p"]["kind"]) for r in x)


def test_small_codecs(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    data = [b"", b"a", b"foobar", bytes(range(256))]
    d = spark.createDataFrame([(x,) for x in data], "k binary")
    assert {bytes(r[0]): r[1] for r in d.select("k", codec.fnv1a(F.col("k"))).collect()} == {x: fnv(x) for x in data}
    r = spark.createDataFrame([(b"value", b"v1"), (b"", b"")], "value binary, version binary").withColumn("p", codec.fold_parts(codec.fold_record(F.col("value"), F.col("version")))).collect()
    assert all(bytes(x["p"]["value"]) == bytes(x["value"]) and bytes(x["p"]["version"]) == bytes(x["version"]) for x in r)
    n = spark.createDataFrame([(bytes([1, 2, 3, 4]),)], "d binary").select(codec.number(F.col("d"), 1, 2), codec.number(F.col("d"), 1, 4, little=True)).first()
    assert tuple(n) == (0x0102, 0x04030201)
    assert spark.range(1).select(codec.canonical(F.lit("\t ÄbC \n"))).first()[0] == "Äbc"


def ops(spark, *x):
    return spark.createDataFrame([(i, *o) for i, o in enumerate(x)], "pos long, cf string, op string, key string, value string")


def test_store(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    assert s.write(ops(spark, (None, "put", "a", "1"), (None, "put", "b", "2"), (None, "put", "c", "3"))) == 3
    assert s.write(ops(spark, (None, "delete_range", "b", "c"), (None, "delete_range", "x", "x"), (None, "put", "d", "4"))) == 5
    live = lambda seq=None, **o: {r["key"]: r["value"] for r in s.as_of(seq, **o).collect()}
    assert live() == {"a": "1", "c": "3", "d": "4"} and live(3) == {"a": "1", "b": "2", "c": "3"} and live(0) == {}
    with pytest.raises(KeyError):
        s.write(ops(spark, ("nope", "put", "a", "1")))
    s.create_family("other")
    s.write(ops(spark, ("other", "put", "a", "o")))
    assert s.as_of().where("cf = 'other'").count() == 1
    # a lost race: the manifest that the writer read is no longer the newest
    old = s.manifest()
    s.write(ops(spark, (None, "put", "e", "5")))
    with pytest.raises(Conflict):
        s.write(ops(spark, (None, "put", "e", "6")), base=old)
    assert live()["e"] == "5"
    # optimistic commits
    t = txn.Transaction(s.manifest()["last"])
    t.observe("a")
    t.put("f", "6")
    s.commit(t)
    late = txn.Transaction(3)
    late.observe("b")
    late.put("g", "7")
    with pytest.raises(Conflict):
        s.commit(late)
    # copies, GC, history
    s.write(ops(spark, (None, "put", "a", "1b")))
    c = s.checkpoint(str(tmp_path / "copy"))
    s.write(ops(spark, (None, "put", "a", "1c")))
    assert {r["value"] for r in c.as_of().where("key = 'a' and cf = 'default'").collect()} == {"1b"}
    before = live()
    s.compact()
    assert live() == before
    with pytest.raises(txn.SnapshotTooOld):
        s.as_of(3)
    assert live(3, archived=True) == {"a": "1", "b": "2", "c": "3"}
    s.seal()
    assert s.scrub() == [] and s.properties()["earliest_readable_sequence"] == s.manifest()["last"]
    s.drop_family("other")
    assert s.as_of().where("cf = 'other'").count() == 0


def test_restore_leaves_straddling_commit_out(spark):
    v = spark.createDataFrame([("default", "a", 1, 1, "1", 1)], "cf string, key string, seq long, kind int, value string, commit_id long")
    a = spark.createDataFrame([("default", "b", 2, 1, "2", 2), ("default", "c", 3, 1, "3", 3), ("default", "d", 4, 1, "4", 3)], v.schema)
    r = spark.createDataFrame([], "cf string, start string, end string, seq long, commit_id long")
    got, _ = Store.restore(v, r, (a, r), 1, 3)
    assert sorted(x["key"] for x in got.collect()) == ["a", "b"]


def test_streaming_fold_is_exactly_once(spark, tmp_path):
    source = str(tmp_path / "in")
    u = "seq long, op string, key string, value string"
    spark.createDataFrame([(1, "put", "a", "1"), (2, "put", "b", "2"), (3, "purge", "a", None)], u).coalesce(1).write.parquet(source)
    s = Store.open(spark, str(tmp_path / "db"))
    for _ in range(2):
        q = feed.fold_stream(spark.readStream.schema(u).parquet(source), s, checkpoint=str(tmp_path / "ck"))
        q.awaitTermination()
    s.fold(spark.createDataFrame([(2, "put", "b", "again"), (4, "put", "c", "4")], u))
    assert {r["key"]: r["value"] for r in s.as_of().collect()} == {"b": "2", "c": "4"}
    assert s.manifest()["cursors"] == {"default": {"default": 4}}


def test_gaps_in_small_blocks(spark):
    rnd = random.Random(4)
    rows_, want = [], {}
    for f in range(6):
        seqs = [s for s in range(1, 60) if rnd.random() > (0.02 if f % 2 else 0.0)]
        rows_ += [(f, s) for s in seqs + seqs[:5]]
        fresh = [s for s in seqs if s > 10]
        missing = [s for s in range(11, max(fresh)) if s not in fresh]
        want[f] = (len(seqs) + 5 - len(fresh), missing[0] if missing else None, max(fresh))
    d = spark.createDataFrame(rows_, "feed int, seq long")
    for block in (3, 4096):
        assert {r[0]: tuple(r[1:]) for r in feed.gaps(d, 10, block).collect()} == want


def test_percentiles_are_rows(spark):
    rnd = random.Random(5)
    data = {k: [rnd.choice([1, 2, 2.5, 7]) if k == "ties" else rnd.random() for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 999), ("ties", 500))}
    d = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "key string, value double")
    got = {r["key"]: (r["p500"], r["p990"]) for r in fold.nth(d, [0.5, 0.99], ["key"], rounded=True).collect()}
    assert got == {k: tuple(float(sorted(v)[int(p * (len(v) - 1) + 0.5)]) for p in (0.5, 0.99)) for k, v in data.items()}
    got = {r["key"]: r["p500"] for r in fold.nth(d, [0.5], ["key"], rounded=False).collect()}
    assert got == {k: float(sorted(v)[min(len(v) // 2, len(v) - 1)]) for k, v in data.items()}


def test_families_under_their_own_tombstones(spark, monkeypatch):
    v = spark.createDataFrame([(c, k, 1, 1, k) for c in ("x", "y") for k in "abcdef"], "cf string, key string, seq long, kind int, value string")
    t = spark.createDataFrame([("x", "b", "d", 2), ("x", "c", "e", 3), ("y", "e", "z", 2)], "cf string, start string, end string, seq long")
    want = [("x", "a"), ("x", "e"), ("x", "f"), ("y", "a"), ("y", "b"), ("y", "c"), ("y", "d")]
    for few in (2_000, 0):
        monkeypatch.setattr(reads, "FEW", few)
        assert rows(reads.visible(v, t, by=("cf", "key")).select("cf", "key"), "cf", "key") == want
