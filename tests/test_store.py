"""The store under races, torn manifests, older formats, and models of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import txn
from tidelog.operators import visible as reads
from tidelog.sources.store import RANGE, VERSION, Conflict, Store
from tidelog.streaming import feed

OPS = "pos long, cf string, op string, key string, value string"


def ops(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], OPS)


def live(s, seq=None, **o):
    return {(r["cf"], r["key"]): r["value"] for r in s.as_of(seq, **o).collect()}


def test_ranges_and_puts_of_a_transaction(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.write(ops(spark, (None, "put", "b", "0"), (None, "put", "c", "0")))
    t = txn.Transaction(2)
    t.delete_range("a", "z")
    t.put("b", "1")
    state = s.as_of().select("key", "value")
    seen = {r.key: r.value for r in txn.overlay(state, t.staged(spark), t.staged_ranges(spark)).collect()}
    s.commit(t)
    assert live(s) == {("default", "b"): "1"} and seen == {"b": "1"}


def test_savepoints():
    t = txn.Transaction(1)
    t.put("a", "1")
    t.savepoint()
    t.delete_range("a", "c")
    t.put("x", "2")
    t.observe("q")
    t.rollback_to_savepoint()
    assert t.writes == {"a": (1, "1")} and t.ranges == [] and t.reads == set()
    with pytest.raises(ValueError):
        t.rollback_to_savepoint()
    t.rollback()
    assert not t.writes


def test_torn_manifest(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.write(ops(spark, (None, "put", "a", "1")))
    for torn in ("", '{"format_version": 2, "n"'):
        (tmp_path / "s" / "manifest" / f"{s.manifest()['top'] + 1}.json").write_text(torn)
        assert live(s) == {("default", "a"): "1"}
    s.write(ops(spark, (None, "put", "b", "2")))
    assert live(s) == {("default", "a"): "1", ("default", "b"): "2"} and s.properties()["unreadable_manifests"] == 0
    assert len(s.repair()) == 2 and live(s, 1) == {("default", "a"): "1"}


def test_lost_race_leaves_no_trace(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    old = s.manifest()
    s.write(ops(spark, (None, "put", "a", "1")))
    with pytest.raises(Conflict):
        s.write(ops(spark, (None, "put", "a", "2")), base=old)
    assert live(s) == {("default", "a"): "1"} and len(s.leftovers()) == 1
    s.vacuum()
    assert s.leftovers() == [] and live(s) == {("default", "a"): "1"}


def test_options_and_operations(spark, tmp_path):
    with pytest.raises(KeyError):
        Store.open(spark, str(tmp_path / "x"), nonsense="1")
    s = Store.open(spark, str(tmp_path / "s"), compression="gzip", sync="true")
    with pytest.raises(ValueError, match="no operation"):
        s.write(ops(spark, (None, "nope", "a", "1")))
    s.put_same(spark.range(3).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("key")), "v")
    assert len(live(s)) == 3 and any(".gz" in r["file"] for r in s.files().collect())


def test_cursors(spark, tmp_path):
    s, u = Store.open(spark, str(tmp_path / "s")), "seq long, op string, key string, value string"
    s.create_family("y")
    s.fold(spark.createDataFrame([(100, "put", "a", "1"), (100, "put", "b", "1")], u))
    s.fold(spark.createDataFrame([(50, "put", "a", "2")], u), "y")
    s.fold(spark.createDataFrame([(60, "put", "c", "3")], u), source="other")
    s.fold(spark.createDataFrame([(100, "put", "a", "again")], u))
    assert live(s) == {("default", "a"): "1", ("default", "b"): "1", ("default", "c"): "3", ("y", "a"): "2"}


def test_model_with_compactions(spark, tmp_path):
    """Random commits and compactions of all kinds: what is live now, at every pin, and in the history never changes."""
    rnd, s, want, state = random.Random(5), Store.open(spark, str(tmp_path / "s")), {0: {}}, {}
    s.create_family("x")
    keys = [f"k{i:02}" for i in range(12)]
    for step in range(9):
        rows = []
        for _ in range(8):
            f, k = rnd.choice(["default", "x"]), rnd.choice(keys)
            roll = rnd.randrange(6)
            if roll < 3:
                rows.append((f, "put", k, str(rnd.random())))
                state[f, k] = rows[-1][3]
            elif roll < 5:
                rows.append((f, "delete", k, None))
                state.pop((f, k), None)
            else:
                hi = rnd.choice(keys)
                rows.append((f, "delete_range", k, hi))
                state = {(a, b): v for (a, b), v in state.items() if not (a == f and k <= b < hi)}
        last = s.write(ops(spark, *rows))
        want[last] = dict(state)
        if step % 3 == 1:
            s.compact(rnd.choice(sorted(want)[-2:]), family=rnd.choice([None, "x"]), start=rnd.choice([None, "k03"]), end=rnd.choice([None, "k09"]))
        if step == 6:
            s.compact(last)
            assert s.versions().count() == len(state) and s.tombstones().isEmpty()
    oldest = s.manifest()["oldest"]
    for seq, model in want.items():
        assert live(s, seq, archived=seq < oldest) == model, seq
    floor = sorted(want)[4]
    s.prune_history(floor)
    for seq, model in want.items():
        if seq >= floor:
            assert live(s, seq, archived=seq < oldest) == model, seq
        else:
            with pytest.raises(txn.SnapshotTooOld):
                s.as_of(seq, archived=True)


def test_migration(spark, tmp_path):
    """A store of the first format: folders without names of partitions, one cursor."""
    import json

    root = tmp_path / "old"
    v = spark.createDataFrame([("default", "a", 1, 1, "1", 1), ("x", "b", 2, 1, "2", 1)], VERSION)
    v.write.partitionBy("cf").parquet(f"{root}/data/1-abc")
    spark.createDataFrame([("x", "b", "c", 3, 2)], RANGE).write.parquet(f"{root}/ranges/2-def")
    (root / "manifest").mkdir()
    (root / "manifest" / "2.json").write_text(json.dumps({"format_version": 1, "n": 2, "last": 3, "oldest": 0, "families": ["default", "x"], "data": ["data/1-abc"], "ranges": ["ranges/2-def"], "history": [], "commits": [{"id": 1}, {"id": 2}], "cursor": "7"}))
    with pytest.raises(ValueError, match="format 1"):
        Store.open(spark, str(root)).as_of()
    assert not Store.inspect(spark, str(root))["current"]
    Store.migrate(spark, str(root))
    s = Store.open(spark, str(root))
    assert live(s) == {("default", "a"): "1"} and live(s, 2) == {("default", "a"): "1", ("x", "b"): "2"} and s.properties()["cursors"] == {"default": {"default": 7}}
    Store.migrate(spark, str(root))
    s.write(ops(spark, ("x", "put", "b", "3")))
    assert len(live(s)) == 2
    Store.destroy(spark, str(root))
    assert not root.exists()


def test_damage_is_found(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.write(ops(spark, *[(None, "put", f"k{i}", "v") for i in range(20)]))
    s.write(ops(spark, (None, "put", "z", "v")))
    s.seal()
    assert s.scrub() == []
    some = next((tmp_path / "s" / "data").glob("*/cf=default/*.parquet"))
    some.unlink()
    assert len(s.scrub()) == 1


def test_tail(spark, tmp_path):
    s, got = Store.open(spark, str(tmp_path / "s")), []
    for i in range(4):
        s.write(ops(spark, (None, "put", f"k{i}", "v"), (None, "delete_range", "a", "b")))
        if i % 2:
            q = feed.tail(s, lambda c, _: got.extend((r.seq, r.kind) for r in c.collect()), str(tmp_path / "ck"))
            q.awaitTermination()
    assert got == [(i, "put" if i % 2 else "delete_range") for i in range(1, 9)]


def test_many_ranges_of_keys(spark, monkeypatch):
    """As-of joins, orders, neighbours and pieces with more ranges than are looked up in one step."""
    monkeypatch.setattr(reads, "ROWS", 3)
    monkeypatch.setattr(reads, "MOST", 400)
    rnd = random.Random(2)
    keys = sorted(rnd.sample(range(10_000), 900))
    d = spark.createDataFrame([(f"{k:05}",) for k in keys], "key string")
    assert len(reads.cut_points(d)) > 200
    got = reads.neighbours(d).orderBy("key").collect()
    names = [f"{k:05}" for k in keys]
    assert [(r.key, r.prev_key, r.next_key) for r in got] == list(zip(names, [None, *names[:-1]], [*names[1:], None], strict=True))
    assert [r.n for r in reads.ordered(d, ["key"]).orderBy("key").collect()] == list(range(1, 901))
    t = [(rnd.randrange(1000), rnd.randrange(1, 200), s) for s in range(300)]
    pieces = reads.fragments(spark.createDataFrame([(f"{a:05}", f"{a + n:05}", s) for a, n, s in t], "start string, end string, seq long")).collect()
    cover = {}
    for p in pieces:
        for x in range(int(p.start), int(p.end)):
            assert x not in cover
            cover[x] = p.seq
    assert cover == {x: max(s for a, n, s in t if a <= x < a + n) for x in range(1300) if any(a <= x < a + n for a, n, _ in t)}
