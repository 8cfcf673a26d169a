"""Queries that write a store in the shared folder and read it back, with the same results as SQL over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visible as reads
from ..operators.txn import Transaction
from ..sources.shared import new_path
from ..sources.store import Store
from . import log as L
from .queries import query

_OP = "CASE kind WHEN 0 THEN 'delete' WHEN 1 THEN 'put' ELSE 'delete_range' END"


def _ops(spark: SparkSession, sf: str, family: str = "'default'") -> DataFrame:
    """The log as operations; its sequences have no holes, so the store gives the same ones."""
    return L.log(spark, sf).select(F.col("seq").alias("pos"), F.expr(family).alias("cf"), F.expr(_OP).alias("op"), "key", F.when(F.col("kind") == 2, F.col("end_key")).otherwise(F.col("value")).alias("value"))


def _store(spark: SparkSession, name: str, **options: str) -> Store:
    return Store.open(spark, new_path(spark, f"store-{name}"), **options)


def _written(spark: SparkSession, sf: str, name: str, family: str = "'default'", families: tuple[str, ...] = (), parts: int = 3) -> Store:
    s, last = _store(spark, name), L.last_sequence(spark, sf)
    for f in families:
        s.create_family(f)
    ops = _ops(spark, sf, family)
    for i in range(parts):
        s.write(ops.where((F.col("pos") > last * i // parts) & (F.col("pos") <= last * (i + 1) // parts)))
    return s


@query("SELECT key, seq, value FROM vis")
def store_batch(spark, sf):
    """The log written in three commits, read at the snapshot."""
    return _written(spark, sf, "batch").as_of(L.snapshot(spark, sf)).select("key", "seq", "value")


_LAST_SQL = """
, nl AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log WHERE kind <> 2 GROUP BY key),
live AS (SELECT key, seq, value FROM nl WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.key <= nl.key AND nl.key < t.end_key AND t.seq > nl.seq))"""


@query(_LAST_SQL + " SELECT key, value FROM live WHERE NOT (key >= 'u/000010' AND key < 'u/000040') AND key <> 'u/000100' UNION ALL SELECT unnest(['u/000020', 'u/000100']), unnest(['inside', 'outside'])")
def store_range_delete(spark, sf):
    """A transaction that deletes a range and then puts a key inside it: the put stays."""
    s = _written(spark, sf, "range", parts=1)
    t = Transaction(s.manifest()["last"])
    t.put("u/000015", "gone")
    t.delete_range("u/000010", "u/000040")
    t.put("u/000020", "inside")
    t.put("u/000100", "outside")
    s.commit(t)
    return s.as_of().select("key", "value")


@query("SELECT c_name AS key, row_number() OVER (ORDER BY c_name) AS seq, c_mktsegment AS value FROM customer", log=False)
def store_ingest(spark, sf):
    """External rows in one commit, sequences in key order."""
    s = _store(spark, "ingest")
    s.ingest(L.table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")))
    return s.as_of().select("key", "seq", "value")


@query("""
, v AS (SELECT key, seq, kind, value, max(seq) FILTER (seq <= s) OVER (PARTITION BY key) AS top, count(*) FILTER (seq > s) OVER (PARTITION BY key) AS above FROM log, p WHERE kind <> 2)
SELECT key, seq, kind, value FROM v, p WHERE seq > s OR seq = top AND NOT (kind = 0 AND above = 0) AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= s AND t.key <= v.key AND v.key < t.end_key AND t.seq > v.seq)""")
def store_compact(spark, sf):
    """What a compaction with the oldest pin at the snapshot leaves: covered rows are gone, and so are the tombstones that covered them."""
    s = _written(spark, sf, "compact")
    s.compact(L.snapshot(spark, sf))
    assert s.tombstones().where(F.col("seq") <= L.snapshot(spark, sf)).isEmpty()
    return s.versions().select("key", "seq", "kind", "value")


@query("""
, v AS (SELECT key, seq, kind, value, max(seq) FILTER (seq <= s) OVER (PARTITION BY key) AS top FROM log, p WHERE kind <> 2)
SELECT key, seq, kind, value FROM v, p WHERE NOT (key >= 'u/000030' AND key < 'u/000090') OR seq > s OR seq = top AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= s AND t.key <= v.key AND v.key < t.end_key AND t.seq > v.seq) AND NOT (kind = 0 AND NOT EXISTS (SELECT 1 FROM log o WHERE o.kind <> 2 AND o.key = v.key AND o.seq > s))""")
def store_compact_range(spark, sf):
    """Only one range of keys is rewritten; the rest stays as it was."""
    s = _written(spark, sf, "part")
    s.compact(L.snapshot(spark, sf), start="u/000030", end="u/000090")
    return s.versions().select("key", "seq", "kind", "value")


@query("""
, o AS (SELECT last * 3 // 10 AS o FROM p), m AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log, o WHERE kind <> 2 AND seq <= o GROUP BY key)
SELECT key, value FROM m, o WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= o AND t.key <= m.key AND m.key < t.end_key AND t.seq > m.seq)""")
def store_history(spark, sf):
    """A read below the oldest pin after two compactions and a pruned history, whose floor lies below it."""
    s, last = _written(spark, sf, "history"), L.last_sequence(spark, sf)
    s.compact(last // 2)
    s.compact(last * 8 // 10)
    s.prune_history(last * 2 // 10)
    return s.as_of(last * 3 // 10, archived=True).select("key", "value")


@query("""
, a AS (SELECT 'one' AS cf, key, arg_max(value, seq) AS value, arg_max(kind, seq) AS kind FROM log WHERE kind <> 2 GROUP BY key),
b AS (SELECT 'two' AS cf, key, arg_max(value, seq) AS value, arg_max(kind, seq) AS kind FROM log, p WHERE kind <> 2 AND seq <= s // 2 GROUP BY key)
SELECT cf, key, value FROM a WHERE kind = 1 UNION ALL SELECT cf, key, value FROM b WHERE kind = 1""")
def store_fold(spark, sf):
    """Two sources folded into two families in batches that overlap; each has its own cursor, so the later and lower one loses nothing."""
    s, cut = _store(spark, "fold"), L.snapshot(spark, sf)
    s.create_family("one")
    s.create_family("two")
    u = L.versions(spark, sf).select("seq", F.when(F.col("kind") == 1, "put").otherwise("purge").alias("op"), "key", "value")
    for family, steps in (("one", (cut, None)), ("two", (cut // 2,))):
        for upto in steps:
            s.fold(u if upto is None else u.where(F.col("seq") <= upto), family, f"feed-{family}")
    s.fold(u.where(F.col("seq") <= cut), "one", "feed-one")
    return s.as_of().select("cf", "key", "value")


@query("""
, c AS (SELECT *, CASE WHEN seq <= last // 3 THEN 1 WHEN seq <= last * 2 // 3 THEN 2 ELSE 3 END AS part FROM log, p),
m AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM c WHERE kind <> 2 AND part <= 2 GROUP BY key)
SELECT key, seq, value FROM m WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM c t WHERE t.kind = 2 AND t.part <= 2 AND t.key <= m.key AND m.key < t.end_key AND t.seq > m.seq)""")
def store_restore(spark, sf):
    """A checkpoint after the first commit, the rest shipped twice, and a restore to the middle of the third commit: that is left out whole."""
    s, last = _store(spark, "restore"), L.last_sequence(spark, sf)
    ops, archive = _ops(spark, sf), new_path(spark, "archive")
    s.write(ops.where(F.col("pos") <= last // 3))
    copy = s.checkpoint(new_path(spark, "copy"))
    for i in (1, 2):
        s.write(ops.where((F.col("pos") > last * i // 3) & (F.col("pos") <= last * (i + 1) // 3)))
        s.ship(archive)
        s.ship(archive)
    v, t = Store.restore(copy.versions(), copy.tombstones(), Store.read_archive(spark, archive), last // 3, last * 2 // 3 + 5)
    return reads.visible(v, t).select("key", "seq", "value")


@query("""
, x AS (SELECT *, 'f' || (CAST(substr(key, 3) AS INT) % 3) AS f FROM log), m AS (SELECT f, key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM x WHERE kind <> 2 AND f <> 'f1' GROUP BY f, key)
SELECT f AS cf, key, value FROM m WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM x t WHERE t.kind = 2 AND t.f = m.f AND t.key <= m.key AND m.key < t.end_key AND t.seq > m.seq) UNION ALL SELECT 'f1', 'again', 'new'""")
def store_families(spark, sf):
    """Families with puts, deletes and range deletes of their own; one is dropped and made again, and begins empty."""
    s = _written(spark, sf, "families", "concat('f', CAST(substr(key, 3) AS INT) % 3)", ("f0", "f1", "f2"))
    s.drop_family("f1")
    s.create_family("f1")
    s.write(spark.createDataFrame([(1, "f1", "put", "again", "new")], "pos long, cf string, op string, key string, value string"))
    return s.as_of().select("cf", "key", "value")


@query("""
, m AS (SELECT seq, key, CASE WHEN cf = 'error' THEN 0 WHEN cf = 'purchase' THEN 1 ELSE 3 END AS kind, CASE WHEN cf <> 'error' THEN cf END AS value FROM log WHERE kind <> 2),
c AS (SELECT m.*, (SELECT max(t.seq) FROM log t WHERE t.kind = 2 AND t.key <= m.key AND m.key < t.end_key) AS cut FROM m),
d AS (SELECT * FROM c WHERE cut IS NULL OR seq > cut), b AS (SELECT key, max(seq) FILTER (kind <> 3) AS base FROM d GROUP BY key)
SELECT d.key, max(d.seq) AS seq, string_agg(d.value, '+' ORDER BY d.seq) AS value FROM d JOIN b USING (key) WHERE (base IS NULL OR d.seq >= base) AND d.kind <> 0 GROUP BY d.key""")
def store_merge(spark, sf):
    """Merge operands written as such, folded when read, also after a compaction that keeps what they need."""
    s = _store(spark, "merge", separator="+")
    x = L.log(spark, sf).select(F.col("seq").alias("pos"), F.lit("default").alias("cf"), F.expr("CASE WHEN kind = 2 THEN 'delete_range' WHEN cf = 'error' THEN 'delete' WHEN cf = 'purchase' THEN 'put' ELSE 'merge' END").alias("op"), "key", F.expr("CASE WHEN kind = 2 THEN end_key ELSE cf END").alias("value"))
    half = L.last_sequence(spark, sf) // 2
    s.write(x.where(F.col("pos") <= half))
    s.compact(half // 2)
    s.write(x.where(F.col("pos") > half))
    return s.as_of().select("key", "seq", "value")


@query("SELECT 'live' AS part, count(*) AS n FROM log WHERE kind <> 2 UNION ALL SELECT 'tombstones', count(*) FROM log WHERE kind = 2 UNION ALL SELECT 'damaged', 0 UNION ALL SELECT 'backups', 1 UNION ALL SELECT 'verified', 1")
def store_scrub(spark, sf):
    """Checksums sealed and scrubbed, and a catalogue of two backups of which one is purged and one verified."""
    s, root = _written(spark, sf, "scrub"), new_path(spark, "backups")
    s.seal()
    damaged = len(s.scrub())
    s.backup(root)
    n = s.backup(root)
    Store.purge_backups(spark, root, 1)
    counts = [("damaged", damaged), ("backups", len(Store.backups(spark, root))), ("verified", int(Store.verify_backup(spark, root, n)))]
    v, t = s.log()
    rows = spark.createDataFrame(counts, "part string, n long")
    for part, x in (("live", v), ("tombstones", t)):
        rows = rows.unionByName(x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n"))
    return rows
