"""Named queries over the fixtures, each with the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import compact, fold, hops, txn
from ..operators import visible as reads
from ..streaming import feed
from . import log as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, log: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {L.SQL} {sql}" if log else sql
        return f

    return add


def state(spark: SparkSession, sf: str, values: bool = True) -> DataFrame:
    return reads.visible(L.versions(spark, sf), L.tombstones(spark, sf), L.snapshot(spark, sf), values=values)


# Point reads


@query("SELECT key, seq, value FROM vis")
def visible_state(spark, sf):
    """Live keys at a snapshot under puts, deletes and range deletes."""
    return state(spark, sf)


@query("""
, k AS (SELECT event_id AS pos, 'u/' || lpad(CAST(user_id * 7 % 400 AS VARCHAR), 6, '0') AS key FROM events)
SELECT k.pos, k.key, CASE WHEN v.key IS NOT NULL THEN 'found' WHEN n.key IS NOT NULL THEN 'deleted' ELSE 'not_found' END AS state, v.value
FROM k LEFT JOIN n ON n.key = k.key LEFT JOIN vis v ON v.key = k.key""")
def multi_get(spark, sf):
    """A batch of keys with repeats and misses; three-valued answers at one snapshot."""
    keys = L.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("u/"), F.lpad((F.col("user_id") * 7 % 400).cast("string"), 6, "0")).alias("key"))
    return reads.lookup(keys, L.versions(spark, sf), L.tombstones(spark, sf), L.snapshot(spark, sf))


@query("""
, s AS (SELECT last * t // 10 AS snap FROM p, (VALUES (0), (2), (5), (10)) v(t)),
m AS (SELECT snap, key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log, s WHERE kind <> 2 AND seq <= snap GROUP BY snap, key)
SELECT snap, key, value FROM m WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= snap AND t.key <= m.key AND m.key < t.end_key AND t.seq > m.seq)""")
def get_at_snapshots(spark, sf):
    """The same keys at several snapshots; snapshot 0 is empty."""
    last = L.last_sequence(spark, sf)
    out = None
    for t in (0, 2, 5, 10):
        x = reads.visible(L.versions(spark, sf), L.tombstones(spark, sf), last * t // 10).select(F.lit(last * t // 10).cast("long").alias("snap"), "key", "value")
        out = x if out is None else out.unionByName(x)
    return out


@query("""
, m AS (SELECT cf, key, max(seq) AS seq, arg_max(value, seq) AS value FROM log, p WHERE seq <= s GROUP BY cf, key)
SELECT cf, key, seq, value FROM m WHERE cf IN ('click', 'view', 'purchase')""")
def multi_get_families(spark, sf):
    """Newest value of each key in each of several families (the event types), one snapshot for all."""
    x = L.log(spark, sf).where(F.col("cf").isin("click", "view", "purchase"))
    return reads.newest(x.where("kind = 1"), L.snapshot(spark, sf), ("cf", "key")).select("cf", "key", "seq", "value")


@query("""
, k AS (SELECT DISTINCT 'u/' || lpad(CAST(user_id * 7 % 400 AS VARCHAR), 6, '0') AS key FROM events)
SELECT key, key IN (SELECT key FROM vis) AS present FROM k""")
def exists_keys(spark, sf):
    keys = L.table(spark, sf, "events").select(F.concat(F.lit("u/"), F.lpad((F.col("user_id") * 7 % 400).cast("string"), 6, "0")).alias("key")).distinct()
    s = state(spark, sf, values=False).select("key")
    return keys.join(s, "key", "left_semi").withColumn("present", F.lit(True)).unionByName(keys.join(s, "key", "left_anti").withColumn("present", F.lit(False)))


@query("SELECT conv_id AS prefix, max(turn) AS turn, arg_max(text, turn) AS text FROM (SELECT DISTINCT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id, turn ORDER BY text) AS text FROM conversations) GROUP BY conv_id", log=False)
def last_under_prefix(spark, sf):
    """Greatest key under each prefix and its value: the last turn of each conversation."""
    c = L.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return c.groupBy(F.col("conv_id").alias("prefix")).agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query("""
, w AS (SELECT key, max(lpad(CAST(seq AS VARCHAR), 12, '0')) AS ts FROM log WHERE cf = 'click' GROUP BY key)
SELECT w.key, w.ts, l.value FROM w JOIN log l ON l.key = w.key AND lpad(CAST(l.seq AS VARCHAR), 12, '0') = w.ts""")
def last_prefix_then_get(spark, sf):
    """Newest row under a user's prefix in one family, then the value of that key in another."""
    x = L.log(spark, sf)
    keys = x.where("cf = 'click'").select("key", F.lpad(F.col("seq").cast("string"), 12, "0").alias("ts"))
    top = keys.groupBy("key").agg(F.max("ts").alias("ts"))
    return top.join(x.select("key", F.lpad(F.col("seq").cast("string"), 12, "0").alias("ts"), "value"), ["key", "ts"]).select("key", "ts", "value")


# Scans


@query("SELECT key, seq, value FROM vis WHERE key > 'u/000010' AND key <= 'u/000060'")
def range_scan(spark, sf):
    return reads.scan(state(spark, sf), reads.bounds("u/000010", "u/000060", lo_open=True, hi_open=False))


@query("SELECT key, seq, value FROM vis WHERE key >= 'u/000005' ORDER BY key LIMIT 25")
def range_scan_limit(spark, sf):
    """The limit counts live keys."""
    return reads.scan(state(spark, sf), reads.bounds("u/000005"), limit=25)


@query("SELECT key, seq, value FROM vis WHERE starts_with(key, 'u/00004')")
def prefix_scan(spark, sf):
    return reads.scan(state(spark, sf), reads.prefix_bounds("u/00004"))


@query("SELECT key FROM vis")
def key_only_scan(spark, sf):
    """Keys without values: the value columns are not read from Parquet."""
    return reads.scan(state(spark, sf, values=False), keys_only=True)


@query("SELECT key, seq, value FROM vis WHERE key <= 'u/000090' ORDER BY key DESC LIMIT 20")
def reverse_scan(spark, sf):
    return reads.scan(state(spark, sf), reads.bounds(hi="u/000090", hi_open=False), reverse=True, limit=20)


@query("""
, k AS (SELECT DISTINCT 'u/' || lpad(CAST(user_id * 3 AS VARCHAR), 6, '0') AS key FROM events)
SELECT k.key, (SELECT min(v.key) FROM vis v WHERE v.key >= k.key) AS at_or_after, (SELECT max(v.key) FROM vis v WHERE v.key <= k.key) AS at_or_before FROM k""")
def seek_batch(spark, sf):
    """Seek and seek-for-prev of many keys at once, as as-of joins."""
    s = state(spark, sf, values=False).select("key", F.col("key").alias("value"))
    keys = L.table(spark, sf, "events").select(F.concat(F.lit("u/"), F.lpad((F.col("user_id") * 3).cast("string"), 6, "0")).alias("key")).distinct()
    after = reads.as_of(keys, s, forward=True).withColumnRenamed("value", "at_or_after")
    return after.join(reads.as_of(keys, s).withColumnRenamed("value", "at_or_before"), "key")


@query("SELECT key, lag(key) OVER (PARTITION BY substr(key, 1, 7) ORDER BY key) AS prev_key, lead(key) OVER (PARTITION BY substr(key, 1, 7) ORDER BY key) AS next_key FROM vis")
def neighbours(spark, sf):
    """Previous and next live key under the same prefix."""
    return reads.neighbours(state(spark, sf, values=False), [F.substring("key", 1, 7)])


@query("""
, r AS (SELECT event_id AS id, 'u/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS lo, 'u/' || lpad(CAST(user_id + 25 AS VARCHAR), 6, '0') AS hi FROM events)
SELECT id, least(count(v.key), 16) AS n FROM r LEFT JOIN vis v ON v.key >= r.lo AND v.key < r.hi GROUP BY id""")
def count_ranges(spark, sf):
    """Live keys in many half-open windows, each count capped."""
    r = L.table(spark, sf, "events").select(F.col("event_id").alias("id"), L.user_key("user_id").alias("lo"), L.user_key("user_id", 25).alias("hi"))
    return reads.count_ranges(r, state(spark, sf, values=False), cap=16)


@query("SELECT substr(key, 1, 7) AS prefix, min(key) AS first_key, count(*) AS n FROM vis GROUP BY 1")
def prefix_extract(spark, sf):
    return state(spark, sf, values=False).groupBy(F.substring("key", 1, 7).alias("prefix")).agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n"))


@query("""
, f AS (SELECT key AS row_key, kind AS column_id, seq // 500 AS seq, max(value) AS value FROM log GROUP BY 1, 2, 3),
b AS (SELECT row_key, column_id, max(seq) AS seq, arg_max(value, seq) AS value FROM f WHERE seq <= 10 AND column_id IN (0, 1) GROUP BY 1, 2)
SELECT row_key, min(seq) AS seq, max(CASE WHEN column_id = 0 THEN value END) AS c0, max(CASE WHEN column_id = 1 THEN value END) AS c1 FROM b GROUP BY row_key HAVING count(*) = 2 AND min(seq) = max(seq)""")
def sparse_projection(spark, sf):
    """Rows whose wanted columns are all there with one sequence."""
    f = L.log(spark, sf).groupBy(F.col("key").alias("row_key"), F.col("kind").alias("column_id"), F.floor(F.col("seq") / 500).alias("seq")).agg(F.max("value").alias("value"))
    return reads.sparse_row(f, [0, 1], 10)


@query("""
, o AS (SELECT row_number() OVER (ORDER BY key, seq DESC) AS pos, key, seq, (seq // 100) AS commit_id FROM log, p WHERE seq <= s + 50),
x AS (SELECT *, lag(key) OVER (ORDER BY pos) AS before FROM o)
SELECT count(*) FILTER (key < before) AS disorder, count(*) FILTER (key = before) AS repeats, count(*) FILTER (seq > s) AS future FROM x, p""")
def scan_validation(spark, sf):
    """Faults of a delivered scan: order, repeats, rows of the future."""
    s = L.snapshot(spark, sf)
    x = L.log(spark, sf).where(F.col("seq") <= s + 50).repartitionByRange("key").withColumn("part", F.spark_partition_id())
    rows = x.select("part", F.row_number().over(Window.partitionBy("part").orderBy("key", F.col("seq").desc())).alias("pos"), "key", "seq", F.floor(F.col("seq") / 100).alias("commit_id"))
    return reads.scan_faults(rows, s)


# Mutations and transactions

_STAGED_SQL = """
, st AS (SELECT 'u/' || lpad(CAST(user_id * 2 AS VARCHAR), 6, '0') AS key, arg_max(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, event_id) AS kind, arg_max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'staged:' || event_id END, event_id + 0) AS v0, max(event_id) AS e FROM events GROUP BY 1),
staged AS (SELECT key, kind, CASE WHEN kind = 1 THEN 'staged:' || e END AS value FROM st),
over AS (SELECT key, value FROM vis WHERE key NOT IN (SELECT key FROM staged) UNION ALL SELECT key, value FROM staged WHERE kind = 1)"""


def staged(spark, sf):
    e = L.table(spark, sf, "events").groupBy(F.concat(F.lit("u/"), F.lpad((F.col("user_id") * 2).cast("string"), 6, "0")).alias("key")).agg(F.max("event_id").alias("e"))
    return e.select("key", F.when(F.col("e") % 3 == 0, 0).otherwise(1).alias("kind"), F.when(F.col("e") % 3 != 0, F.concat(F.lit("staged:"), F.col("e").cast("string"))).alias("value"))


@query(_STAGED_SQL + " SELECT key, value FROM over")
def txn_overlay(spark, sf):
    """A transaction's view: staged puts shown, staged deletes hidden."""
    return txn.overlay(state(spark, sf), staged(spark, sf))


@query(_STAGED_SQL + " SELECT least(count(*), 40) AS n FROM over WHERE key >= 'u/000010' AND key < 'u/000200'")
def txn_scan_count(spark, sf):
    """Overlay first, then the capped count."""
    x = txn.overlay(state(spark, sf), staged(spark, sf)).where(reads.bounds("u/000010", "u/000200"))
    return x.agg(F.least(F.count(F.lit(1)), F.lit(40)).alias("n"))


@query(_STAGED_SQL + " SELECT key, kind = 1 AND key NOT IN (SELECT key FROM vis) AS inserted FROM staged WHERE kind = 1")
def put_if_absent(spark, sf):
    new, refused = txn.insert_if_absent(state(spark, sf), staged(spark, sf).where("kind = 1"))
    return new.select("key", F.lit(True).alias("inserted")).unionByName(refused.select("key", F.lit(False).alias("inserted")))


@query(_STAGED_SQL + " SELECT t.key, t.expected, v.value IS NOT DISTINCT FROM t.expected AS swapped FROM (SELECT key, CASE WHEN kind = 1 THEN arg_max_v END AS expected FROM (SELECT s.key, s.kind, (SELECT value FROM vis WHERE vis.key = s.key AND vis.seq % 2 = 0) AS arg_max_v FROM staged s)) t LEFT JOIN vis v ON v.key = t.key")
def compare_and_swap(spark, sf):
    s = state(spark, sf)
    even = s.where("seq % 2 = 0").select("key", F.col("value").alias("even"))
    rows = staged(spark, sf).join(even, "key", "left").select("key", F.when(F.col("kind") == 1, F.col("even")).alias("expected"))
    return txn.swap_if_equal(s, rows)


_TXNS_SQL = """
, tx AS (SELECT event_id AS tx_id, event_id + 1 - 40 - (event_id % 60) AS snapshot_seq, event_id + 1 AS commit_seq,
  ['u/' || lpad(CAST(user_id AS VARCHAR), 6, '0'), 'u/' || lpad(CAST((user_id * 5 + 1) % 151 AS VARCHAR), 6, '0')] AS reads,
  ['u/' || lpad(CAST((user_id * 3 + 2) % 151 AS VARCHAR), 6, '0')] AS writes FROM events)"""


def txns(spark, sf):
    k = lambda e: F.concat(F.lit("u/"), F.lpad(F.expr(e).cast("string"), 6, "0"))
    e = L.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("tx_id"), F.expr("event_id + 1 - 40 - (event_id % 60)").alias("snapshot_seq"), F.expr("event_id + 1").alias("commit_seq"), F.array(k("user_id"), k("(user_id * 5 + 1) % 151")).alias("reads"), F.array(k("(user_id * 3 + 2) % 151")).alias("writes"))


@query(_TXNS_SQL + """,
t AS (SELECT tx_id, snapshot_seq, unnest(list_concat(reads, writes)) AS key FROM tx)
SELECT tx.tx_id, CASE WHEN snapshot_seq < 500 THEN 'too_old' WHEN tx_id IN (SELECT t.tx_id FROM t JOIN log l ON l.kind <> 2 AND l.key = t.key AND l.seq > t.snapshot_seq)
  OR tx_id IN (SELECT t.tx_id FROM t JOIN log l ON l.kind = 2 AND l.key <= t.key AND t.key < l.end_key AND l.seq > t.snapshot_seq) THEN 'conflict' ELSE 'commit' END AS fate FROM tx""")
def occ_validate(spark, sf):
    """Fate of many optimistic transactions against one log."""
    return txn.validate(txns(spark, sf), L.versions(spark, sf), L.tombstones(spark, sf), 500)


_ALL_EDGES_SQL = _TXNS_SQL + """,
rd AS (SELECT tx_id, snapshot_seq, unnest(reads) AS key FROM tx), wr AS (SELECT tx_id, commit_seq, unnest(writes) AS key FROM tx),
e AS (SELECT DISTINCT rd.tx_id AS reader, wr.tx_id AS writer FROM rd JOIN wr USING (key) WHERE rd.tx_id <> wr.tx_id AND commit_seq > snapshot_seq)"""


@query(_TXNS_SQL + """,
rd AS (SELECT tx_id, snapshot_seq AS rs, commit_seq AS rc, unnest(reads) AS key FROM tx), wr AS (SELECT tx_id, snapshot_seq AS ws, commit_seq AS wc, unnest(writes) AS key FROM tx)
SELECT DISTINCT rd.tx_id AS reader, wr.tx_id AS writer FROM rd JOIN wr USING (key) WHERE rd.tx_id <> wr.tx_id AND wc > rs AND ws < rc""")
def conflict_edges(spark, sf):
    """Conflicts of transactions that overlap: each began before the other committed. `conflict_edges_all` has those with later writers too."""
    return txn.concurrent_edges(txns(spark, sf))


@query(_ALL_EDGES_SQL + " SELECT reader, writer FROM e")
def conflict_edges_all(spark, sf):
    """Every conflict: a key read by one transaction and written by another after the reader's snapshot, however much later."""
    return txn.conflict_edges(txns(spark, sf))


@query(_TXNS_SQL + """,
rd AS (SELECT tx_id, snapshot_seq AS s, commit_seq AS c, unnest(reads) AS key FROM tx), wr AS (SELECT tx_id, snapshot_seq AS s, commit_seq AS c, unnest(writes) AS key FROM tx),
i AS (SELECT DISTINCT wr.tx_id, rd.tx_id AS o FROM wr JOIN rd USING (key) WHERE wr.tx_id <> rd.tx_id AND rd.s < wr.c AND rd.c > wr.c),
u AS (SELECT DISTINCT rd.tx_id, wr.tx_id AS o FROM rd JOIN wr USING (key) WHERE wr.tx_id <> rd.tx_id AND wr.s < rd.c AND wr.c > rd.c),
g AS (SELECT tx_id, count(*) FILTER (side = 1) AS n_in, count(*) FILTER (side = 2) AS n_out FROM (SELECT *, 1 AS side FROM i UNION ALL SELECT *, 2 AS side FROM u) GROUP BY tx_id)
SELECT tx_id, n_in, n_out, CASE WHEN tx_id IN (SELECT i.tx_id FROM i JOIN u ON i.tx_id = u.tx_id AND i.o = u.o) THEN 'cycle' WHEN n_in > 0 AND n_out > 0 THEN 'structure' ELSE 'safe' END AS fate FROM g""")
def dangerous_structures(spark, sf):
    """Each transaction at its commit against those still active: conflicts in and out, and whether they make a cycle or a dangerous structure."""
    return txn.commit_dangers(txns(spark, sf))


@query()
def serialization_cycles(spark, sf):
    """Transactions on a cycle of conflicts of overlapping ones, by their own ids. SQL would need all paths; the tests compare a small log with them."""
    return txn.on_cycle(txn.concurrent_edges(txns(spark, sf)).select(F.col("reader").alias("a"), F.col("writer").alias("b")))


@query()
def transaction_cycles(spark, sf):
    """Transactions on a cycle of conflicts, each by its own id, over every conflict. SQL would need all paths; the tests compare a small log with them."""
    return txn.on_conflict_cycle(txns(spark, sf))


@query("""
, c AS (SELECT event_id AS tx_id, [greatest(event_id - 1, 0), greatest(event_id - (user_id % 9) - 1, 0)] AS deps FROM events), r AS (SELECT event_id AS tx_id FROM events WHERE event_id % 11 <> 3)
SELECT tx_id, dep FROM (SELECT tx_id, unnest(deps) AS dep FROM c WHERE tx_id IN (SELECT tx_id FROM r)) WHERE dep NOT IN (SELECT tx_id FROM r)""")
def causal_closure(spark, sf):
    """Dependencies of recovered transactions that are missing."""
    e = L.table(spark, sf, "events").select("event_id", "user_id")
    c = e.select(F.col("event_id").alias("tx_id"), F.array(F.expr("greatest(event_id - 1, 0)"), F.expr("greatest(event_id - (user_id % 9) - 1, 0)")).alias("deps"))
    return txn.missing_causes(c, e.where("event_id % 11 <> 3").select(F.col("event_id").alias("tx_id")))


@query("""
, c AS (SELECT o_orderkey AS tx_id, CASE o_orderkey % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'preparing' WHEN 2 THEN 'aborted' ELSE 'init' END AS state FROM orders WHERE o_orderkey % 5 <> 0),
q AS (SELECT l_orderkey AS tx_id, l_linenumber AS node, CASE WHEN l_orderkey % 4 = 0 AND l_partkey % 50 <> 0 THEN 'committed' WHEN l_partkey % 97 = 0 THEN 'unprepared' WHEN l_partkey % 50 = 1 THEN 'committed' ELSE 'prepared' END AS state FROM lineitem),
g AS (SELECT tx_id, count(*) FILTER (state = 'committed') AS c, count(*) FILTER (state = 'aborted') AS a, count(*) FILTER (state = 'unprepared') AS u FROM q GROUP BY tx_id)
SELECT coalesce(c.tx_id, g.tx_id) AS tx_id, CASE WHEN c.state = 'committed' THEN 'commit' ELSE 'abort' END AS outcome,
  coalesce(CASE WHEN c.state = 'committed' THEN g.a > 0 OR g.u > 0 ELSE g.c > 0 END, false) AS violation FROM c FULL JOIN g ON c.tx_id = g.tx_id""")
def two_phase_outcomes(spark, sf):
    o, li = L.table(spark, sf, "orders"), L.table(spark, sf, "lineitem")
    c = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("tx_id"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'preparing' WHEN 2 THEN 'aborted' ELSE 'init' END").alias("state"))
    q = li.select(F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").alias("node"), F.expr("CASE WHEN l_orderkey % 4 = 0 AND l_partkey % 50 <> 0 THEN 'committed' WHEN l_partkey % 97 = 0 THEN 'unprepared' WHEN l_partkey % 50 = 1 THEN 'committed' ELSE 'prepared' END").alias("state"))
    return txn.two_phase(c, q)


@query("""
, o AS (SELECT event_id // 20 AS batch, user_id AS pk, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'index' END AS target, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'add' END AS op FROM events),
g AS (SELECT batch, pk, count(*) FILTER (target = 'primary' AND op = 'add') AS pa, count(*) FILTER (target = 'primary' AND op = 'delete') AS pd, count(*) FILTER (target = 'index' AND op = 'add') AS ia, count(*) FILTER (target = 'index' AND op = 'delete') AS idd FROM o GROUP BY batch, pk),
f AS (SELECT batch, pk, CASE WHEN pa + pd = 0 AND ia + idd > 0 THEN 'orphan_index' WHEN pd > 0 AND idd = 0 THEN 'index_left' WHEN pa > 0 AND ia = 0 THEN 'index_missing' END AS fault FROM g)
SELECT batch, pk, fault FROM f WHERE fault IS NOT NULL""")
def index_entailment(spark, sf):
    """Batches whose index operations don't match their primary rows."""
    e = L.table(spark, sf, "events")
    ops = e.select(F.floor(F.col("event_id") / 20).alias("batch"), F.col("user_id").alias("pk"), F.when(F.col("event_id") % 2 == 0, "primary").otherwise("index").alias("target"), F.when(F.col("event_id") % 3 == 0, "delete").otherwise("add").alias("op"))
    return txn.index_faults(ops)


@query(", g AS (SELECT event_id AS pin_id, event_id + 1 AS seq, event_id // 100 AS ce, user_id % 7 AS lease FROM events) SELECT min(seq) AS min_seq, count(*) AS active FROM g WHERE 50 <= ce + lease")
def pin_leases(spark, sf):
    e = L.table(spark, sf, "events")
    return txn.min_active(e.select(F.col("event_id").alias("pin_id"), (F.col("event_id") + 1).alias("seq"), F.floor(F.col("event_id") / 100).alias("created_epoch"), (F.col("user_id") % 7).alias("lease")), 50)


# Folds

_OPERANDS_SQL = """
, m AS (SELECT seq, key, CASE WHEN cf = 'error' THEN 0 WHEN cf = 'purchase' THEN 1 ELSE 3 END AS kind, CASE WHEN cf <> 'error' THEN cf || seq END AS value FROM log WHERE kind <> 2),
b AS (SELECT key, max(seq) FILTER (kind <> 3) AS base FROM m, p WHERE seq <= s GROUP BY key)"""


def operands(spark, sf):
    x = L.log(spark, sf).where("kind <> 2")
    return x.select("seq", "key", F.expr("CASE WHEN cf = 'error' THEN 0 WHEN cf = 'purchase' THEN 1 ELSE 3 END").alias("kind"), F.expr("CASE WHEN cf <> 'error' THEN concat(cf, seq) END").alias("value"))


@query(_OPERANDS_SQL + " SELECT m.key, string_agg(m.value, ':' ORDER BY m.seq) AS value FROM m JOIN b USING (key), p WHERE m.seq <= s AND (base IS NULL OR m.seq >= base) AND m.kind <> 0 GROUP BY m.key")
def merge_fold(spark, sf):
    """Newest base, then operands oldest first."""
    return fold.fold_append(operands(spark, sf), L.snapshot(spark, sf))


@query(_OPERANDS_SQL + """,
c AS (SELECT m.seq, m.key, m.kind, m.value, (SELECT max(t.seq) FROM log t, p WHERE t.kind = 2 AND t.seq <= s AND t.key <= m.key AND m.key < t.end_key) AS cut FROM m),
d AS (SELECT c.* FROM c, p WHERE seq <= s AND (cut IS NULL OR seq > cut)), bb AS (SELECT key, max(seq) FILTER (kind <> 3) AS base FROM d GROUP BY key)
SELECT d.key, string_agg(d.value, ':' ORDER BY d.seq) AS value FROM d JOIN bb USING (key) WHERE (base IS NULL OR d.seq >= base) AND d.kind <> 0 GROUP BY d.key""")
def merge_fold_tombstones(spark, sf):
    """The same with histories cut by range deletes."""
    return fold.fold_append_with_tombstones(operands(spark, sf), L.tombstones(spark, sf), L.snapshot(spark, sf))


@query(_OPERANDS_SQL + " SELECT m.key, string_agg(m.value, ':' ORDER BY m.seq) AS value FROM m JOIN b USING (key), p WHERE m.seq <= s AND (base IS NULL OR m.seq >= base) AND m.kind <> 0 GROUP BY m.key")
def merge_coalesced(spark, sf):
    """The fold after operands were coalesced: the same answer."""
    s = L.snapshot(spark, sf)
    return fold.fold_append(fold.coalesce_operands(operands(spark, sf), s // 2), s)


@query("SELECT l_suppkey AS key, sum(CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey ELSE l_partkey END)::BIGINT AS total FROM lineitem GROUP BY 1", log=False)
def fold_counters(spark, sf):
    """Saturating counters in order of sequence; no saturation at these sizes, the tests cover it."""
    li = L.table(spark, sf, "lineitem")
    x = li.select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit("counter_add").alias("type"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey ELSE l_partkey END").cast("long").alias("delta"))
    return fold.fold_counter(x)


@query("SELECT l_suppkey AS key, bit_or(CAST(l_partkey AS BIGINT)) AS bits FROM lineitem GROUP BY 1", log=False)
def fold_bits(spark, sf):
    return fold.fold_bits(L.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").cast("long").alias("value")))


@query("SELECT l_suppkey AS key, lower(printf('%016x', max(CAST(l_partkey AS BIGINT)))) AS greatest, lower(printf('%016x', min(CAST(l_partkey AS BIGINT)))) AS least FROM lineitem GROUP BY 1", log=False)
def fold_extremes(spark, sf):
    """Greatest and least big-endian numbers by byte order."""
    li = L.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.unhex(F.lpad(F.hex(F.col("l_partkey").cast("long")), 16, "0")).alias("value"))
    return fold.fold_extreme(li).select("key", F.lower(F.hex("greatest")).alias("greatest"), F.lower(F.hex("least")).alias("least"))


@query("""
, v AS (SELECT *, max(seq) OVER (PARTITION BY key) AS top, length(key) + coalesce(length(value), 0) AS size FROM log WHERE kind <> 2)
SELECT substr(key, 1, 7) AS prefix, sum(size)::BIGINT AS raw_bytes, count(*) AS records, count(*) FILTER (kind = 0) AS tombstones, coalesce(sum(size) FILTER (seq < top), 0)::BIGINT AS obsolete_bytes,
 CAST(1000 * coalesce(sum(size) FILTER (seq < top), 0) // sum(size) AS BIGINT) AS obsolete_permille FROM v GROUP BY 1""")
def measures(spark, sf):
    return fold.measure(L.versions(spark, sf).withColumn("prefix", F.substring("key", 1, 7)), ["prefix"])


@query("""
, e AS (SELECT DISTINCT k FROM (SELECT key AS k FROM log, p WHERE kind = 2 AND seq <= s UNION ALL SELECT end_key FROM log, p WHERE kind = 2 AND seq <= s)),
f AS (SELECT k AS start, lead(k) OVER (ORDER BY k) AS "end" FROM e)
SELECT f.start, f."end", max(t.seq) AS seq FROM f JOIN log t ON t.kind = 2 AND t.key <= f.start AND f."end" <= t.end_key, p WHERE t.seq <= s GROUP BY 1, 2""")
def tombstone_fragments(spark, sf):
    """Disjoint pieces of overlapping range deletes with the highest covering sequence."""
    return reads.fragments(L.tombstones(spark, sf).where(F.col("seq") <= L.snapshot(spark, sf)))


@query("""
, k AS (SELECT DISTINCT key FROM log)
SELECT k.key, (SELECT max(t.seq) FROM log t, p WHERE t.kind = 2 AND t.seq <= s AND t.key <= k.key AND k.key < t.end_key) AS seq FROM k""")
def max_covering(spark, sf):
    """Highest range delete over each key, by an as-of join with the pieces."""
    pieces = reads.fragments(L.tombstones(spark, sf).where(F.col("seq") <= L.snapshot(spark, sf))).select(F.col("start").alias("key"), F.struct("end", "seq").alias("value"))
    keys = L.log(spark, sf).select("key").distinct()
    found = reads.as_of(keys, pieces)
    return found.select("key", F.when(F.col("key") < F.col("value.end"), F.col("value.seq")).alias("seq"))


@query("""
, r AS (SELECT key, seq, us // 1000000 AS created, us // 1000000 // 86400 AS epoch, CASE seq % 4 WHEN 0 THEN NULL ELSE (seq % 4) * 3600 END AS ttl FROM log), z AS (SELECT max(created) AS now, max(epoch) AS e FROM r)
SELECT key, count(*) AS records, count(*) FILTER (CASE WHEN ttl IS NULL THEN false WHEN epoch < e THEN true ELSE now - created >= ttl END) AS expired FROM r, z GROUP BY key""")
def ttl_expiry(spark, sf):
    """Expiry with epochs: a record of an earlier epoch has expired."""
    r = L.log(spark, sf).select("key", F.floor(F.col("us") / 1000000).alias("created"), F.expr("CASE seq % 4 WHEN 0 THEN NULL ELSE (seq % 4) * 3600 END").alias("ttl")).withColumn("epoch", F.floor(F.col("created") / 86400))
    z = r.agg(F.max("created").alias("now"), F.max("epoch").alias("e"))
    x = r.crossJoin(F.broadcast(z))  # one row
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.count_if(fold.expired(F.col("now"), F.col("e"), F.col("created"), F.col("epoch"), F.col("ttl"))).alias("expired"))


@query("""
, t AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, (seq * 37) % 1000 AS wall FROM log)
SELECT key, n, wall, max(wall - n) OVER (PARTITION BY key ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS time FROM t""")
def hybrid_clock(spark, sf):
    t = reads.numbered(L.log(spark, sf).select("key", "seq"), ["key"], "seq").select("key", "n", (F.col("seq") * 37 % 1000).alias("wall"))
    return fold.hybrid_clock(t, ["key"]).select("key", F.col("n").cast("long").alias("n"), "wall", F.col("time").cast("long").alias("time"))


@query("""
, c AS (SELECT key, count(*) FILTER (cf = 'error') AS z0, count(*) FILTER (cf = 'click') AS z1, count(*) FILTER (cf = 'view') AS q, count(*) FILTER (cf = 'purchase') AS w FROM log GROUP BY key)
SELECT key, CASE WHEN z0 > greatest(z1, q, w) THEN 'PointMiss' WHEN z1 > greatest(z0, q, w) THEN 'PointHit' WHEN q > greatest(z0, z1, w) THEN 'ShortRange' WHEN w > greatest(z0, z1, q) THEN 'WriteBurst' ELSE 'Mixed' END AS class FROM c""")
def workload_class(spark, sf):
    n = lambda c: F.count_if(F.col("cf") == c)
    x = L.log(spark, sf).groupBy("key").agg(n("error").alias("z0"), n("click").alias("z1"), n("view").alias("q"), n("purchase").alias("w"))
    return x.select("key", fold.workload_class(*[F.col(c) for c in ("z0", "z1", "q", "w")]).alias("class"))


@query("""
, x AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT key, max(value) FILTER (i = floor(0.5 * (n - 1) + 0.5)) AS p500, max(value) FILTER (i = floor(0.99 * (n - 1) + 0.5)) AS p990 FROM x GROUP BY key""")
def percentiles(spark, sf):
    """Rows of the sample, by the rounded index; never interpolated."""
    return fold.nth(L.table(spark, sf, "events").select(F.col("event_type").alias("key"), "value"), [0.5, 0.99], ["key"], rounded=True)


# Compaction

_FATE_SQL = """
, v AS (SELECT seq, key, kind, value, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM log WHERE kind <> 2),
k AS (SELECT *, newer IS NULL OR NOT (seq < s AND newer <= s) AS keep FROM v, p)"""


@query(_FATE_SQL + " SELECT seq, key, kind, value FROM k WHERE keep")
def gc_versions(spark, sf):
    """Snapshot-safe GC with the oldest pin at the snapshot."""
    return compact.gc(L.versions(spark, sf), L.snapshot(spark, sf))


@query(_FATE_SQL + " SELECT seq, key, kind, value FROM k WHERE NOT keep")
def gc_archive(spark, sf):
    return compact.archive(L.versions(spark, sf), L.snapshot(spark, sf))


@query(_FATE_SQL + " SELECT seq, key, kind, value FROM (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY key) AS n FROM k) WHERE keep AND NOT (kind = 0 AND n = 1 AND seq <= s)")
def gc_bottommost(spark, sf):
    """Bottommost rewrite: lone tombstones go."""
    return compact.gc(L.versions(spark, sf), L.snapshot(spark, sf), bottom=True)


@query("""
, v AS (SELECT *, max(seq) OVER (PARTITION BY key) AS top FROM log WHERE kind <> 2)
SELECT key, seq, CASE WHEN seq = top AND kind = 1 AND starts_with(value, 'view') THEN 0 ELSE kind END AS kind,
  CASE WHEN seq = top AND kind = 1 AND starts_with(value, 'view') THEN NULL WHEN seq = top AND kind = 1 AND starts_with(value, 'click') THEN 'c' ELSE value END AS value FROM v""")
def compaction_filter(spark, sf):
    """Remove or change newest puts by a rule."""
    d = F.struct(F.when(F.col("value").startswith("view"), "remove").when(F.col("value").startswith("click"), "change").otherwise("keep").alias("action"), F.lit("c").alias("value"))
    return compact.apply_filter(L.versions(spark, sf), d).select("key", "seq", "kind", "value")


@query("SELECT substr(key, 1, 7) AS prefix, count(*) AS records, count(*) FILTER (kind = 0) AS tombstones, count(*) FILTER (kind = 0) >= 0.2 * count(*) AS due FROM log WHERE kind <> 2 GROUP BY 1")
def tombstone_density(spark, sf):
    return compact.tombstone_share(L.versions(spark, sf).withColumn("prefix", F.substring("key", 1, 7)), ["prefix"])


@query("""
, v AS (SELECT seq, key, kind, value, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM log WHERE kind <> 2),
k AS (SELECT * FROM v, p WHERE newer IS NULL OR NOT (seq < s AND newer <= s)),
pins AS (SELECT s AS pin FROM p UNION ALL SELECT (s + last) // 2 FROM p UNION ALL SELECT last FROM p),
a AS (SELECT pin, key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM v, pins WHERE seq <= pin GROUP BY pin, key),
b AS (SELECT pin, key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM k, pins WHERE seq <= pin GROUP BY pin, key),
z AS (SELECT x.* FROM (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b) x WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= pin AND t.key <= x.key AND x.key < t.end_key AND t.seq > x.seq))
SELECT pin, count(*) FILTER (side = 'a') AS before, count(*) FILTER (side = 'b') AS after, (SELECT count(*) FROM (SELECT pin, key, value FROM z WHERE side = 'a' EXCEPT ALL SELECT pin, key, value FROM z WHERE side = 'b')) AS changed FROM z GROUP BY pin""")
def gc_safety(spark, sf):
    """Live keys at pins at or above the oldest before and after GC, and how many of all these reads differ."""
    v, t, s, last = L.versions(spark, sf), L.tombstones(spark, sf), L.snapshot(spark, sf), L.last_sequence(spark, sf)
    return compact.safety(compact.fate(v, s), t, [s, (s + last) // 2, last])


@query("""
, o AS (SELECT last * 3 // 10 AS o FROM p), m AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log, o WHERE kind <> 2 AND seq <= o GROUP BY key)
SELECT key, value FROM m, o WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= o AND t.key <= m.key AND m.key < t.end_key AND t.seq > m.seq)""")
def read_below_watermark(spark, sf):
    """A read below the GC watermark from the compacted log and its history."""
    v, s = L.versions(spark, sf), L.snapshot(spark, sf)
    both = compact.gc(v, s).unionByName(compact.archive(v, s))
    return reads.visible(both, L.tombstones(spark, sf), L.snapshot(spark, sf, 3)).select("key", "value")


# Feed


@query("SELECT seq, key, CASE kind WHEN 0 THEN 'delete' WHEN 1 THEN 'put' ELSE 'delete_range' END AS kind, CASE WHEN kind = 2 THEN end_key ELSE value END AS value FROM log, p WHERE seq > s - 1000 AND seq <= s")
def changes_window(spark, sf):
    s = L.snapshot(spark, sf)
    return feed.changes(L.versions(spark, sf), L.tombstones(spark, sf), max(0, s - 1000), s)


@query("SELECT max(seq) AS seq, key, CASE WHEN arg_max(kind, seq) = 1 THEN 'put' ELSE 'delete' END AS kind, CASE WHEN arg_max(kind, seq) = 1 THEN arg_max(value, seq) END AS value FROM log, p WHERE kind <> 2 AND seq > s GROUP BY key")
def changes_latest(spark, sf):
    return feed.changes_latest(L.versions(spark, sf), L.snapshot(spark, sf))


@query("SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM log WHERE kind <> 2 GROUP BY key HAVING arg_max(kind, seq) = 1")
def fold_updates(spark, sf):
    """State at half of the log, then the rest with an overlap: the same as one fold of all."""
    u = L.versions(spark, sf).select("seq", F.when(F.col("kind") == 1, "put").otherwise("purge").alias("op"), "key", "value")
    half = L.last_sequence(spark, sf) // 2
    empty = spark.createDataFrame([], "key string, value string, seq long")
    a = feed.fold(empty, u.where(F.col("seq") <= half))
    return feed.fold(a, u.where(F.col("seq") > half - 100))  # of a key in the overlap the newest update comes again, and wins as before


@query("""
, d AS (SELECT cf AS feed, row_number() OVER (PARTITION BY cf ORDER BY seq) AS q FROM log), x AS (SELECT feed, q AS seq FROM d WHERE NOT (feed = 'click' AND q = 700)),
f AS (SELECT feed, seq, coalesce(lag(seq) OVER (PARTITION BY feed ORDER BY seq), 500) AS b FROM x WHERE seq > 500),
g AS (SELECT feed, min(b + 1) FILTER (seq > b + 1) AS first_gap, max(seq) AS last_seq, count(*) AS fresh FROM f GROUP BY feed)
SELECT feed, count(*) - any_value(coalesce(fresh, 0)) AS skipped, any_value(first_gap) AS first_gap, any_value(last_seq) AS last_seq FROM x LEFT JOIN g USING (feed) GROUP BY feed""")
def stitch_gaps(spark, sf):
    """Deltas after a snapshot: overlap skipped, the first gap of each feed found."""
    d = reads.numbered(L.log(spark, sf).select(F.col("cf").alias("feed"), "seq"), ["feed"], "seq").select("feed", F.col("n").alias("seq"))
    return feed.gaps(d.where("not (feed = 'click' and seq = 700)"), 500)


@query("""
, f AS (SELECT cf, max(seq) FILTER (seq % 3 = 0) AS flushed, min(seq) FILTER (seq > 5000) AS active FROM log GROUP BY cf)
SELECT least(min(least(flushed + 1, coalesce(active, 4611686018427387904))), (SELECT min(seq) FROM log WHERE seq > 4000 AND kind = 0)) AS watermark FROM f""")
def prune_watermark(spark, sf):
    x = L.log(spark, sf)
    f = x.groupBy("cf").agg(F.max(F.when(F.col("seq") % 3 == 0, F.col("seq"))).alias("last_flushed_seq"), F.min(F.when(F.col("seq") > 5000, F.col("seq"))).alias("min_active_seq"))
    return feed.prune_watermark(f, x.where("seq > 4000 and kind = 0").select("seq"))


@query("SELECT l.cf, l.seq, l.key FROM log l LEFT JOIN (SELECT cf, max(seq) // 2 AS c FROM log WHERE cf <> 'view' GROUP BY cf) c USING (cf) WHERE c IS NULL OR seq > c")
def partitioned_replay(spark, sf):
    """Records above their family's checkpoint; a family without one is replayed whole."""
    x = L.log(spark, sf).select("cf", "seq", "key")
    return feed.replay(x, x.where("cf <> 'view'").groupBy("cf").agg(F.floor(F.max("seq") / 2).alias("seq"))).select("cf", "seq", "key")


# Codecs


@query("SELECT seq, upper(hex(encode(key))) || upper(printf('%016x', (seq << 8) | kind)) AS ikey FROM log")
def codec_internal_key(spark, sf):
    x = L.log(spark, sf).withColumn("ikey", codec.internal_key(F.col("key").cast("binary"), F.col("seq"), F.col("kind")))
    return x.select("seq", F.hex("ikey").alias("ikey"))


@query("""
WITH o AS (SELECT o_orderkey AS id, upper(printf('%016x', o_orderkey)) AS a, upper(hex(encode(o_orderstatus))) AS b FROM orders),
c AS (SELECT *, array_to_string(list_transform(regexp_extract_all(a, '..'), lambda x: CASE WHEN x = '00' THEN '00FF' ELSE x END), '') || '0001' || b || '0001' AS code FROM o)
SELECT id, code, a AS first, b AS second, row_number() OVER (ORDER BY a, b) = row_number() OVER (ORDER BY code) AS same_order FROM c""", log=False)
def codec_tuple(spark, sf):
    """Order-preserving tuples: encoded, decoded back, and of the same order as their parts, NUL bytes and all."""
    o = L.table(spark, sf, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")).alias("a"), F.col("o_orderstatus").cast("binary").alias("b"))
    x = o.withColumn("code", codec.tuple_key(F.col("a"), F.col("b"))).withColumn("parts", codec.tuple_parts(F.col("code")))
    by_code, by_parts = reads.ordered(x.select("o_orderkey", "code"), ["code"]), reads.ordered(x.select("o_orderkey", "a", "b"), ["a", "b"])
    same = by_code.select("o_orderkey", F.col("n").alias("n1")).join(by_parts.select("o_orderkey", F.col("n").alias("n2")), "o_orderkey")
    return x.join(same, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.hex("code").alias("code"), F.hex(F.col("parts")[0]).alias("first"), F.hex(F.col("parts")[1]).alias("second"), (F.col("n1") == F.col("n2")).alias("same_order"))


@query("SELECT seq, cf || chr(0) || key AS code, cf, key FROM log")
def codec_family(spark, sf):
    x = L.log(spark, sf).select("seq", codec.family_key(F.col("cf"), F.col("key").cast("binary")).alias("code"))
    return x.select("seq", F.col("code").cast("string").alias("code"), codec.family_parts(F.col("code"))["cf"].alias("cf"), codec.family_parts(F.col("code"))["key"].cast("string").alias("key"))


@query("SELECT seq, upper(printf('%016x', seq % 5)) || upper(hex(encode(key))) AS code, seq % 5 = 2 AS mine FROM log")
def codec_tenant(spark, sf):
    x = L.log(spark, sf).select("seq", codec.tenant_key(F.col("seq") % 5, F.col("key").cast("binary")).alias("code"))
    return x.select("seq", F.hex("code").alias("code"), codec.in_tenant(F.col("code"), F.lit(2)).alias("mine"))


@query("SELECT c_custkey AS id, lower(trim(c_name)) AS canonical FROM customer", log=False)
def codec_canonical(spark, sf):
    c = L.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), codec.canonical(F.concat(F.lit(" \t"), F.col("c_name"), F.lit("\n "))).alias("canonical"))


@query("SELECT seq, upper(printf('%08x', length(key))) || upper(hex(encode(key))) AS framed, key || upper(printf('%016x', seq)) AS row_key FROM log")
def codec_framing(spark, sf):
    return L.log(spark, sf).select("seq", F.hex(codec.with_length(F.col("key").cast("binary"))).alias("framed"), codec.row_key(F.col("key"), F.col("seq")).alias("row_key"))


# Workload shapes: what the usual key-value workloads ask, as one set-based job each


@query("SELECT l_partkey AS src, count(*) AS links, least(count(*), 25) AS returned, min(l_suppkey) AS first_dst FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1", log=False)
def link_lists(spark, sf):
    """Neighbours under each source's prefix, capped at 25."""
    e = L.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    n = F.count(F.lit(1))
    return e.groupBy(F.col("l_partkey").alias("src")).agg(n.alias("links"), F.least(n, F.lit(25)).cast("long").alias("returned"), F.min("l_suppkey").alias("first_dst"))


@query("SELECT a.l_partkey AS src, count(DISTINCT b.l_partkey) AS reached FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b USING (l_suppkey) GROUP BY 1", log=False)
def two_hops(spark, sf):
    """Traversal of two edges over the edge table: part to supplier, supplier to all its parts. Parts of the same suppliers are one node with a weight."""
    return hops.two_hops(L.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("via")))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS win, user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2", log=False)
def window_state(spark, sf):
    """State of a window: rows under a window's prefix."""
    e = L.table(spark, sf, "events")
    return e.groupBy((F.floor(L.micros("ts") / 3_600_000_000) * 3_600_000_000).alias("win"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("SELECT seq, key, count(*) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS trailing FROM log")
def trailing_read(spark, sf):
    """Rows among the last 25 of a slot's key."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(-25, 0)
    return L.log(spark, sf).select("seq", "key", F.count(F.lit(1)).over(w).alias("trailing"))


@query("SELECT key AS row_key, cf AS col, max(seq) AS ts, arg_max(value, seq) AS value FROM log WHERE kind = 1 GROUP BY 1, 2")
def wide_columns(spark, sf):
    """Newest cell of each row and column."""
    x = L.log(spark, sf).where("kind = 1")
    return x.groupBy(F.col("key").alias("row_key"), F.col("cf").alias("col")).agg(F.max("seq").alias("ts"), F.max_by("value", "seq").alias("value"))


@query("SELECT l_orderkey AS s, l_partkey AS o FROM lineitem WHERE l_linenumber = 3", log=False)
def triple_lookup(spark, sf):
    """Triples (order, line 3, part) of all subjects."""
    t = L.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("p"), F.col("l_partkey").alias("o"))
    return t.where("p = 3").select("s", "o")


@query("SELECT c_nationkey, count(*) AS n, min(c_custkey) AS least FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1", log=False)
def secondary_index(spark, sf):
    """Rows found through an index on another column, joined back by key."""
    c, n = L.table(spark, sf, "customer"), L.table(spark, sf, "nation").where("n_regionkey = 1")
    index = c.select("c_nationkey", "c_custkey").join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"))), "c_nationkey", "left_semi")  # 25 nations
    return index.join(c.select("c_custkey"), "c_custkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", log=False)
def misses(spark, sf):
    """Keys that a second family does not have."""
    return L.table(spark, sf, "documents").select("doc_id").join(L.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


# Iterators, ingest, health and records


@query("SELECT key, seq, value FROM vis WHERE starts_with(key, 'u/0000') AND key >= 'u/000020' AND key < 'u/000080' ORDER BY key DESC LIMIT 30")
def iterator_options(spark, sf):
    """Lower and upper bound, pinned snapshot and prefix, in reverse; the prefix holds in both directions."""
    return reads.scan(state(spark, sf), reads.bounds("u/000020", "u/000080") & reads.prefix_bounds("u/0000"), reverse=True, limit=30)


@query("SELECT cf, key, max(seq) AS seq, arg_max(value, seq) AS value FROM log, p WHERE kind = 1 AND seq <= s AND cf = 'purchase' GROUP BY cf, key")
def family_scan(spark, sf):
    """One family's live rows; the family is a column, so its bound is a partition filter."""
    x = L.log(spark, sf).where("cf = 'purchase' and kind = 1")
    return reads.newest(x, L.snapshot(spark, sf), ("cf", "key")).select("cf", "key", "seq", "value")


@query("SELECT key, seq, kind, value, CASE WHEN seq % 3 = 0 THEN 0 WHEN seq % 3 = 1 THEN 1 ELSE 2 END AS run FROM log WHERE kind <> 2")
def kway_merge(spark, sf):
    """Sorted runs as one ordered stream: key ascending, newest first."""
    v = L.versions(spark, sf)
    runs = None
    for r in range(3):
        x = v.where(F.col("seq") % 3 == r).withColumn("run", F.lit(r))
        runs = x if runs is None else runs.unionByName(x)
    return runs.orderBy("key", F.col("seq").desc()).select("key", "seq", "kind", "value", "run")


@query("SELECT key, seq, value FROM vis WHERE NOT (key >= 'u/000020' AND key < 'u/000050')")
def delete_files_in_range(spark, sf):
    """A range made invisible by one tombstone at the snapshot's end."""
    s = L.snapshot(spark, sf)
    extra = spark.createDataFrame([("u/000020", "u/000050", s + 1)], "start string, end string, seq long")
    t = L.tombstones(spark, sf).where(F.col("seq") <= s).select("start", "end", F.col("seq").cast("long").alias("seq")).unionByName(extra)
    return reads.visible(L.versions(spark, sf).where(F.col("seq") <= s), t)


@query("""
, o AS (SELECT seq // 8 AS batch, cf, seq AS pos, key, kind = 1 AS put FROM log), b AS (SELECT batch, cf, bool_and(put) AS puts, bool_and(coalesce(key > before, true)) AS rising, min(key) AS least, max(key) AS most FROM (SELECT *, lag(key) OVER (PARTITION BY batch, cf ORDER BY pos) AS before FROM o) GROUP BY batch, cf),
h AS (SELECT *, max(most) OVER (PARTITION BY cf ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM b)
SELECT batch, cf, puts AND rising AND coalesce(least > high, true) AS sorted FROM h""")
def classify_batches(spark, sf):
    """Batches that could be appended as sorted files."""
    x = L.log(spark, sf)
    return txn.classify_batches(x.select(F.floor(F.col("seq") / 8).alias("batch"), "cf", F.col("seq").alias("pos"), "key", (F.col("kind") == 1).alias("put")))


@query("""
, c AS (SELECT key, max(seq) * 3 AS last_sequence, min(seq) AS oldest_pin, count(*) FILTER (cf = 'error') // 20 AS corruption, CASE WHEN count(*) % 9 = 0 THEN 1 ELSE 0 END AS failures, count(*) FILTER (cf = 'view') * 40 AS hits, count(*) FILTER (cf = 'click') * 45 AS misses FROM log GROUP BY key),
g AS (SELECT *, greatest(last_sequence - oldest_pin, 0) AS lag, hits + misses AS asked FROM c),
i AS (SELECT key, list_filter([CASE WHEN corruption > 0 THEN 'corruption' END, CASE WHEN failures > 0 THEN 'compaction_failing' END, CASE WHEN lag >= 20000 THEN 'pin_leak' END, CASE WHEN lag >= 5000 AND lag < 20000 THEN 'pin_lag' END, CASE WHEN asked >= 500 AND hits < 0.5 * asked THEN 'cache_thrash' END], lambda x: x IS NOT NULL) AS l FROM g)
SELECT key, CASE WHEN len(list_intersect(l, ['corruption', 'compaction_failing', 'pin_leak'])) > 0 THEN 'action_required' WHEN len(l) > 0 THEN 'degraded' ELSE 'healthy' END AS status, array_to_string(l, ',') AS issues FROM i""")
def health_report(spark, sf):
    """Status and issues of many instances from their counters."""
    n = lambda c: F.count_if(F.col("cf") == c)
    c = L.log(spark, sf).groupBy("key").agg((F.max("seq") * 3).alias("last_sequence"), F.min("seq").alias("oldest_pin"), F.floor(n("error") / 20).alias("corruption"), F.when(F.count(F.lit(1)) % 9 == 0, 1).otherwise(0).alias("failures"), (n("view") * 40).alias("hits"), (n("click") * 45).alias("misses"))
    return fold.health(c).select("key", "status", "issues")


@query("""
, d AS (SELECT cf AS feed, row_number() OVER (PARTITION BY cf ORDER BY seq) AS seq, CASE WHEN kind = 1 THEN 'put' ELSE 'purge' END AS op, key, value FROM log),
st AS (SELECT feed, key, arg_max(value, seq) AS value FROM d WHERE seq <= 50 GROUP BY feed, key HAVING arg_max(op, seq) = 'put'),
x AS (SELECT feed, key, CAST(50 AS BIGINT) AS seq, 'put' AS op, value FROM st UNION ALL SELECT feed, key, seq, op, value FROM d WHERE seq > 50 AND feed <> 'view')
SELECT feed, key, arg_max(value, seq) AS value FROM x GROUP BY feed, key HAVING arg_max(op, seq) = 'put'""")
def federated_fold(spark, sf):
    """State by feed at a cutoff and deltas after it: overlap skipped, the feed with a gap left as it was."""
    x = L.log(spark, sf)
    x = reads.numbered(x, ["cf"], "seq")
    d = x.select(F.col("cf").alias("feed"), F.col("n").alias("seq"), F.when(F.col("kind") == 1, "put").otherwise("purge").alias("op"), "key", "value")
    first = d.where("seq <= 50").groupBy("feed", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("b")).where("b.op = 'put'").select("feed", "key", "b.value")
    return feed.federated(first, d.where("seq > 30 and not (feed = 'view' and seq = 60)"), 50)


@query("SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind FROM log WHERE kind <> 2 GROUP BY key")
def merge_latest(spark, sf):
    """Cache of the latest change and a delta that overlaps it."""
    v = L.versions(spark, sf)
    s = L.snapshot(spark, sf)
    cache = reads.newest(v, s).select("seq", "key", "kind", "value")
    return feed.merge_latest(cache, v.where(F.col("seq") > s - 200)).select("key", "seq", "kind")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS key, c_mktsegment AS value, CAST(NULL AS BIGINT) AS ttl_seconds FROM customer", log=False)
def record_upgrade(spark, sf):
    """Records of the first form as records of the second."""
    c = L.table(spark, sf, "customer").select(F.struct(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")).alias("r"))
    return c.select(codec.upgrade(F.col("r")).alias("u")).select("u.*")


@query("SELECT c_custkey AS id, c_mktsegment AS known, c_name AS unknown FROM customer", log=False)
def tagged_fields(spark, sf):
    """A field that the reader does not know survives a rewrite of one that it knows."""
    c = L.table(spark, sf, "customer")
    old = F.create_map(F.lit(1), F.lit("old"), F.lit(9), F.col("c_name"))
    m = codec.merge_fields(F.create_map(F.lit(1), F.col("c_mktsegment")), old)
    return c.select(F.col("c_custkey").alias("id"), m[1].alias("known"), m[9].alias("unknown"))


# More folds, codecs and feeds; many tombstones


@query("""
SELECT l_suppkey AS key, upper(string_agg(printf('%02x', b), '' ORDER BY i)) AS bits FROM (
  SELECT l_suppkey, i, bit_or(CAST('0x' || substr(h, 2 * i + 1, 2) AS INT)) AS b FROM (SELECT l_suppkey, hex(encode(l_linestatus || repeat(l_returnflag, CAST(l_linenumber * 3 AS INT)))) AS h FROM lineitem), generate_series(0, 40) g(i) WHERE 2 * i < length(h) GROUP BY 1, 2) GROUP BY 1""", log=False)
def fold_bytes(spark, sf):
    """Bitwise or of byte strings of other lengths."""
    li = L.table(spark, sf, "lineitem")
    x = li.select(F.col("l_suppkey").alias("key"), F.concat("l_linestatus", F.repeat("l_returnflag", F.col("l_linenumber").cast("int") * 3)).cast("binary").alias("value"))
    return fold.fold_bytes(x).select("key", F.hex("bits").alias("bits"))


@query("""
, o AS (SELECT key, seq, CASE WHEN cf = 'purchase' THEN 'put' WHEN seq % 2 = 0 AND key < 'u/000075' THEN 'append' ELSE 'counter_add' END AS type, cf AS payload, seq % 100 AS delta FROM log),
b AS (SELECT key, max(seq) FILTER (type = 'put') AS base FROM o GROUP BY key),
x AS (SELECT o.* FROM o JOIN b USING (key) WHERE base IS NULL OR seq >= base),
g AS (SELECT key, count(*) FILTER (type = 'counter_add') AS c, count(*) FILTER (type = 'append') AS a, CAST(sum(delta) FILTER (type <> 'append') AS BIGINT) AS total, coalesce(string_agg(payload, '' ORDER BY seq) FILTER (type <> 'counter_add'), '') AS payload FROM x GROUP BY key)
SELECT key, CASE WHEN a = 0 THEN total END AS total, CASE WHEN c = 0 THEN payload END AS payload, CASE WHEN c > 0 AND a > 0 THEN 'mixed types' END AS error FROM g""")
def fold_typed(spark, sf):
    """Puts, counters and appends; types that mix are an error of their key."""
    x = L.log(spark, sf).withColumn("type", F.expr("CASE WHEN cf = 'purchase' THEN 'put' WHEN seq % 2 = 0 AND key < 'u/000075' THEN 'append' ELSE 'counter_add' END"))
    x = fold.fold_typed(x.select("key", "seq", "type", F.col("cf").cast("binary").alias("payload"), (F.col("seq") % 100).alias("delta")))
    return x.select("key", "total", F.col("payload").cast("string").alias("payload"), "error")


_ORDERS_SQL = """
WITH v AS (SELECT printf('o/%09d', o_orderkey) AS key, o_orderkey * 7 % 100003 AS seq, o_orderstatus AS value FROM orders),
t AS (SELECT printf('o/%09d', o_orderkey) AS s, printf('o/%09d', o_orderkey + 3 + o_custkey % 40) AS e, o_orderkey * 11 % 100003 AS seq FROM orders WHERE o_orderkey % 3 = 1)"""


def _orders(spark, sf):
    """A version a key, and more distinct tombstones than are broadcast."""
    o, k = L.table(spark, sf, "orders"), lambda e: F.format_string("o/%09d", F.expr(e))
    v = o.select(k("o_orderkey").alias("key"), F.expr("o_orderkey * 7 % 100003").alias("seq"), F.lit(1).alias("kind"), F.col("o_orderstatus").alias("value"))
    return v, o.where("o_orderkey % 3 = 1").select(k("o_orderkey").alias("start"), k("o_orderkey + 3 + o_custkey % 40").alias("end"), F.expr("o_orderkey * 11 % 100003").alias("seq"))


@query(_ORDERS_SQL + " SELECT key, seq, value FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s <= v.key AND v.key < t.e AND t.seq > v.seq)", log=False)
def visible_many_tombstones(spark, sf):
    """Visibility under thousands of overlapping tombstones: pieces and an as-of join."""
    return reads.visible(*_orders(spark, sf))


@query(_ORDERS_SQL + ", e AS (SELECT DISTINCT k FROM (SELECT s AS k FROM t UNION ALL SELECT e FROM t)), f AS (SELECT k AS start, lead(k) OVER (ORDER BY k) AS \"end\" FROM e) SELECT f.start, f.\"end\", max(t.seq) AS seq FROM f JOIN t ON t.s <= f.start AND f.\"end\" <= t.e GROUP BY 1, 2", log=False)
def fragments_many(spark, sf):
    return reads.fragments(_orders(spark, sf)[1])


@query("SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM vis")
def neighbours_all(spark, sf):
    """Previous and next live key over the whole log."""
    return reads.neighbours(state(spark, sf, values=False))


@query("SELECT cf, count(*) AS lost FROM log l JOIN p ON seq <= s LEFT JOIN (SELECT cf, max(seq) // 2 AS c FROM log WHERE cf <> 'view' GROUP BY cf) c USING (cf) WHERE c IS NULL OR seq > c GROUP BY cf")
def truncation_safety(spark, sf):
    """Families that would lose records if the log were cut at the snapshot."""
    x = L.log(spark, sf).select("cf", "seq", "key")
    return feed.truncation_losses(x, x.where("cf <> 'view'").groupBy("cf").agg(F.floor(F.max("seq") / 2).alias("seq")), L.snapshot(spark, sf))


@query("""
, d AS (SELECT cf AS feed, row_number() OVER (PARTITION BY cf ORDER BY seq) AS q FROM log), x AS (SELECT feed, q AS seq FROM d WHERE q > 500 AND NOT (feed = 'click' AND q = 700) OR feed = 'view')
SELECT feed, count(*) FILTER (seq <= 500) = 0 AND count(DISTINCT seq) = count(*) AND min(seq) = 501 AND max(seq) = 500 + count(*) AS ok FROM x GROUP BY feed""")
def strict_stitch(spark, sf):
    """Feeds that continue a snapshot exactly: no overlap, repeat or gap."""
    d = reads.numbered(L.log(spark, sf).select(F.col("cf").alias("feed"), "seq"), ["feed"], "seq").select("feed", F.col("n").alias("seq"))
    return feed.strict_stitch(d.where("seq > 500 and not (feed = 'click' and seq = 700) or feed = 'view'"), 500)


@query("SELECT DISTINCT l.key, true AS held FROM log l")
def bloom_filter(spark, sf):
    """A filter of all keys, tested with every key that it holds: never a false no. The tests measure false yeses."""
    keys = L.log(spark, sf).select("key").distinct()
    bits = codec.bloom_array(codec.bloom(keys, "key", [], 1 << 16), [], 1 << 16)
    return keys.crossJoin(F.broadcast(bits)).select("key", codec.may_contain(F.col("bits"), F.col("key"), 1 << 16).alias("held"))  # one row of 8 KB
