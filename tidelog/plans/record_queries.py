"""Queries of byte forms, generators, recovery and what a store keeps outside its commits, with the same results as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import random as R
from ..functions import records
from ..operators import recovery
from ..operators import visible as reads
from ..sources.runs import ingest_run, write_run
from ..sources.shared import new_path
from ..sources.tier import HistoryTier
from ..streaming.feed import FeedCache
from . import log as L
from .queries import query, state
from .store_queries import _store, _written

# Little-endian hex of a number in DuckDB.
_LE = "array_to_string(list_reverse(regexp_extract_all(printf('%0{n}X', {x}), '..')), '')"


def _le(x: str, size: int) -> str:
    return _LE.format(n=2 * size, x=f"CAST({x} AS BIGINT)")


_VALUE = "coalesce(CASE kind WHEN 2 THEN end_key ELSE value END, '')"
_RECORDS_SQL = f"""
, o AS (SELECT seq // 32 AS batch, seq, kind, key, {_VALUE} AS v FROM log), q AS (SELECT *, v <> '' AND v = lag(v) OVER (PARTITION BY batch ORDER BY seq) AS again FROM o),
h AS (SELECT batch, seq, coalesce(again, false) AS again, {_le("kind + CASE WHEN coalesce(again, false) THEN 128 ELSE 0 END", 1)} || {_le("seq", 8)} || {_le("octet_length(encode(key))", 4)} || hex(encode(key)) || CASE WHEN coalesce(again, false) THEN '' ELSE {_le("octet_length(encode(v))", 4)} || hex(encode(v)) END AS x FROM q)
SELECT batch, count(*) AS ops, CASE WHEN bool_or(again) THEN '02' ELSE '01' END || {_le("count(*)", 4)} || string_agg(x, '' ORDER BY seq) AS record FROM h GROUP BY batch"""


def _records(spark, sf):
    op = F.struct("seq", "kind", F.col("key").cast("binary").alias("key"), F.when(F.col("kind") == 2, F.col("end_key")).otherwise(F.col("value")).cast("binary").alias("value"))
    ops = L.log(spark, sf).groupBy(F.floor(F.col("seq") / 32).alias("batch")).agg(F.sort_array(F.collect_list(op)).alias("list"))  # 32 at most
    return ops.select("batch", F.size("list").alias("ops"), records.write_record(F.col("list")).alias("record"))


@query(_RECORDS_SQL)
def write_records(spark, sf):
    """The log as write records of 32 operations; values that repeat the one before are left out."""
    return _records(spark, sf).withColumn("record", F.hex("record"))


@query(f", o AS (SELECT seq // 32 AS batch, seq, kind, key, {_VALUE} AS value FROM log) SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY seq) - 1 AS pos, kind, seq, key, value, CAST(NULL AS VARCHAR) AS error FROM o WHERE batch % 10 <> 3 UNION ALL SELECT DISTINCT batch, NULL, NULL, NULL, NULL, NULL, '1 bytes behind the end' FROM o WHERE batch % 10 = 3")
def write_record_replay(spark, sf):
    """Records read back into operations; a damaged one gives its error and none of its operations."""
    damaged = F.when(F.col("batch") % 10 == 3, F.concat("record", F.lit(b"x"))).otherwise(F.col("record"))
    x = records.write_record_ops(_records(spark, sf).withColumn("record", damaged), "record", ["batch"])
    return x.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


@query(f"""
SELECT c_custkey AS id, '50454452' || {_le("1 + c_custkey % 3", 2)} || {_le("3", 2)} || {_le("1", 2)} || {_le("octet_length(encode(c_name))", 4)} || hex(encode(c_name)) || {_le("2", 2)} || {_le("octet_length(encode(c_mktsegment))", 4)} || hex(encode(c_mktsegment))
  || {_le("900", 2)} || {_le("4", 4)} || {_le("c_nationkey", 4)} AS message, 1 + c_custkey % 3 AS version, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS unknown FROM customer""", log=False)
def tagged_message(spark, sf):
    """Messages written, read by readers that know two fields or one, and what those keep unknown written again as it was."""
    c = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_nationkey")
    b = lambda n: F.col(n).cast("binary")
    known = F.create_map(F.lit(1), b("c_name"), F.lit(2), b("c_mktsegment"))
    unknown = F.create_map(F.lit(900), F.unhex(records._little(F.col("c_nationkey"), 4)))
    m = c.select("id", records.message((1 + F.col("id") % 3).cast("int"), known, unknown).alias("message"))
    read = records.message_fields(m.where("id % 5 <> 0"), "message", ["id"], 2).unionByName(records.message_fields(m.where("id % 5 = 0"), "message", ["id"], 1))
    again = records.message(F.col("version"), F.col("known"), F.col("unknown"))
    field = lambda n: F.try_element_at("known", F.lit(n)).cast("string")
    return read.select("id", F.hex(again).alias("message"), "version", field(1).alias("name"), field(2).alias("segment"), F.size("unknown").alias("unknown"))


@query(f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN {_le("1", 2)} || {_le("p_partkey", 4)} ELSE {_le("2", 2)} || {_le("p_partkey", 8)} || {_le("p_size % 4", 8)} END || {_le("octet_length(encode(p_brand))", 4)} || {_le("octet_length(encode(p_name))", 4)} || hex(encode(p_brand)) || hex(encode(p_name)) AS record,
  p_partkey AS got_id, p_brand AS key, p_name AS value, CASE WHEN p_partkey % 2 = 1 AND p_size % 4 > 0 THEN p_size % 4 END AS ttl_seconds FROM part""", log=False)
def evolving_records(spark, sf):
    """Records of both forms, read by a reader of the second."""
    p = L.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").cast("binary").alias("key"), F.col("p_name").cast("binary").alias("value"), (F.col("p_size") % 4).alias("ttl_seconds"))
    r = F.struct("id", "key", "value", "ttl_seconds")
    x = p.select("id", F.when(F.col("id") % 2 == 0, records.evolving(r, 1)).otherwise(records.evolving(r, 2)).alias("record"))
    e = records.evolved(F.col("record"))
    return x.select("id", F.hex("record").alias("record"), e["id"].alias("got_id"), e["key"].cast("string").alias("key"), e["value"].cast("string").alias("value"), e["ttl_seconds"].alias("ttl_seconds"))


_STEP = "(SELECT xor(c, c << 17) & 18446744073709551615::HUGEINT FROM (SELECT xor(b, b >> 7) AS c FROM (SELECT xor(a, a << 13) & 18446744073709551615::HUGEINT AS b FROM (SELECT {x} AS a))))"


@query(f"SELECT key, CAST({_STEP.format(x=_STEP.format(x='CAST(seq AS HUGEINT) * 1000003'))} % 1000 AS BIGINT) AS pick FROM (SELECT key, max(seq) AS seq FROM log GROUP BY key)")
def random_states(spark, sf):
    """Two steps of the generator from a seed for each key, as a number below 1,000."""
    x = L.log(spark, sf).groupBy("key").agg(F.max("seq").alias("seq"))
    return x.select("key", R.below(R.nth(F.col("seq") * 1000003, F.lit(2)), 1000).alias("pick"))


@query()
def zipf_picks(spark, sf):
    """How often records are picked among the newest by a draw for each event. SQL has other sums of weights; the tests compare plain Python."""
    x = L.log(spark, sf).select(R.uniform(R.nth(F.col("seq") * 2654435761 + 1, F.lit(3))).alias("u"), F.col("seq").alias("latest"))
    return x.select(R.zipf_pick(F.col("u"), F.col("latest"), 1000).alias("record")).groupBy("record").agg(F.count(F.lit(1)).alias("picks"))


_FAULTS = "record clean_end truncated length_corrupt unknown_type checksum zero_tail orphan other".split()


@query(f""", e AS (SELECT seq, {_FAULTS!r}[1 + seq % 9] AS fault, seq % 4 AS kept, (seq // 9) % 2 = 0 AS can_skip, (seq % 5) * 1200000 AS skips, (seq // 18) % 3 = 0 AS searching, ['full', 'first', 'middle', 'last', 'zero'][1 + seq % 5] AS part, (seq // 5) % 2 = 0 AS empty, seq % 700 AS length, 32000 + seq % 1500 AS payload_end, CASE WHEN seq % 3 = 0 THEN 32768 ELSE 32500 END AS block_end FROM log)
SELECT seq, CASE fault WHEN 'record' THEN 'keep' WHEN 'clean_end' THEN 'stop' WHEN 'orphan' THEN 'fail' WHEN 'other' THEN 'fail'
  ELSE CASE WHEN fault IN ('checksum', 'zero_tail') AND NOT searching THEN 'fail' WHEN NOT can_skip AND kept = 0 THEN 'fail' WHEN NOT can_skip THEN 'prefix' WHEN fault NOT IN ('checksum', 'zero_tail') AND skips > 4194304 THEN 'fail' ELSE 'search' END END AS action,
  CASE part WHEN 'full' THEN 'yield' WHEN 'first' THEN 'start' WHEN 'zero' THEN 'skip' WHEN 'middle' THEN CASE WHEN empty THEN 'fail' ELSE 'add' END ELSE CASE WHEN empty THEN 'fail' ELSE 'yield' END END AS fragment,
  CASE WHEN length > 600 THEN 'fail' WHEN payload_end <= block_end THEN 'read' WHEN block_end = 32768 THEN 'fail' ELSE 'truncated' END AS payload FROM e""")
def recovery_actions(spark, sf):
    """What recovery does with each thing read from a log, in all states."""
    at = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    s, big = F.col("seq"), F.lit(32768)
    block_end = F.when(s % 3 == 0, big).otherwise(32500)
    return L.log(spark, sf).select(
        "seq",
        recovery.collect_action(at(_FAULTS, 1 + s % 9), s % 4, F.floor(s / 9) % 2 == 0, s % 5 * 1200000, F.floor(s / 18) % 3 == 0).alias("action"),
        recovery.fragment_action(at("full first middle last zero".split(), 1 + s % 5), F.floor(s / 5) % 2 == 0).alias("fragment"),
        recovery.payload_action(s % 700, F.lit(600), 32000 + s % 1500, block_end, big).alias("payload"),
    )


@query("""
, d AS (SELECT cf AS log, NOT EXISTS (SELECT 1 FROM log x WHERE x.cf = l.cf AND x.kind = 1 AND x.seq >= (SELECT CASE l.cf WHEN 'view' THEN 10 ELSE last + 1 END FROM p)) AS holds FROM (SELECT DISTINCT cf FROM log) l),
t AS (SELECT seq // 16 AS tx_id, count(*) AS n, count(*) FILTER (kind = 1 OR seq // 16 % 5 = 0) AS seen FROM log GROUP BY 1)
SELECT 'durable' AS property, log AS subject, holds FROM d
UNION ALL SELECT 'newest', n.key, n.kind IS NOT DISTINCT FROM o.kind AND (n.kind <> 1 OR n.value IS NOT DISTINCT FROM o.value) FROM (SELECT key, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM (SELECT key, seq, kind, coalesce(value, '') AS value FROM log) GROUP BY key) n JOIN (SELECT key, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM (SELECT key, seq, kind, coalesce(value, '') AS value FROM log WHERE key >= 'u/000050' OR seq % 2 = 0) GROUP BY key) o USING (key)
UNION ALL SELECT 'whole', CAST(tx_id AS VARCHAR), CASE WHEN tx_id % 7 = 0 AND tx_id % 2 = 0 THEN false WHEN tx_id % 2 = 0 THEN seen = n ELSE seen = 0 END FROM t
UNION ALL SELECT 'majority', CAST(seq AS VARCHAR), NOT (seq % 6 > 0) OR (seq % 4 >= 5 // 2 + 1 AND (seq % 2 = 0 OR seq % 3 >= 3 // 2 + 1)) FROM log WHERE kind = 0""")
def log_properties(spark, sf):
    """Acknowledged entries survive, answers come from the newest source, transactions are whole or absent, served values have their majorities."""
    x, last = L.log(spark, sf), L.last_sequence(spark, sf)
    survivors = x.select(F.col("cf").alias("log")).distinct().withColumn("survives", F.when(F.col("log") == "view", 10).otherwise(last + 1))
    out = recovery.acks_durable(x.select(F.col("cf").alias("log"), F.col("seq").alias("pos"), (F.col("kind") == 1).alias("acked")), survivors)
    out = out.select(F.lit("durable").alias("property"), F.col("log").alias("subject"), "holds")
    probes = x.select("key", F.col("seq").alias("source"), "kind", F.coalesce("value", F.lit("")).alias("value"))
    stale = probes.where("key >= 'u/000050' or source % 2 = 0").groupBy("key").agg(F.max_by(F.struct("kind", "value"), "source").alias("a")).select("key", "a.kind", "a.value")
    out = out.unionByName(recovery.newest_answers(probes, stale).select(F.lit("newest").alias("property"), F.col("key").alias("subject"), "holds"))
    tx = x.select(F.floor(F.col("seq") / 16).alias("tx_id"), (F.col("seq") % 16).alias("at"), "kind", "seq")
    first = tx.groupBy("tx_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("staged"))
    seen = tx.where("kind = 1 or tx_id % 5 = 0").join(first, "tx_id").select("tx_id", (F.col("at") - F.col("first")).alias("write"))
    txns = first.select("tx_id", (F.col("tx_id") % 2 == 0).alias("committed"), (F.col("tx_id") % 7 == 0).alias("aborted"), "staged")
    out = out.unionByName(recovery.all_or_nothing(txns, seen).select(F.lit("whole").alias("property"), F.col("tx_id").cast("string").alias("subject"), "holds"))
    s = F.col("seq")
    held = recovery.majority_held(s % 6 > 0, F.lit(5), s % 4, s % 2 == 1, F.lit(3), s % 3)
    return out.unionByName(x.where("kind = 0").select(F.lit("majority").alias("property"), s.cast("string").alias("subject"), held.alias("holds")))


@query("""
, c AS (SELECT DISTINCT user_id AS id, 'u/' || lpad(CAST(user_id * 3 % 400 AS VARCHAR), 6, '0') AS key FROM events)
SELECT c.id, count(vis.key) FILTER (vis.key >= c.key) AS ahead, count(vis.key) FILTER (vis.key <= c.key) AS behind FROM c LEFT JOIN vis ON true GROUP BY c.id""")
def cursor_rest(spark, sf):
    """Live rows left to cursors that move either way."""
    at = L.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("u/"), F.lpad((F.col("user_id") * 3 % 400).cast("string"), 6, "0")).alias("key")).distinct()
    live = state(spark, sf, values=False)
    return reads.rest(live, at).withColumnRenamed("rows", "ahead").join(reads.rest(live, at, reverse=True).withColumnRenamed("rows", "behind"), "id")


@query("SELECT count(*) FILTER (kind <> 2 AND key >= 'u/000010' AND key < 'u/000090') AS versions, count(*) FILTER (kind = 2 AND key < 'u/000090' AND end_key > 'u/000010') AS tombstones FROM log, p WHERE seq <= s")
def scan_steps(spark, sf):
    """What a scan has to look at."""
    return reads.steps_examined(L.versions(spark, sf), L.tombstones(spark, sf), "u/000010", "u/000090", L.snapshot(spark, sf))


@query(", nl AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log WHERE kind <> 2 GROUP BY key) SELECT key, value FROM nl WHERE kind = 1")
def store_run(spark, sf):
    """A run of puts and deletes written outside a store that holds other values, and ingested."""
    s, path = _store(spark, "run"), new_path(spark, "run")
    last = reads.newest(L.versions(spark, sf))
    s.write(last.select(F.col("seq").alias("pos"), F.lit("default").alias("cf"), F.lit("put").alias("op"), "key", F.lit("old").alias("value")))
    write_run(last.select("key", "kind", "value"), path)
    ingest_run(s, path)
    return s.as_of().select("key", "value")


@query("SELECT key, seq, value FROM vis")
def history_tier(spark, sf):
    """Versions that GC removes, put in a second root first (twice, to no effect), give reads at an old snapshot back."""
    s, tier, at = _written(spark, sf, "tier"), HistoryTier(spark, new_path(spark, "tier")), L.snapshot(spark, sf)
    before, ranges = s.log()
    tier.put(before.where(F.col("seq") <= at))
    tier.put(before.where(F.col("seq") <= at))
    s.compact(oldest=L.last_sequence(spark, sf))
    return reads.visible(tier.restore(s.versions(), at), ranges, at, by=("cf", "key")).select("key", "seq", "value")


@query(", nl AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log WHERE kind <> 2 GROUP BY key) SELECT seq, key, CASE kind WHEN 1 THEN 'put' ELSE 'delete' END AS kind, CASE kind WHEN 1 THEN value END AS value FROM nl")
def feed_cache(spark, sf):
    """The latest change of each key, cached at the snapshot and brought to the end by the changes after it."""
    c, v = FeedCache(spark, new_path(spark, "feed")), L.versions(spark, sf)
    c.store(v, L.snapshot(spark, sf))
    return c.store(v, L.last_sequence(spark, sf)).select("seq", "key", "kind", "value")
