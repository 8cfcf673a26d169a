"""The mutation log that the queries run on, made from the `events` table, and other fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(column: str, plus: int = 0):
    return F.concat(F.lit("u/"), F.lpad((F.col(column) + plus).cast("string"), 6, "0"))


def micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, kind (0 delete, 1 put, 2 range delete), value, end_key, cf, us. Only the columns that a query uses are read."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 2).otherwise(1)
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        user_key("user_id").alias("key"),
        kind.alias("kind"),
        F.when(kind == 1, F.concat_ws(":", "event_type", F.coalesce("props", F.lit("")))).alias("value"),
        user_key("user_id", 3).alias("end_key"),
        F.col("event_type").alias("cf"),
        micros("ts").alias("us"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("kind <> 2").select("seq", "key", "kind", "value")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("kind = 2").select(F.col("key").alias("start"), F.col("end_key").alias("end"), "seq")


def last_sequence(spark: SparkSession, sf_dir: str) -> int:
    """The newest sequence: the maximum of one column."""
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1


def snapshot(spark: SparkSession, sf_dir: str, tenths: int = 6) -> int:
    return last_sequence(spark, sf_dir) * tenths // 10


#: The same for DuckDB.
SQL = """
log AS (SELECT event_id + 1 AS seq, 'u/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key,
  CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 2 ELSE 1 END AS kind,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type || ':' || coalesce(props, '') END AS value,
  'u/' || lpad(CAST(user_id + 3 AS VARCHAR), 6, '0') AS end_key, event_type AS cf, epoch_us(ts) AS us FROM events),
p AS (SELECT max(seq) * 6 // 10 AS s, max(seq) AS last FROM log),
n AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log, p WHERE kind <> 2 AND seq <= s GROUP BY key),
vis AS (SELECT key, seq, value FROM n, p WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = 2 AND t.seq <= s AND t.key <= n.key AND n.key < t.end_key AND t.seq > n.seq))
"""
