"""What recovery of a log does with each thing it reads, and properties that a recovered or replicated log must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MOST_SKIPS = 4 * 1024 * 1024  # in a row before a search for the next record gives up
FRAMING = ("truncated", "length_corrupt", "unknown_type")  # faults behind which a record may begin


def collect_action(kind: Column, kept: Column, can_skip: Column, skips: Column, searching: Column) -> Column:
    """keep, stop, fail, prefix (keep what was read) or search (for the next record).

    kind is record, clean_end, one of FRAMING, checksum, zero_tail, orphan or other; `skips` counts this one. A wrong checksum or a zero header is
    damage of a real record and fails, unless a search is under way, whose own garbage it is then.
    """
    framing, garbage = kind.isin(*FRAMING), kind.isin("checksum", "zero_tail") & searching
    return (
        F.when(kind == "record", "keep")
        .when(kind == "clean_end", "stop")
        .when((framing | garbage) & ~can_skip, F.when(kept == 0, "fail").otherwise("prefix"))
        .when(garbage, "search")
        .when(framing & (skips <= MOST_SKIPS), "search")
        .otherwise("fail")
    )


def payload_action(length: Column, most: Column, payload_end: Column, block_end: Column, block_size: Column) -> Column:
    """read, fail (longer than any payload, or over the end of a full block) or truncated (over the end of a short last block)."""
    over = payload_end > block_end
    return F.when((length > most) | (over & (block_end == block_size)), "fail").when(over, "truncated").otherwise("read")


def fragment_action(kind: Column, empty: Column) -> Column:
    """yield, start, add, skip or fail, for a fragment full, first, middle, last or zero; `empty` says that no first one came before."""
    inner = kind.isin("middle", "last")
    return F.when(inner & empty, "fail").when(kind.isin("full", "last"), "yield").when(kind == "first", "start").when(kind == "middle", "add").when(kind == "zero", "skip")


def acks_durable(entries: DataFrame, survivors: DataFrame) -> DataFrame:
    """entries(log, pos, acked), survivors(log, survives) -> (log, holds): no acknowledged entry is at or behind the surviving prefix. A log without survivors kept nothing."""
    last = entries.groupBy("log").agg(F.max(F.when(F.col("acked"), F.col("pos"))).alias("last"))
    return last.join(survivors, "log", "left").select("log", F.coalesce(F.col("last") < F.coalesce("survives", F.lit(0)), F.lit(True)).alias("holds"))


def newest_answers(probes: DataFrame, answers: DataFrame) -> DataFrame:
    """probes(key, source, kind, value), answers(key, kind, value) -> (key, holds): the answer is what the newest source (the greatest) says; kind null is no answer."""
    first = probes.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "source").alias("want"))
    both = answers.select("key", F.struct("kind", "value").alias("got")).join(first, "key", "left")
    same = F.col("got.kind").eqNullSafe(F.col("want.kind")) & ((F.coalesce(F.col("got.kind"), F.lit(0)) != 1) | F.col("got.value").eqNullSafe(F.col("want.value")))
    return both.select("key", same.alias("holds"))


def all_or_nothing(txns: DataFrame, effects: DataFrame) -> DataFrame:
    """txns(tx_id, committed, aborted, staged), effects(tx_id, write) seen -> (tx_id, holds): all writes 0 to staged - 1 of a committed transaction, none of any other."""
    seen = effects.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("write").alias("d"), F.max("write").alias("high"), F.min("write").alias("low"))
    x = txns.join(seen, "tx_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = (F.col("n") == F.col("staged")) & ((F.col("n") == 0) | ((F.col("d") == F.col("n")) & (F.col("low") >= 0) & (F.col("high") < F.col("staged"))))
    return x.select("tx_id", (~(F.col("committed") & F.col("aborted")) & F.when(F.col("committed"), whole).otherwise(F.col("n") == 0)).alias("holds"))


def majority_held(served: Column, old_n: Column, old_yes: Column, joint: Column, new_n: Column, new_yes: Column) -> Column:
    """A served value has a majority of the old configuration and, while two are in force, of the new one too."""
    most = lambda n: F.floor(n / 2) + 1
    return ~served | ((old_yes >= most(old_n)) & (~joint | (new_yes >= most(new_n))))
