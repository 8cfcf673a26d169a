"""Folds of operands and measures over a versioned log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .visible import covering, numbered

I64_MAX, I64_MIN = (1 << 63) - 1, -(1 << 63)


def base_and_operands(mutations: DataFrame, seq: int | None = None, merge_kind: int = 3) -> DataFrame:
    """Keep, of each key, the newest put or delete and the operands above it."""
    m = mutations if seq is None else mutations.where(F.col("seq") <= seq)
    base = m.groupBy("key").agg(F.max(F.when(F.col("kind") != merge_kind, F.col("seq"))).alias("tl_base"))
    return m.join(base, "key").where(F.col("tl_base").isNull() | (F.col("seq") >= F.col("tl_base"))).select(*m.columns)


def fold_append(mutations: DataFrame, seq: int | None = None, separator: str = ":") -> DataFrame:
    """Newest base, then operands oldest first, joined by the separator; a key whose newest base is a delete and has no operand is absent."""
    x = base_and_operands(mutations, seq).where("kind <> 0")
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return x.groupBy("key").agg(F.array_join(F.transform(parts, lambda s: s["value"]), separator).alias("value"))


def cut(mutations: DataFrame, tombstones: DataFrame, seq: int) -> DataFrame:
    """mutations of each key above the highest tombstone over it, found by an as-of join with the pieces of the tombstones."""
    over = covering(mutations.select("key"), tombstones.where(F.col("seq") <= seq)).withColumnRenamed("cover", "tl_cut")
    return mutations.join(over, "key", "left").where(F.col("tl_cut").isNull() | (F.col("seq") > F.col("tl_cut"))).drop("tl_cut")


def fold_append_with_tombstones(mutations: DataFrame, tombstones: DataFrame, seq: int, separator: str = ":") -> DataFrame:
    """As fold_append, with the history of a key cut at the highest tombstone that covers it."""
    return fold_append(cut(mutations, tombstones, seq), seq, separator)


def fold_operands(mutations: DataFrame, tombstones: DataFrame, seq: int, separator: str = ":") -> DataFrame:
    """key, seq (the newest that took part) and value of the live keys of a log of puts, deletes and operands to append."""
    x = base_and_operands(cut(mutations, tombstones, seq), seq).where("kind <> 0")
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return x.groupBy("key").agg(F.max("seq").alias("seq"), F.array_join(F.transform(parts, lambda s: s["value"]), separator).alias("value"))


def fold_typed(operands: DataFrame, block: int = 4096) -> DataFrame:
    """(key, seq, type in put / counter_add / append, payload binary, delta long) -> key, total, payload, error.

    A put overwrites with both its delta and its payload. After the newest put, counters add (saturating) and appends follow its payload; a key with both
    after it has mixed types and is an error, as is an unknown type.
    """
    base = operands.groupBy("key").agg(F.max(F.when(F.col("type") == "put", F.col("seq"))).alias("tl_base"))
    x = operands.join(base, "key").where(F.col("tl_base").isNull() | (F.col("seq") >= F.col("tl_base"))).drop("tl_base")
    n = lambda t: F.count_if(F.col("type") == t)
    parts = F.array_sort(F.collect_list(F.when(F.col("type") != "counter_add", F.struct("seq", F.hex("payload").alias("h")))))
    kinds = x.groupBy("key").agg(n("counter_add").alias("c"), n("append").alias("a"), F.count_if(~F.col("type").isin("put", "counter_add", "append")).alias("other"), F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("payload"))
    totals = fold_counter(x.where("type in ('put', 'counter_add')").select("key", "seq", "type", F.coalesce("delta", F.lit(0)).alias("delta")), block)
    error = F.when(F.col("other") > 0, "unknown type").when((F.col("c") > 0) & (F.col("a") > 0), "mixed types")
    out = kinds.join(totals, "key", "left").withColumn("error", error)
    return out.select("key", F.when(F.col("error").isNull() & (F.col("a") == 0), F.col("total")).alias("total"), F.when(F.col("error").isNull() & (F.col("c") == 0), F.col("payload")).alias("payload"), "error")


def fold_counter(operands: DataFrame, block: int = 4096) -> DataFrame:
    """(key, seq, type in put / counter_add, delta) -> saturating 64-bit sum in order of seq; a put overwrites.

    Saturating addition is not associative, but the functions x -> min(high, max(low, x + add)) are closed under composition, and a put is
    one with low = high. Operands are composed within blocks of sequences, then blocks in order, so a hot key is no single long list.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    low, high = wide(F.lit(I64_MIN)), wide(F.lit(I64_MAX))

    def clamp(x: Column, f: Column) -> Column:
        return wide(F.least(F.greatest(wide(x), f["low"]), f["high"]))

    def compose(f: Column, g: Column) -> Column:
        """f first, then g; 38 digits hold the sum of 10^19 additions."""
        return F.struct(wide(f["add"] + g["add"]).alias("add"), clamp(f["low"] + g["add"], g).alias("low"), clamp(f["high"] + g["add"], g).alias("high"))

    none = F.struct(wide(F.lit(0)).alias("add"), low.alias("low"), high.alias("high"))
    put = F.col("type") == "put"
    step = F.struct(F.when(put, wide(F.lit(0))).otherwise(wide(F.col("delta"))).alias("add"), F.when(put, wide(F.col("delta"))).otherwise(low).alias("low"), F.when(put, wide(F.col("delta"))).otherwise(high).alias("high"))

    def folded(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        steps = F.array_sort(F.collect_list(F.struct(order, "f")))
        return rows.groupBy(*by).agg(F.aggregate(steps, none, lambda a, s: compose(a, s["f"])).alias("f"))

    x = operands.select("key", "seq", step.alias("f"), F.floor(F.col("seq") / block).alias("bin"))
    x = folded(folded(x, ["key", "bin"], "seq"), ["key"], "bin")
    return x.select("key", clamp(F.col("f.add"), F.col("f")).cast("long").alias("total"))


def fold_bits(operands: DataFrame, value: str = "value") -> DataFrame:
    """Bitwise or of 64-bit words by key."""
    return operands.groupBy("key").agg(F.bit_or(value).alias("bits"))


def fold_bytes(operands: DataFrame, value: str = "value") -> DataFrame:
    """Bitwise or of byte strings of any length by key, shorter ones filled with zeros on the right. Words of 8 bytes are folded on their own."""
    size = F.length(value)
    words = F.transform(F.sequence(F.lit(0), F.ceil(size / 8).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.conv(F.rpad(F.hex(F.substring(F.col(value), 8 * i + 1, F.lit(8))), 16, "0"), 16, -10).cast("long").alias("w")))
    x = operands.where(size > 0).select("key", F.explode(words).alias("x")).groupBy("key", "x.i").agg(F.bit_or("x.w").alias("w"))
    x = x.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.lpad(F.hex("w"), 16, "0").alias("h")))), lambda p: p["h"]), "").alias("h"))
    sizes = operands.groupBy("key").agg(F.max(size).alias("n"))
    return sizes.join(x, "key", "left").select("key", F.when(F.col("n").isNotNull(), F.unhex(F.substring(F.coalesce("h", F.lit("")), F.lit(1), 2 * F.col("n")))).alias("bits"))


def axiom_faults(values: DataFrame, combine: Callable[[Column, Column], Column], most: int = 64) -> DataFrame:
    """values(value), at most `most` distinct ones -> one row: pairs and triples on which combine isn't commutative, associative or idempotent.

    An operator without faults may be folded in any order and in parts, as aggregations are.
    """
    v = values.distinct()
    if v.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} values")
    a, b, c = (F.broadcast(v.select(F.col("value").alias(n))) for n in "abc")
    x = a.crossJoin(b).crossJoin(c)  # bounded by the check above
    A, B, C = F.col("a"), F.col("b"), F.col("c")
    differ = lambda p, q: F.count_if(~p.eqNullSafe(q))
    return x.agg(differ(combine(A, B), combine(B, A)).alias("commutative"), differ(combine(combine(A, B), C), combine(A, combine(B, C))).alias("associative"), differ(combine(A, A), A).alias("idempotent"))


def fold_extreme(operands: DataFrame, value: str = "value") -> DataFrame:
    """Greatest and least big-endian 8-byte number: unsigned byte order is numeric order; shorter strings count as none."""
    word = F.when(F.length(value) >= 8, F.substring(value, 1, 8))
    return operands.groupBy("key").agg(F.max(word).alias("greatest"), F.min(word).alias("least"))


def coalesce_operands(mutations: DataFrame, at: int, merge_kind: int = 3, separator: str = ":") -> DataFrame:
    """Rewrite: operands of a key at or below `at` become one of the highest seq among them; the answer of a later fold is the same."""
    old = base_and_operands(mutations.where(F.col("seq") <= at))
    merged = old.where(F.col("kind") == merge_kind).groupBy("key").agg(F.max("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), separator).alias("value")).withColumn("kind", F.lit(merge_kind))
    return old.where(F.col("kind") != merge_kind).select("key", "seq", "kind", "value").unionByName(merged.select("key", "seq", "kind", "value")).unionByName(mutations.where(F.col("seq") > at).select("key", "seq", "kind", "value"))


def measure(rows: DataFrame, by: list[str]) -> DataFrame:
    """Additive measures of versions (value bytes, records, tombstones, obsolete bytes) and the obsolete share in permille."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    newest = rows.groupBy("key").agg(F.max("seq").alias("tl_newest"))
    x = rows.join(newest, "key").withColumn("tl_size", size.cast("long")).withColumn("tl_old", F.col("seq") < F.col("tl_newest"))
    out = x.groupBy(*by).agg(F.sum("tl_size").alias("raw_bytes"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == 0).alias("tombstones"), F.sum(F.when(F.col("tl_old"), F.col("tl_size")).otherwise(0)).alias("obsolete_bytes"))
    return out.withColumn("obsolete_permille", F.when(F.col("raw_bytes") > 0, F.floor(1000 * F.col("obsolete_bytes") / F.col("raw_bytes"))).otherwise(0).cast("long"))


def combine(measures: DataFrame, checked: bool = True) -> DataFrame:
    """Sum of measures; checked sums fail on overflow, others stop at the largest long."""
    names = ["raw_bytes", "records", "tombstones", "obsolete_bytes"]
    if checked:
        return measures.agg(*[F.sum(n).alias(n) for n in names])
    return measures.agg(*[F.least(F.sum(F.col(n).cast("decimal(38,0)")), F.lit(I64_MAX).cast("decimal(38,0)")).cast("long").alias(n) for n in names])


def hybrid_clock(ticks: DataFrame, by: list[str] | None = None, block: int = 4096) -> DataFrame:
    """(n, wall) in order of n -> time = max(wall, time before + 1). Maxima are carried between bins of n, so one group is many tasks."""
    by = by or []
    x = ticks if by else ticks.withColumn("tl_all", F.lit(0))
    keys = by or ["tl_all"]
    x = numbered(x.withColumnRenamed("n", "tl_n"), keys, "tl_n", block).withColumnRenamed("n", "tl_r")
    x = x.withColumn("tl_ahead", F.col("wall") - F.col("tl_r")).withColumn("tl_bin", F.floor(F.col("tl_n") / block))
    tops = x.groupBy(*keys, "tl_bin").agg(F.max("tl_ahead").alias("tl_top"))
    tops = tops.select(*keys, "tl_bin", F.max("tl_top").over(Window.partitionBy(*keys).orderBy("tl_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("tl_before"))
    here = F.max("tl_ahead").over(Window.partitionBy(*keys, "tl_bin").orderBy("tl_n").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("tl_here", here).join(tops, [*keys, "tl_bin"]).withColumn("time", F.greatest("tl_here", F.coalesce("tl_before", "tl_here")) + F.col("tl_r"))
    return x.withColumnRenamed("tl_n", "n").select(*ticks.columns, "time")


def expired(now: Column, now_epoch: Column, created: Column, created_epoch: Column, ttl: Column) -> Column:
    """A record of an earlier epoch has expired; within an epoch it has when its age reaches its ttl. No ttl, no expiry."""
    return F.when(ttl.isNull(), False).when(created_epoch < now_epoch, True).otherwise(now - created >= ttl)


def remaining(now: Column, created: Column, ttl: Column) -> Column:
    return F.greatest(ttl - (now - created), F.lit(0))


def workload_class(z0: Column, z1: Column, q: Column, w: Column) -> Column:
    """The class of the one counter that is greater than all others, else mixed."""
    def top(x: Column, *rest: Column) -> Column:
        return x > F.greatest(*rest)

    return F.when(top(z0, z1, q, w), "PointMiss").when(top(z1, z0, q, w), "PointHit").when(top(q, z0, z1, w), "ShortRange").when(top(w, z0, z1, q), "WriteBurst").otherwise("Mixed")


def nth(samples: DataFrame, shares: list[float], by: list[str], rounded: bool, bins: int = 64) -> DataFrame:
    """Percentiles that are rows of the sample: index round(p * (n - 1)) or floor(n * p), never interpolated.

    Approximate quantiles cut each group in bins of about the same size; the counts of the bins tell which bin holds a wanted row and how many
    rows come before it, so only those bins are sorted, and no group is sorted as a whole.
    """
    cuts = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("tl_n"), F.array_sort(F.array_distinct(F.percentile_approx("value", [i / bins for i in range(1, bins)], 1000))).alias("tl_cuts"))
    x = samples.join(cuts, by).withColumn("tl_bin", F.size(F.filter("tl_cuts", lambda c: c < F.col("value"))))
    sizes = x.groupBy(*by, "tl_bin").agg(F.count(F.lit(1)).alias("tl_size"), F.first("tl_n").alias("tl_n"))
    before = F.sum("tl_size").over(Window.partitionBy(*by).orderBy("tl_bin")) - F.col("tl_size")
    index = lambda p: F.floor(F.lit(p) * (F.col("tl_n") - 1) + 0.5) if rounded else F.least(F.floor(F.col("tl_n") * p), F.col("tl_n") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), index(p).alias("i")) for i, p in enumerate(shares)]))
    places = sizes.withColumn("tl_before", before).select(*by, "tl_bin", "tl_before", "tl_size", wanted.alias("w")).where((F.col("w.i") >= F.col("tl_before")) & (F.col("w.i") < F.col("tl_before") + F.col("tl_size")))
    rows = x.select(*by, "tl_bin", "value").join(places.select(*by, "tl_bin").distinct(), [*by, "tl_bin"], "left_semi")
    rows = rows.withColumn("tl_i", F.row_number().over(Window.partitionBy(*by, "tl_bin").orderBy("value")) - 1)
    hit = rows.join(places, [*by, "tl_bin"]).where(F.col("tl_before") + F.col("tl_i") == F.col("w.i"))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("w.p") == i, F.col("value"))).alias(f"p{p * 1000:g}".replace(".", "_")) for i, p in enumerate(shares)])


#: Sequences that a pin may lag behind, and the hit ratio of a cache under load.
PIN_LAG, PIN_LAG_ACT, CACHE_REQUESTS, CACHE_HITS = 5_000, 20_000, 500, 0.5


def health(counters: DataFrame) -> DataFrame:
    """counters(..., last_sequence, oldest_pin, corruption, failures, hits, misses) -> with status and issues.

    An issue is degraded or asks for action; the status is the worst of them.
    """
    lag = F.greatest(F.col("last_sequence") - F.col("oldest_pin"), F.lit(0))
    asked = F.col("hits") + F.col("misses")
    rules = [
        ("corruption", F.col("corruption") > 0, 2),
        ("compaction_failing", F.col("failures") > 0, 2),
        ("pin_leak", lag >= PIN_LAG_ACT, 2),
        ("pin_lag", (lag >= PIN_LAG) & (lag < PIN_LAG_ACT), 1),
        ("cache_thrash", (asked >= CACHE_REQUESTS) & (F.col("hits") < CACHE_HITS * asked), 1),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("name"), F.lit(level).alias("level"))) for name, test, level in rules]), lambda x: x.isNotNull())
    x = counters.withColumn("tl_found", found)
    level = F.coalesce(F.array_max(F.transform("tl_found", lambda i: i["level"])), F.lit(0))
    return x.withColumn("status", F.when(level == 2, "action_required").when(level == 1, "degraded").otherwise("healthy")).withColumn("issues", F.array_join(F.transform("tl_found", lambda i: i["name"]), ",")).drop("tl_found")
