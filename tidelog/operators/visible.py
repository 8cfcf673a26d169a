"""Reads of a versioned log at a snapshot: newest version by key, range tombstones, scans, seeks and counts.

Versions: (cf?, key, seq, kind, value), kind 0 delete, 1 put. Tombstones: (cf?, start, end, seq), half open. Families are a plain
column: pass by=["cf", "key"] and the tombstones' cf takes part in the cover test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep

#: Tombstones up to this number are broadcast after they have been counted; beyond it the as-of join is used.
FEW = 2_000
#: Ranges of keys: at least CUTS, one for each ROWS rows, at most MOST; and keys sampled to place them.
CUTS, ROWS, MOST = 64, 1 << 20, 1024
SAMPLE = 4096


def newest(versions: DataFrame, seq: int | None = None, by: tuple[str, ...] = ("key",), values: bool = True) -> DataFrame:
    """The newest version of each key at or below seq: one map-side combined aggregation.

    Without values, sequence (56 bits) and kind are one number whose maximum is a hash aggregate, and the values are not even read. With
    values it is max_by, which Spark runs as a sort aggregate: rows are still combined before the shuffle.
    """
    v = versions if seq is None else versions.where(F.col("seq") <= seq)
    if not values:
        best = v.groupBy(*by).agg(F.max(F.shiftleft(F.col("seq").cast("long"), 8).bitwiseOR(F.col("kind").cast("long"))).alias("p"))
        return best.select(*by, F.shiftright("p", 8).alias("seq"), F.col("p").bitwiseAND(F.lit(255)).cast("int").alias("kind"))
    best = v.groupBy(*by).agg(F.max_by(F.struct("seq", "kind", "value"), F.struct("seq", "kind")).alias("v"))
    return best.select(*by, "v.seq", "v.kind", "v.value")


def cut_points(keys: DataFrame, most: int | None = None) -> list:
    """Values of the first column that cut it in ranges of about the same size, as many as the number of rows asks for (at most `most` - 1 if given).

    The sample has one key, that of least hash, for each of SAMPLE classes of hashes: combined in every task, so that SAMPLE rows meet at most.
    """
    name = keys.columns[0]
    h = keys.where(F.col(name).isNotNull()).select(F.col(name).alias("k"), F.xxhash64(name).alias("h"))
    found = h.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("c")).agg(F.min_by("k", "h").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    most = most or min(MOST, max(CUTS, -(-sum(r["n"] for r in found) // ROWS)))
    sample = sorted(r["k"] for r in found)
    return [sample[len(sample) * i // most] for i in range(1, most)] if len(sample) >= most else sample


def _range_of(key: Column, cuts: list) -> Column:
    """The number of cuts at or below the key. Many cuts are looked up in two steps."""
    if not cuts:
        return F.lit(0)
    lits = lambda values: F.array(*[F.lit(c) for c in values])
    below = lambda values: F.size(F.filter(values, lambda c: c <= key))
    width = max(32, int(len(cuts) ** 0.5) + 1)
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if len(groups) == 1:
        return below(lits(cuts))
    first = below(lits([g[0] for g in groups[1:]]))
    return first * width + below(F.element_at(F.array(*map(lits, groups)), first + 1))


def _ranges(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("tl_range", _range_of(F.col(key), cut_points(rows.select(key))))


def ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with n: the place of each, from 1, in the order of the columns: counted inside sampled ranges of the first one, and one row a range between them."""
    x = _ranges(rows, order[0])
    sums = x.groupBy("tl_range").agg(F.count(F.lit(1)).alias("c"))
    before = sums.select("tl_range", (F.sum("c").over(Window.orderBy("tl_range")) - F.col("c")).alias("tl_before"))  # at most MOST rows
    here = F.row_number().over(Window.partitionBy("tl_range").orderBy(*order))
    return x.withColumn("tl_here", here).join(F.broadcast(before), "tl_range").withColumn("n", F.col("tl_before") + F.col("tl_here")).drop("tl_range", "tl_here", "tl_before")


def numbered(rows: DataFrame, by: list[str], order: str, block: int = 4096) -> DataFrame:
    """rows with n: the place of each, from 1, in its group in order of a long column; groups are counted in bins of that column, so a hot one is many tasks."""
    x = rows.withColumn("tl_bin", F.floor(F.col(order) / block))
    sums = x.groupBy(*by, "tl_bin").agg(F.count(F.lit(1)).alias("c"))
    sums = sums.select(*by, "tl_bin", (F.sum("c").over(Window.partitionBy(*by).orderBy("tl_bin")) - F.col("c")).alias("tl_before"))
    here = F.row_number().over(Window.partitionBy(*by, "tl_bin").orderBy(order))
    return x.withColumn("tl_here", here).join(sums.hint("merge"), [*by, "tl_bin"]).withColumn("n", (F.col("tl_before") + F.col("tl_here")).cast("long")).drop("tl_bin", "tl_here", "tl_before")


def fragments(tombstones: DataFrame, cf: bool = False) -> DataFrame:
    """Disjoint pieces (cf?, start, end, seq) of the tombstones with the highest covering seq; filter by snapshot before.

    Pieces begin and end at starts and ends. Edges are numbered; a tombstone over the pieces [a, b) is cut in at most two aligned blocks of 2^k
    pieces for each k, blocks keep their maximum, and a piece takes the maximum of the blocks that it lies in, one for each k. So n tombstones
    cost n log n rows whatever they overlap, and no pair of tombstones or of a tombstone and a piece is made. The widest blocks, which hold
    most pieces, are broadcast: at most 2^11 rows.
    """
    by = ["cf"] if cf else []
    full = (lambda c: F.concat("cf", F.lit("\0"), F.col(c))) if cf else F.col
    t = tombstones.where(F.col("start") < F.col("end")).select(full("start").alias("start"), full("end").alias("end"), "seq")
    t = t.groupBy("start", "end").agg(F.max("seq").alias("seq"))
    edges = t.select(F.col("start").alias("key")).unionByName(t.select(F.col("end").alias("key"))).distinct()
    ranks = keep(ordered(edges, ["key"]).select("key", (F.col("n") - 1).alias("i")), "edges")
    top = max(1, ranks.count()).bit_length()
    ranks = ranks.hint("merge")  # never a broadcast of what grows with the tombstones
    spans = t.join(ranks.select(F.col("key").alias("start"), F.col("i").alias("a")), "start").join(ranks.select(F.col("key").alias("end"), F.col("i").alias("b")), "end")
    spans = spans.select("seq", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k")).selectExpr("seq", "k", "(a + (1L << k) - 1) >> k AS a", "b >> k AS b").where("a < b")
    ends = F.filter(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)), lambda x: x.isNotNull())
    blocks = spans.select("k", F.explode(ends).alias("block"), "seq").groupBy("k", "block").agg(F.max("seq").alias("seq"))
    pieces = ranks.select("i", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k")).selectExpr("i", "k", "i >> k AS block")
    wide = F.col("k") > top - 11
    found = pieces.where(wide).join(F.broadcast(blocks.where(wide)), ["k", "block"]).unionByName(pieces.where(~wide).join(blocks.where(~wide), ["k", "block"]))
    found = found.groupBy("i").agg(F.max("seq").alias("seq"))
    out = found.join(ranks.select("i", F.col("key").alias("start")), "i").join(ranks.select((F.col("i") - 1).alias("i"), F.col("key").alias("end")), "i")
    if not cf:
        return out.select("start", "end", "seq")
    at, tail = F.instr("start", "\0"), lambda c: F.substring(c, F.instr(c, "\0") + 1, F.length(c))
    return out.select(F.substring("start", F.lit(1), at - 1).alias("cf"), tail("start").alias("start"), tail("end").alias("end"), "seq").select(*by, "start", "end", "seq")


def as_of(probes: DataFrame, entries: DataFrame, key: str = "key", value: str = "value", forward: bool = False) -> DataFrame:
    """For each distinct probe key, `value` of the entry with the greatest key at or below it (forward: least at or above it).

    Keys are dealt to ranges by a bounded sample; each range is scanned in order, and what lies before a range is one row
    handed on by each range. The number of ranges follows the number of rows; no pair of rows is compared.
    """
    both = probes.select(F.col(key).alias("k"), F.lit(None).cast(entries.schema[value].dataType).alias("v"), F.lit(1).alias("probe")).distinct()
    both = both.unionByName(entries.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(0).alias("probe")))
    both = both.withColumn("range", _range_of(F.col("k"), cut_points(both.select("k"))))
    down = not forward
    order = [F.col("k").asc() if down else F.col("k").desc(), "probe"]
    here = F.last("v", ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    best = F.max_by("v", "k") if down else F.min_by("v", "k")
    ends = both.where("probe = 0").groupBy("range").agg(best.alias("v"))
    spans = both.select("range").distinct().join(ends, "range", "left")
    before = Window.orderBy(F.col("range").asc() if down else F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.select("range", F.last("v", ignorenulls=True).over(before).alias("carry"))  # at most MOST rows
    found = both.withColumn("here", here).where("probe = 1").join(F.broadcast(carry), "range")
    return found.select(F.col("k").alias(key), F.coalesce("here", "carry").alias(value))


def uncovered(points: DataFrame, tombstones: DataFrame, cf: bool = False) -> DataFrame:
    """points (key, seq, ...) without those under a tombstone of a higher seq. Tombstones must be filtered by the snapshot.

    A counted, small number of tombstones is broadcast. More are cut in disjoint pieces, and each key finds its piece by an
    as-of join; a family has its own keys in that case (cf, then a NUL, then the key). Of tombstones over the same range only the newest counts.
    """
    tombstones = tombstones.groupBy(*(["cf"] if cf else []), "start", "end").agg(F.max("seq").alias("seq"))
    if tombstones.limit(FEW + 1).count() <= FEW:
        t = tombstones.select(*[F.col(c).alias(f"t_{c}") for c in tombstones.columns])
        on = (F.col("t_start") <= F.col("key")) & (F.col("key") < F.col("t_end")) & (F.col("t_seq") > F.col("seq"))
        if cf:
            on = on & (F.col("cf") == F.col("t_cf"))
        return points.join(F.broadcast(t), on, "left_anti")
    full = (lambda k: F.concat("cf", F.lit("\0"), F.col(k))) if cf else F.col
    pieces = fragments(tombstones, cf).select(full("start").alias("key"), F.struct(full("end").alias("end"), F.col("seq").alias("seq")).alias("value"))
    probes = points.withColumn("tl_key", full("key"))
    found = as_of(probes.select(F.col("tl_key").alias("key")), pieces).select(F.col("key").alias("tl_key"), F.col("value").alias("tl_cover"))
    x = probes.join(found, "tl_key", "left")
    hidden = (F.col("tl_key") < F.col("tl_cover.end")) & (F.col("tl_cover.seq") > F.col("seq"))
    return x.where(~F.coalesce(hidden, F.lit(False))).drop("tl_key", "tl_cover")


def covering(keys: DataFrame, tombstones: DataFrame) -> DataFrame:
    """keys(key) -> distinct keys under a tombstone, and the highest sequence of those over each."""
    pieces = fragments(tombstones.groupBy("start", "end").agg(F.max("seq").alias("seq")))
    found = as_of(keys.select("key"), pieces.select(F.col("start").alias("key"), F.struct("end", "seq").alias("value")))
    return found.where(F.col("key") < F.col("value.end")).select("key", F.col("value.seq").alias("cover"))


def visible(versions: DataFrame, tombstones: DataFrame, seq: int | None = None, by: tuple[str, ...] = ("key",), values: bool = True) -> DataFrame:
    """Live keys at a snapshot: (by..., seq, value). The tombstone test follows the reduction, so it sees one row a key."""
    live = newest(versions, seq, by, values).where("kind = 1").drop("kind")
    t = tombstones if seq is None else tombstones.where(F.col("seq") <= seq)
    return uncovered(live, t, cf="cf" in by)


def lookup(keys: DataFrame, versions: DataFrame, tombstones: DataFrame, seq: int | None = None) -> DataFrame:
    """keys(pos, key), duplicates and order kept -> pos, key, state (found, deleted, not_found), value."""
    wanted = versions.join(keys.select("key").distinct(), "key", "left_semi")
    n = newest(wanted, seq)
    live = uncovered(n.where("kind = 1"), tombstones if seq is None else tombstones.where(F.col("seq") <= seq)).select("key", F.lit(True).alias("live"))
    n = n.join(live, "key", "left")
    out = keys.join(n, "key", "left")
    state = F.when(F.col("live"), "found").when(F.col("seq").isNotNull(), "deleted").otherwise("not_found")
    return out.select("pos", "key", state.alias("state"), F.when(F.col("live"), F.col("value")).alias("value"))


def bounds(lo: object = None, hi: object = None, lo_open: bool = False, hi_open: bool = True, key: str = "key") -> Column:
    """Included, excluded or unbounded on either side; the form that reaches the Parquet scan."""
    out = F.lit(True)
    if lo is not None:
        out = out & ((F.col(key) > lo) if lo_open else (F.col(key) >= lo))
    if hi is not None:
        out = out & ((F.col(key) < hi) if hi_open else (F.col(key) <= hi))
    return out


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all with the prefix; None if there is none."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes((p[-1] + 1,)) if p else None


def prefix_bounds(prefix: str | bytes, key: str = "key") -> Column:
    """startswith, and explicit range bounds that a scan can push down."""
    if isinstance(prefix, str):
        return F.col(key).startswith(prefix) & (F.col(key) >= prefix)
    end = prefix_end(prefix)
    return bounds(prefix, end, key=key)


def scan(state: DataFrame, where: Column | None = None, reverse: bool = False, limit: int | None = None, keys_only: bool = False) -> DataFrame:
    """Ordered scan of live rows; the limit counts live rows."""
    x = state if where is None else state.where(where)
    x = x.select("key") if keys_only else x
    x = x.orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return x if limit is None else x.limit(limit)


def count_ranges(ranges: DataFrame, state: DataFrame, cap: int | None = None, width: int = 5) -> DataFrame:
    """ranges(id, lo, hi) -> id, n: live keys in [lo, hi), at most cap.

    Prefix sums: the rank of a bound is the number of keys below it, so a range costs two as-of probes, however many keys it holds.
    """
    ranks = running_count(state.select("key").distinct())
    below = ranks.select("key", F.col("n").alias("value"))
    ends = ranges.select(F.col("lo").alias("key")).unionByName(ranges.select(F.col("hi").alias("key")))
    # keys below a bound: rank of the greatest key at or below it, less one if that key is the bound itself
    at = as_of(ends, below).join(ranks.select("key", F.lit(1).alias("same")), "key", "left").select("key", (F.coalesce("value", F.lit(0)) - F.coalesce("same", F.lit(0))).alias("r"))
    lo, hi = at.select(F.col("key").alias("lo"), F.col("r").alias("rl")), at.select(F.col("key").alias("hi"), F.col("r").alias("rh"))
    n = F.greatest(F.col("rh") - F.col("rl"), F.lit(0))
    out = ranges.join(lo, "lo").join(hi, "hi")
    return out.select("id", (n if cap is None else F.least(n, F.lit(cap))).cast("long").alias("n"))


def rest(state: DataFrame, at: DataFrame, reverse: bool = False) -> DataFrame:
    """Cursors at(id, key) -> (id, rows): live rows from the cursor's place to the end it moves to, the place itself included."""
    ranks = running_count(state.select("key").distinct())
    below = as_of(at.select("key"), ranks.select("key", F.col("n").alias("value"))).select("key", F.coalesce("value", F.lit(0)).alias("r")).distinct()
    x = at.join(below, "key").join(ranks.select("key", F.lit(1).alias("same")), "key", "left")
    if reverse:
        return x.select("id", F.col("r").cast("long").alias("rows"))
    total = ranks.agg(F.coalesce(F.max("n"), F.lit(0)).alias("total"))
    return x.crossJoin(F.broadcast(total)).select("id", (F.col("total") - F.col("r") + F.coalesce("same", F.lit(0))).cast("long").alias("rows"))  # one row


def steps_examined(versions: DataFrame, tombstones: DataFrame, lo: object, hi: object, seq: int) -> DataFrame:
    """One row (versions, tombstones): what a scan of [lo, hi) at a snapshot has to look at, live or not."""
    v = versions.where(bounds(lo, hi) & (F.col("seq") <= seq)).agg(F.count(F.lit(1)).alias("versions"))
    t = tombstones.where((F.col("start") < hi) & (F.col("end") > lo) & (F.col("seq") <= seq)).agg(F.count(F.lit(1)).alias("tombstones"))
    return v.crossJoin(t)


def running_count(keys: DataFrame) -> DataFrame:
    """Distinct keys -> key, n: keys at or below it."""
    return ordered(keys, ["key"]).select("key", "n")


def neighbours(state: DataFrame, group: list[Column] | None = None) -> DataFrame:
    """key -> previous and next live key, inside groups of keys (prefixes) if given, else over all keys: inside sampled ranges, and between their ends."""
    if group:
        w = Window.partitionBy(*group).orderBy("key")
        return state.select("key", F.lag("key").over(w).alias("prev_key"), F.lead("key").over(w).alias("next_key"))
    x = _ranges(state.select("key"), "key")
    ends = x.groupBy("tl_range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    order = Window.orderBy("tl_range")  # at most MOST rows
    ends = ends.select("tl_range", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    w = Window.partitionBy("tl_range").orderBy("key")
    x = x.withColumn("p", F.lag("key").over(w)).withColumn("q", F.lead("key").over(w)).join(F.broadcast(ends), "tl_range")
    return x.select("key", F.coalesce("p", "before").alias("prev_key"), F.coalesce("q", "after").alias("next_key"))


def last_under_prefix(state: DataFrame, prefix: Column, below: Column | None = None) -> DataFrame:
    """Greatest live key (below a bound) of each prefix: a map-side combined maximum."""
    x = state if below is None else state.where(F.col("key") < below)
    return x.groupBy(prefix.alias("prefix")).agg(F.max("key").alias("key"))


def sparse_row(fragments_: DataFrame, columns: list[int], seq: int) -> DataFrame:
    """(row_key, column_id, seq, value) -> rows all of whose wanted columns have one and the same newest seq at or below the snapshot."""
    x = fragments_.where(F.col("seq") <= seq).where(F.col("column_id").isin(columns))
    x = x.groupBy("row_key", "column_id").agg(F.max_by(F.struct("seq", "value"), "seq").alias("v"))
    out = x.groupBy("row_key").agg(F.min("v.seq").alias("lo"), F.max("v.seq").alias("hi"), F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("column_id") == c, F.col("v.value"))).alias(f"c{c}") for c in columns])
    return out.where((F.col("n") == len(columns)) & (F.col("lo") == F.col("hi"))).select("row_key", F.col("lo").alias("seq"), *[f"c{c}" for c in columns])


def scan_faults(rows: DataFrame, seq: int, expected: DataFrame | None = None) -> DataFrame:
    """Delivered scan rows (part, pos, key, seq, commit_id) -> one row of counts: order, repeats, future rows, partial commits.

    Parts are in order and so are the rows of a part: neighbours are compared inside parts, and the ends of parts with each other.
    """
    x = rows.withColumn("before", F.lag("key").over(Window.partitionBy("part").orderBy("pos")))
    inner = x.groupBy("part").agg(F.count_if(F.col("key") < F.col("before")).alias("disorder"), F.count_if(F.col("key") == F.col("before")).alias("repeats"), F.count_if(F.col("seq") > seq).alias("future"), F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
    ends = inner.withColumn("before", F.lag("last").over(Window.orderBy("part")))  # one row a part
    one = ends.agg(*[(F.sum(c) + F.count_if(t)).alias(c) for c, t in (("disorder", F.col("first") < F.col("before")), ("repeats", F.col("first") == F.col("before")))], F.sum("future").alias("future"))
    if expected is None:
        return one
    partial = rows.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).join(expected, "commit_id").where(F.col("n") != F.col("rows")).agg(F.count(F.lit(1)).alias("partial"))
    return one.crossJoin(partial)  # one row each
