"""Change feed of a versioned log: windows, folds with a cursor, stitching of snapshots and streams, and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.txn import SnapshotTooOld

CHANGE = ["seq", "key", "kind", "value"]


def changes(versions: DataFrame, tombstones: DataFrame, after: int, upto: int | None = None, retained: int = 0) -> DataFrame:
    """The exact feed (after, upto] in order of seq; upto null reads to the end. Below the retention watermark it fails."""
    if after < retained:
        raise SnapshotTooOld(f"changes after {after}: history begins at {retained}")
    v = versions.select("seq", "key", F.when(F.col("kind") == 1, "put").otherwise("delete").alias("kind"), "value")
    r = tombstones.select("seq", F.col("start").alias("key"), F.lit("delete_range").alias("kind"), F.col("end").alias("value"))
    window = (F.col("seq") > after) & (F.lit(True) if upto is None else F.col("seq") <= upto)
    return v.where(window).unionByName(r.where(window)).orderBy("seq")


def changes_latest(versions: DataFrame, after: int) -> DataFrame:
    """The last change of each key after a sequence: enough to seed last-write-wins folds, and never too old."""
    x = versions.where(F.col("seq") > after).groupBy("key").agg(F.max_by(F.struct("seq", "kind", "value"), "seq").alias("c"))
    return x.select("c.seq", "key", F.when(F.col("c.kind") == 1, "put").otherwise("delete").alias("kind"), "c.value")


def merge_latest(cache: DataFrame, delta: DataFrame) -> DataFrame:
    """Latest change by key of a cache and a delta; replays change nothing."""
    return cache.unionByName(delta).groupBy("key").agg(F.max_by(F.struct("seq", "kind", "value"), "seq").alias("c")).select("c.seq", "key", "c.kind", "c.value")


def fold(state: DataFrame, updates: DataFrame) -> DataFrame:
    """state(key, value, seq), updates(seq, op put / delete / purge, key, value) -> the new state; updates at or below a key's seq are skipped."""
    u = updates.select("key", "value", "seq", F.col("op"), F.lit(0).alias("held"))
    x = state.select("key", "value", "seq", F.lit("put").alias("op"), F.lit(1).alias("held")).unionByName(u)
    best = x.groupBy("key").agg(F.max_by(F.struct("value", "seq", "op"), F.struct("seq", "held", "op", "value")).alias("b"))
    return best.where("b.op = 'put'").select("key", "b.value", "b.seq")


def gaps(deltas: DataFrame, cutoff: int, block: int = 4096) -> DataFrame:
    """deltas(feed, seq) after a snapshot at cutoff -> by feed: rows skipped as already in the snapshot or repeated, first gap, last contiguous seq.

    first_gap is the sequence that is missing; a feed with one is refused as a whole. Neighbours are compared inside blocks of sequences, and the
    ends of blocks with each other, so a hot feed is not sorted in one task.
    """
    fresh = deltas.where(F.col("seq") > cutoff).select("feed", "seq").distinct().withColumn("bin", F.floor(F.col("seq") / block))
    before = F.lag("seq").over(Window.partitionBy("feed", "bin").orderBy("seq"))
    missing = lambda at, last: F.min(F.when(F.col(at) > F.col(last) + 1, F.col(last) + 1))
    bins = fresh.withColumn("before", before).groupBy("feed", "bin").agg(missing("seq", "before").alias("inside"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("before", F.coalesce(F.lag("high").over(Window.partitionBy("feed").orderBy("bin")), F.lit(cutoff)))
    g = bins.groupBy("feed").agg(F.least(F.min("inside"), missing("low", "before")).alias("first_gap"), F.max("high").alias("last_seq"), F.sum("n").alias("fresh"))
    total = deltas.groupBy("feed").agg(F.count(F.lit(1)).alias("total"))
    return total.join(g, "feed", "left").select("feed", (F.col("total") - F.coalesce("fresh", F.lit(0))).alias("skipped"), "first_gap", "last_seq")


def federated(state: DataFrame, deltas: DataFrame, cutoff: int) -> DataFrame:
    """state(feed, key, value) at cutoff, deltas(feed, seq, op, key, value) -> the new state (feed, key, value).

    Repeated and already contained deltas are skipped; a feed with a gap keeps its state as it was.
    """
    ok = gaps(deltas, cutoff).where("first_gap is null").select("feed")
    d = deltas.where(F.col("seq") > cutoff).join(ok, "feed", "left_semi").select("feed", "key", "seq", "op", "value")
    x = state.select("feed", "key", F.lit(cutoff).cast("long").alias("seq"), F.lit("put").alias("op"), "value").unionByName(d)
    best = x.groupBy("feed", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("b"))
    return best.where("b.op = 'put'").select("feed", "key", "b.value")


def needs_rebuild(cached_to: int | None, log_from: int, last: int) -> bool:
    """Whether the feed cache must be built again from the versions: it is missing, or ends before the log that is left begins."""
    return cached_to is None or cached_to < min(log_from - 1, last)


def should_store(commits_since: int, interval: int) -> bool:
    """Whether a commit stores the feed cache; interval 0 leaves that to flushes and checkpoints."""
    return 0 < interval <= commits_since


def within_budget(live: int, budget: int = 100_000) -> bool:
    """Whether a flush may build the feed cache again from the live rows, rather than leave it behind for the next reader."""
    return live <= budget


class FeedCache:
    """The latest change of each key up to a sequence, in folders `upto=N` of a root. A folder without Spark's success mark was not finished and is not read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
        return sorted(int(n[5:]) for n in names if n.startswith("upto=") and self._fs.exists(self._path(n, "_SUCCESS")))

    def load(self) -> tuple[DataFrame, int] | None:
        """The newest finished cache and the sequence that it goes to."""
        done = self._finished()
        return (self.spark.read.parquet(f"{self.root}/upto={done[-1]}"), done[-1]) if done else None

    def store(self, versions: DataFrame, upto: int, keep: int = 2) -> DataFrame:
        """Bring the cache to `upto`: from its last state and the versions after it, or from all versions. Older ones than the last `keep` are deleted."""
        held = self.load()
        if held and held[1] >= upto:
            return held[0]
        x = changes_latest(versions.where(F.col("seq") <= upto), held[1] if held else 0)
        x = merge_latest(held[0], x) if held else x
        x.write.mode("overwrite").parquet(f"{self.root}/upto={upto}")
        for n in self._finished()[:-keep]:
            self._fs.delete(self._path(f"upto={n}"), True)
        return self.load()[0]


def prune_watermark(families: DataFrame, pins: DataFrame) -> DataFrame:
    """families(cf, last_flushed_seq, min_active_seq), pins(seq) -> the sequence below which segments can go; none without families."""
    f = families.agg(F.min(F.least(F.col("last_flushed_seq") + 1, F.coalesce("min_active_seq", F.lit((1 << 62))))).alias("f"))
    return f.crossJoin(pins.agg(F.min("seq").alias("p"))).select(F.when(F.col("f").isNull(), F.lit(0)).otherwise(F.least("f", F.coalesce("p", "f"))).alias("watermark"))


def replay(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """records(cf, seq, ...) above the checkpoint of their family; families without one are replayed whole."""
    return records.join(checkpoints.select("cf", F.col("seq").alias("tl_from")), "cf", "left").where(F.col("tl_from").isNull() | (F.col("seq") > F.col("tl_from"))).drop("tl_from")


def truncation_losses(records: DataFrame, checkpoints: DataFrame, upto: int) -> DataFrame:
    """Families (cf, lost) whose records at or below `upto` lie above their checkpoint: the log must not be cut there while any is left."""
    return replay(records.where(F.col("seq") <= upto), checkpoints).groupBy("cf").agg(F.count(F.lit(1)).alias("lost"))


def strict_stitch(deltas: DataFrame, cutoff: int) -> DataFrame:
    """deltas(feed, seq) -> feed, ok: it begins right after the cutoff, without overlap, repeat or gap."""
    x = gaps(deltas, cutoff)
    return x.select("feed", ((F.col("skipped") == 0) & F.col("first_gap").isNull() & F.col("last_seq").isNotNull()).alias("ok"))


def tail(store, sink, checkpoint: str, after: int = 0, **trigger):
    """Follow a store: sink(changes, batch number) for what each batch of new manifests added, in order of seq.

    The stream reads the manifests; a batch reaches from the last sequence of the manifest before its first to that of its last. A batch that is run again
    has the same changes, unless a compaction has removed versions since, which fails as SnapshotTooOld.
    """
    files = store.spark.readStream.schema("value string").option("wholetext", "true").text(f"{store.root}/manifest")
    numbers = files.select(F.get_json_object("value", "$.n").cast("long").alias("n"), F.get_json_object("value", "$.last").cast("long").alias("last"))

    def run(batch: DataFrame, number: int) -> None:
        first, last = batch.agg(F.min("n"), F.max("last")).first()
        if last is None:
            return
        begin = max(after, store.manifest(first - 1)["last"] if first else 0)
        m = store.manifest()
        if last > begin:
            sink(changes(store.versions(m), store.tombstones(m), begin, last, m["oldest"]), number)

    return numbers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_stream(source: DataFrame, store, family: str = "default", checkpoint: str | None = None, name: str = "default", **trigger):
    """Fold a stream of (seq, op, key, value) into a store: state and cursor in one commit for each micro-batch.

    A batch that is run again finds its rows at or below the cursor of the source `name` and changes nothing, so the sink is exactly-once. The source
    hands on its rows in order of seq.
    """

    def sink(batch: DataFrame, _: int) -> None:
        store.fold(batch, family, name)

    writer = source.writeStream.foreachBatch(sink).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def window_counts(events: DataFrame, length: str, delay: str) -> DataFrame:
    """Event-time windows for streams of (ts, key): counts by key, late rows beyond the delay dropped by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "key").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "key", "n")
