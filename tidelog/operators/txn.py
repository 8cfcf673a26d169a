"""Transactions as data: staging, overlays, validation of many transactions at once, and conflict graphs."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import keep
from .visible import covering, lookup, numbered

T = TypeVar("T")


class SnapshotTooOld(RuntimeError):
    """A read below the retention watermark; never answered in part."""


@dataclass
class Transaction:
    """A snapshot, staged writes (the last one of a key wins) and the keys read. Reads see own writes first."""

    snapshot: int
    writes: dict[str, tuple[int, str | None]] = field(default_factory=dict)
    ranges: list[tuple[str, str]] = field(default_factory=list)
    reads: set[str] = field(default_factory=set)
    saved: list[tuple[dict, list, set]] = field(default_factory=list)

    def put(self, key: str, value: str) -> None:
        self.writes.pop(key, None)
        self.writes[key] = (1, value)

    def delete(self, key: str) -> None:
        self.writes.pop(key, None)
        self.writes[key] = (0, None)

    def delete_range(self, start: str, end: str) -> None:
        """An empty range inside a batch is skipped."""
        if start < end:
            self.ranges.append((start, end))
            for k in [k for k in self.writes if start <= k < end]:
                self.writes[k] = (0, None)

    def observe(self, key: str) -> None:
        self.reads.add(key)

    def get(self, spark: SparkSession, versions: DataFrame, tombstones: DataFrame, key: str) -> str | None:
        self.reads.add(key)
        if key in self.writes:
            return self.writes[key][1]
        if any(a <= key < b for a, b in self.ranges):
            return None
        row = lookup(spark.createDataFrame([(0, key)], "pos int, key string"), versions, tombstones, self.snapshot).first()
        return row["value"]

    def staged(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, kind, v) for k, (kind, v) in self.writes.items()], "key string, kind int, value string")

    def staged_ranges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.ranges, "start string, end string")

    def savepoint(self) -> None:
        self.saved.append((dict(self.writes), list(self.ranges), set(self.reads)))

    def rollback_to_savepoint(self) -> None:
        """Undo what was staged and read since the last savepoint, and forget it."""
        if not self.saved:
            raise ValueError("no savepoint")
        self.writes, self.ranges, self.reads = self.saved.pop()

    def rollback(self) -> None:
        self.writes, self.ranges, self.reads, self.saved = {}, [], set(), []


def overlay(state: DataFrame, staged: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Live rows with staged writes on top: staged puts shown, staged deletes and rows under staged ranges(start, end) hidden. state(key, value), staged(key, kind, value)."""
    rest = state.select("key", "value").join(staged, "key", "left_anti")
    if ranges is not None:
        hidden = covering(rest.select("key"), ranges.select("start", "end", F.lit(1).cast("long").alias("seq"))).select("key")
        rest = rest.join(hidden, "key", "left_anti")
    return rest.unionByName(staged.where("kind = 1").select("key", "value"))


def insert_if_absent(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, value) -> those whose key is not live, and the refused ones."""
    return rows.join(state, "key", "left_anti"), rows.join(state, "key", "left_semi")


def swap_if_equal(state: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(key, expected, value) -> with `swapped`: the live value equals the expected one; a null expectation asks for absence."""
    live = state.select("key", F.col("value").alias("tl_now"))
    return rows.join(live, "key", "left").withColumn("swapped", F.col("tl_now").eqNullSafe(F.col("expected"))).drop("tl_now")


def validate(txns: DataFrame, versions: DataFrame, tombstones: DataFrame, watermark: int = 0) -> DataFrame:
    """txns(tx_id, snapshot_seq, reads, writes) -> tx_id, fate: too_old, conflict or commit, all against the same log.

    A key read or written that has a version above the snapshot, or lies under a tombstone above it, is a conflict; too old beats it.
    Keys are exploded and joined with the newest version of each key only.
    """
    touched = txns.select("tx_id", "snapshot_seq", F.explode(F.array_union("reads", "writes")).alias("key"))
    top = versions.groupBy("key").agg(F.max("seq").alias("top"))
    by_key = touched.join(top, "key").where("top > snapshot_seq").select("tx_id")
    # under a tombstone above the snapshot: so is the key's newest tombstone
    by_range = touched.join(covering(touched, tombstones), "key").where("cover > snapshot_seq").select("tx_id")
    hit = by_key.unionByName(by_range).distinct().withColumn("hit", F.lit(True))
    fate = F.when(F.col("snapshot_seq") < watermark, "too_old").when(F.col("hit"), "conflict").otherwise("commit")
    return txns.join(hit, "tx_id", "left").select("tx_id", fate.alias("fate"))


def conflict_edges(txns: DataFrame, literal: bool = False, pack: int = 512) -> DataFrame:
    """rw edges (reader, writer): one read a key that another wrote after the reader's snapshot. `literal` compares key sets only.

    Readers and writers of a key are packed in order of time, `pack` a row; pairs of packs are dealt to as many tasks as they ask for and unfold there, so
    no pair is shuffled and a hot key is many tasks. A pair that shares several keys comes out at the least one; only ids that repeat need a distinct.
    """
    once = txns.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def packs(keys: str, seq: str, side: str) -> DataFrame:
        x = txns.select("tx_id", F.col(seq).alias("seq"), F.when(F.size(keys) > 1, F.col(keys)).alias("keys"), F.explode(F.array_distinct(keys)).alias("key"))
        x = numbered(x.withColumn("at", F.coalesce(F.col("seq").cast("long"), F.lit(0))), ["key"], "at").groupBy("key", F.floor((F.col("n") - 1) / pack).alias(f"{side}_pack"))
        return _cut(x.agg(F.collect_list(F.struct("tx_id", "seq", "keys")).alias(side), (F.min if side == "r" else F.max)("seq").alias(f"{side}_end")))

    e = packs("reads", "snapshot_seq", "r").join(packs("writes", "commit_seq", "w").hint("merge"), "key")
    if not literal:
        e = e.where("w_end > r_end")
    e = e.repartition(min(10_000, max(64, -(-e.count() // 32))), "key", "r_pack", "w_pack")
    e = e.select("key", "w", F.explode("r").alias("r")).select("key", "r", F.explode("w").alias("w")).where("r.tx_id <> w.tx_id")
    if not literal:
        e = e.where("w.seq > r.seq")
    e = e.where("r.keys is null or w.keys is null or key = array_min(array_intersect(r.keys, w.keys))")
    e = e.select(F.col("r.tx_id").alias("reader"), F.col("w.tx_id").alias("writer"))
    return e if once else e.distinct()


def concurrent_edges(txns: DataFrame, width: int = 1024) -> DataFrame:
    """rw edges (reader, writer) between transactions that overlap: each began before the other committed.

    Lifetimes are dealt to buckets of `width` sequences, so a hot key meets only writers of about the same time.
    """
    lived = F.explode(F.sequence(F.floor(F.col("snapshot_seq") / width), F.floor(F.col("commit_seq") / width))).alias("bucket")
    r = txns.select(F.col("tx_id").alias("reader"), F.col("snapshot_seq").alias("rs"), F.col("commit_seq").alias("rc"), "reads", lived).withColumn("key", F.explode("reads")).drop("reads")
    w = txns.select(F.col("tx_id").alias("writer"), F.col("snapshot_seq").alias("ws"), F.col("commit_seq").alias("wc"), "writes", lived).withColumn("key", F.explode("writes")).drop("writes")
    return r.join(w, ["key", "bucket"]).where("reader <> writer and wc > rs and ws < rc").select("reader", "writer").distinct()


def commit_dangers(txns: DataFrame, width: int = 1024) -> DataFrame:
    """Each transaction against those still active when it commits: tx_id, n_in (active readers of its writes), n_out (active writers of its reads), fate.

    Finished transactions have no edges any more. A transaction that is in both sets closes a cycle, which is tested first; one with edges in and out
    is the pivot of a dangerous structure.
    """
    lived = F.explode(F.sequence(F.floor(F.col("snapshot_seq") / width), F.floor(F.col("commit_seq") / width))).alias("bucket")
    other = txns.select(F.col("tx_id").alias("other"), F.col("snapshot_seq").alias("os"), F.col("commit_seq").alias("oc"), "reads", "writes", lived)
    side = lambda name, keys: other.select("other", "os", "oc", "bucket", F.explode(keys).alias("key"), F.lit(name).alias("side"))
    own = lambda name, keys: txns.select("tx_id", "commit_seq", F.floor(F.col("commit_seq") / width).alias("bucket"), F.explode(keys).alias("key"), F.lit(name).alias("side"))
    met = own("in", "writes").unionByName(own("out", "reads")).join(side("in", "reads").unionByName(side("out", "writes")), ["key", "bucket", "side"])
    met = met.where("tx_id <> other and os < commit_seq and oc > commit_seq").groupBy("tx_id", "other").agg(F.max((F.col("side") == "in").cast("int")).alias("i"), F.max((F.col("side") == "out").cast("int")).alias("o"))
    n = met.groupBy("tx_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max(F.col("i") * F.col("o")).alias("both"))
    fate = F.when(F.col("both") > 0, "cycle").when((F.col("n_in") > 0) & (F.col("n_out") > 0), "structure").otherwise("safe")
    return n.select("tx_id", "n_in", "n_out", fate.alias("fate"))


def reachable(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b) -> all pairs on a path, in doubling rounds; each one cuts lineage. All pairs come out: for small graphs, strong_components() answers cycles without them."""
    paths, known = edges.distinct(), -1
    for _ in range(rounds):
        x, y = paths.alias("x"), paths.alias("y")
        longer = x.join(y, F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        paths = _cut(paths.unionByName(longer).distinct())
        n = paths.count()
        if n == known:
            return paths
        known = n
    raise RuntimeError("paths longer than 2 ** rounds")


def trim(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(a, b) without the edges that can't be on a cycle, as nothing leads to their start or from their end."""
    known = -1
    for _ in range(rounds):
        n = edges.count()
        if n in (known, 0):
            return edges
        known = n
        edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        edges = _cut(edges)
    return edges


def _cut(df: DataFrame) -> DataFrame:
    """df computed, without its lineage, as a table in the shared folder."""
    return keep(df, "cut")


def _least(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, least): the smallest id that each id reaches, itself included. Labels of labels are taken too, so paths halve in a round."""
    now = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("least", F.col("id"))
    while True:
        near = edges.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("least").alias("near"))
        far = now.select(F.col("id").alias("least"), F.col("least").alias("far"))
        new = _cut(now.join(near, "id", "left").join(far, "least").select("id", F.least("least", "near", "far").alias("new"), F.col("least").alias("old")))
        now = new.select("id", F.col("new").alias("least"))
        if new.where("new < old").isEmpty():
            return now


def _search(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges between 0 .. n - 1 -> the least member of the component of each, by Tarjan's one search without recursion; -1 in components of one."""
    order = np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    index, low, at, inside = [-1] * n, [0] * n, first[:n], [False] * n
    stack: list[int] = []
    out = np.full(n, -1)
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                inside[v] = True
            while at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    path.append(w)
                    break
                if inside[w]:
                    low[v] = min(low[v], index[w])
            else:
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        inside[w] = False
                        members.append(w)
                        if w == v:
                            break
                    if len(members) > 1:
                        out[members] = min(members)
    return out


def _tarjan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges (a, b) of a graph -> (id, component); only ids of components of two or more."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    x = pd.concat(frames, ignore_index=True)
    names = np.unique(np.concatenate([x["a"].to_numpy(), x["b"].to_numpy()]))
    out = _search(len(names), np.searchsorted(names, x["a"].to_numpy()), np.searchsorted(names, x["b"].to_numpy()))
    some = np.flatnonzero(out >= 0)
    yield pd.DataFrame({"id": names[some], "component": names[out[some]]})


def strong_components(edges: DataFrame, small: int = 2_000_000) -> DataFrame:
    """(a, b) -> (id, component): ids that reach each other have one component, named by the smallest; ids that can't be on a cycle may be left out.

    A graph of at most `small` edges, counted, is searched in one task of bounded size. Larger ones take rounds over all tasks:
    Ids whose smallest reached and smallest reaching id are the same are in its component. Of the others only edges between equal pairs
    can be inside a component, and each round settles at least the smallest id of every pair.
    """
    left, out = _cut(edges.where("a <> b").distinct()), None
    if left.count() <= small:
        kind = left.schema["a"].dataType.simpleString()
        return _cut(left.coalesce(1).mapInPandas(_tarjan, f"id {kind}, component {kind}"))
    left = _cut(trim(left, 12))
    while not left.isEmpty():
        down = _least(left).withColumnRenamed("least", "lo")
        up = _least(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("least", "hi")
        marks = _cut(down.join(up, "id"))
        done = marks.where("lo = hi").select("id", F.col("lo").alias("component"))
        out = done if out is None else out.unionByName(done)
        rest = marks.where("lo <> hi")
        a, b = (rest.select(F.col("id").alias(c), "lo", "hi") for c in ("a", "b"))
        left = _cut(left.join(a, "a").join(b, ["b", "lo", "hi"]).select("a", "b"))
    return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0) if out is None else out


def on_cycle(edges: DataFrame) -> DataFrame:
    """(a, b) -> ids that reach themselves: members of strong components of two or more, and ids with an edge to themselves."""
    c = strong_components(edges)
    large = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(large, "component", "left_semi").select("id").unionByName(edges.where("a = b").select(F.col("a").alias("id"))).distinct()


def _entries(txns: DataFrame) -> DataFrame:
    """(id, key, w, seq): each key read (w 0) with the snapshot, each key written (w 1) with the commit."""
    r = txns.select(F.col("tx_id").alias("id"), F.explode(F.array_distinct("reads")).alias("key"), F.lit(0).alias("w"), F.col("snapshot_seq").cast("long").alias("seq"))
    w = txns.select(F.col("tx_id").alias("id"), F.explode(F.array_distinct("writes")).alias("key"), F.lit(1).alias("w"), F.col("commit_seq").cast("long").alias("seq"))
    return r.unionByName(w)


def conflict_steps(txns: DataFrame, width: int = 1000) -> DataFrame:
    """(a, b): a graph of strings in which transactions ("0:" and tx_id) reach each other as by their conflict edges, of N log N edges however hot a key."""
    return _steps(_entries(txns), width)


def _steps(entries: DataFrame, width: int = 1000) -> DataFrame:
    """The graph of conflict_steps() of (id, key, w, seq).

    The writes of a key in order of commit are the leaves of a tree of 16 branches a node; a reader leads to the few nodes that cover all leaves after its
    snapshot. A transaction may also lead to its own write. Ranks are counted in bins of `width` sequences first.
    """
    x = entries.select(F.concat(F.lit("0:"), F.col("id").cast("string")).alias("tx"), "key", "w", "seq").withColumn("bin", F.floor(F.col("seq") / width))
    base = x.groupBy("key", "bin").agg(F.sum("w").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("key").orderBy("bin")) - F.col("n"))
    order = Window.partitionBy("key", "bin").orderBy("seq", F.col("w").desc(), "tx").rowsBetween(Window.unboundedPreceding, 0)
    x = _cut(x.join(base, ["key", "bin"]).select("tx", "key", "w", (F.col("base") + F.sum("w").over(order) - F.col("w")).alias("at")))
    most = x.where("w = 1").agg(F.max("at")).first()[0] or 0
    depth = -(-most.bit_length() // 4)
    node = lambda t, i: F.concat_ws(":", F.lit("1"), t.cast("string"), i.cast("string"), "key")
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("t")
    # leaves from `at` on, as whole subtrees: on each level those before the next subtree of the level above
    low, high = "(at + (1L << 4 * t) - 1) >> 4 * t", f"CASE WHEN t = {depth} THEN 1L ELSE 16 * ((at + (1L << 4 * (t + 1)) - 1) >> 4 * (t + 1)) END"
    covers = x.where("w = 0").select("tx", "key", "at", levels).selectExpr("tx", "key", "t", f"{low} AS low", f"least({high}, ({most}L >> 4 * t) + 1) AS high").where("low < high")
    covers = covers.select(F.col("tx").alias("a"), "key", "t", F.explode(F.sequence("low", F.col("high") - 1)).alias("i")).select("a", node(F.col("t"), F.col("i")).alias("b"))
    leaves = x.where("w = 1")
    inner = leaves.select("key", "at", levels).where("t > 0").select("key", "t", F.expr("at >> 4 * (t - 1)").alias("i")).distinct()
    inner = inner.select(node(F.col("t"), F.expr("i >> 4")).alias("a"), node(F.col("t") - 1, F.col("i")).alias("b"))
    return covers.unionByName(inner).unionByName(leaves.select(node(F.lit(0), F.col("at")).alias("a"), F.col("tx").alias("b")))


def _reached(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of 0 .. n - 1 a start is or leads to."""
    order = np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    seen = np.zeros(n, bool)
    seen[start] = True
    todo, marks = np.flatnonzero(seen).tolist(), seen.tolist()
    while todo:
        v = todo.pop()
        for w in to[first[v] : first[v + 1]]:
            if not marks[w]:
                marks[w] = True
                todo.append(w)
    return np.array(marks, bool)


def _merged(x: pd.DataFrame) -> pd.DataFrame:
    """All entries of a block -> the same graph with each strong component as one transaction, named by its least id: it reads a key at the least snapshot and
    writes it at the greatest commit of its members. Rows with `found` name transactions that are now in a component for the first time.

    The writes of a key in order are a chain, each link leading to its writer and to the next link; a reader leads to the first link after its snapshot.

    A cycle that leaves the block leads back over one of its ends. If no edge passes over the block (`over`) and no path in it leads from a write that later blocks
    see (above `later`) to a read that sees earlier blocks (below `earlier`), it crosses one end only. So only what such a write reaches or what reaches such a read goes on.
    """
    names, tx = np.unique(x["id"].to_numpy(), return_inverse=True)
    _, seq = np.unique(x["seq"].to_numpy(), return_inverse=True)
    place = pd.factorize(x["key"])[0].astype(np.int64) * (int(seq.max()) + 1) + seq
    w = x["w"].to_numpy() == 1
    order = np.flatnonzero(w)[np.argsort(place[w], kind="stable")]
    chain, n = place[order], len(names)
    key = lambda p: p // (int(seq.max()) + 1)
    links = n + np.arange(len(order))
    on = np.flatnonzero(key(chain[1:]) == key(chain[:-1]))
    first = np.searchsorted(chain, place[~w], side="right")
    hit = first < len(chain)
    hit[hit] = key(chain[first[hit]]) == key(place[~w][hit])
    a, b = np.concatenate([links, links[on], tx[~w][hit]]), np.concatenate([tx[order], links[on] + 1, n + first[hit]])
    least = _search(n + len(order), a, b)[:n]
    # a transaction alone with links that lead to itself is no component
    large = least >= 0
    large[large] = np.bincount(least[large], minlength=n)[least[large]] > 1
    name = np.where(large, least, np.arange(n))
    single = np.ones(n, bool)
    single[tx] = x["single"].to_numpy()
    y = pd.DataFrame({"id": names[name[tx]], "single": (single & ~large)[tx], "key": x["key"].to_numpy(), "w": x["w"].to_numpy(), "seq": x["seq"].to_numpy()})
    y = y.groupby(["id", "single", "key", "w"], sort=False, as_index=False)["seq"].agg(["min", "max"])
    y["seq"] = np.where(y["w"] == 1, y["max"], y["min"])
    gone = pd.DataFrame({"id": names[large & single], "single": True, "key": None, "w": 0, "seq": 0})
    if not x["over"].iloc[0]:
        enters, leaves = (w & (x["seq"] > x["later"])).to_numpy(), (~w & (x["seq"] < x["earlier"])).to_numpy()
        entered = _reached(n + len(order), a, b, tx[enters])[:n]
        if not entered[tx[leaves]].any():
            near = entered | _reached(n + len(order), b, a, tx[leaves])[:n]
            y = y[y["id"].isin(names[name[near]])]
    out = pd.concat([y.assign(found=False), gone.assign(found=True)], ignore_index=True)
    return out.assign(block=x["block"].iloc[0])[["id", "single", "key", "w", "seq", "found", "block"]]


def _useful(entries: DataFrame) -> DataFrame:
    """entries without reads that no write follows, writes that no read precedes, and ids that are left with only one of both."""
    ends = entries.groupBy("key").agg(F.min(F.when(F.col("w") == 0, F.col("seq"))).alias("low"), F.max(F.when(F.col("w") == 1, F.col("seq"))).alias("high"))
    x = entries.join(ends, "key").where(F.when(F.col("w") == 0, F.col("seq") < F.col("high")).otherwise(F.col("seq") > F.col("low"))).drop("low", "high")
    both = x.groupBy("id").agg(F.min("w").alias("r"), F.max("w").alias("t")).where("r = 0 and t = 1").select("id")
    return x.join(both, "id", "left_semi")


def _ends(entries: DataFrame) -> DataFrame:
    """entries with what other blocks see of their keys: `later`, the least read of the key in later blocks; `earlier`, its greatest write in earlier blocks; and whether an
    edge may pass `over` the block. One row a key and block."""
    low, high = F.min(F.when(F.col("w") == 0, F.col("seq"))).alias("low"), F.max(F.when(F.col("w") == 1, F.col("seq"))).alias("high")
    g = _cut(entries.groupBy("key", "block").agg(low, high))
    past = lambda *by: Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    next_ = lambda *by: Window.partitionBy(*by).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = lambda *by: (F.min("low").over(next_(*by)).alias("later"), F.max("high").over(past(*by)).alias("earlier"))
    blocks = g.groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("block", *both()).select("block", F.coalesce(F.col("later") < F.col("earlier"), F.lit(False)).alias("over"))  # a row a block
    return entries.join(g.select("key", "block", *both("key")).hint("merge"), ["key", "block"]).join(F.broadcast(blocks), "block")


def on_conflict_cycle(txns: DataFrame, width: int = 8192, small: int = 2_000_000) -> DataFrame:
    """tx_id of the transactions on a cycle of conflict edges: those whose strong component holds another transaction.

    Components of a part of the graph lie inside components of the whole. So those inside blocks of `width` commits are found first, one block a task, and each goes on
    as one transaction; what can't be on a cycle over the end of a block is left out; 16 blocks at a time then become one, until there is one. Where a block would
    still hold more than `small` entries, what is left is searched in rounds over all tasks.
    """
    at = F.floor(F.coalesce("commit_seq", "snapshot_seq", F.lit(0)) / width)
    blocks = txns.groupBy(F.col("tx_id").alias("id")).agg(F.min(at).alias("block"))
    x = _useful(_entries(txns).where("seq is not null and id is not null and key is not null")).withColumn("single", F.lit(True)).join(blocks, "id")
    kind = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    out = None
    while True:
        y = _cut(_ends(x).groupBy("block").applyInPandas(_merged, f"id {kind['id']}, single boolean, key {kind['key']}, w int, seq long, found boolean, block long"))
        found = y.where("found").select(F.col("id").alias("tx_id"))
        out = found if out is None else out.unionByName(found)
        x = _cut(_useful(y.where("not found").drop("found")))
        sizes = x.groupBy(F.floor(F.col("block") / 16).alias("wide"), "block").agg(F.count(F.lit(1)).alias("n")).groupBy("wide").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
        blocks_left, most = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if blocks_left < 2:
            return out
        if most > small:
            break
        x = x.withColumn("block", F.floor(F.col("block") / 16))
    c = _cut(strong_components(_steps(x), small).where("startswith(id, '0:')"))
    large = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = c.join(large, "component", "left_semi").select(F.substr("id", F.lit(3)).cast(kind["id"]).alias("id"))
    return out.unionByName(x.where("single").join(ids, "id", "left_semi").select(F.col("id").alias("tx_id")).distinct())


def dangerous(edges: DataFrame) -> DataFrame:
    """(reader, writer) rw edges -> (t_in, pivot, t_out) with t_in -rw-> pivot -rw-> t_out."""
    a = edges.select(F.col("reader").alias("t_in"), F.col("writer").alias("pivot"))
    b = edges.select(F.col("reader").alias("pivot"), F.col("writer").alias("t_out"))
    return a.join(b, "pivot").select("t_in", "pivot", "t_out")


def missing_causes(causal: DataFrame, recovered: DataFrame) -> DataFrame:
    """causal(tx_id, deps), recovered(tx_id) -> (tx_id, dep): dependencies of recovered transactions that were not recovered."""
    d = causal.join(recovered, "tx_id", "left_semi").select("tx_id", F.explode("deps").alias("dep"))
    return d.join(recovered.select(F.col("tx_id").alias("dep")), "dep", "left_anti").select("tx_id", "dep")


def two_phase(coordinators: DataFrame, participants: DataFrame) -> DataFrame:
    """coordinators(tx_id, state), participants(tx_id, node, state) -> tx_id, outcome, violation.

    The coordinator's durable record decides: committed commits, everything else (init, preparing, aborted, no record) aborts. A participant that
    contradicts the outcome, or one that committed without having prepared, is a violation.
    """
    p = participants.groupBy("tx_id").agg(F.count_if(F.col("state") == "committed").alias("committed"), F.count_if(F.col("state") == "aborted").alias("aborted"), F.count_if(F.col("state") == "unprepared").alias("unprepared"))
    x = coordinators.join(p, "tx_id", "full_outer")
    commit = F.coalesce(F.col("state") == "committed", F.lit(False))
    wrong = F.when(commit, (F.col("aborted") > 0) | (F.col("unprepared") > 0)).otherwise(F.col("committed") > 0)
    return x.select("tx_id", F.when(commit, "commit").otherwise("abort").alias("outcome"), F.coalesce(wrong, F.lit(False)).alias("violation"))


def index_faults(ops: DataFrame) -> DataFrame:
    """ops(batch, pk, target primary / index, op add / delete) -> (batch, pk, fault): index operations without their primary in the batch, deleted
    primaries without an index delete, added primaries without an index add."""
    n = lambda t, o: F.count_if((F.col("target") == t) & (F.col("op") == o))
    x = ops.groupBy("batch", "pk").agg(n("primary", "add").alias("pa"), n("primary", "delete").alias("pd"), n("index", "add").alias("ia"), n("index", "delete").alias("id"))
    fault = F.when((F.col("pa") + F.col("pd") == 0) & (F.col("ia") + F.col("id") > 0), "orphan_index").when((F.col("pd") > 0) & (F.col("id") == 0), "index_left").when((F.col("pa") > 0) & (F.col("ia") == 0), "index_missing")
    return x.withColumn("fault", fault).where("fault is not null").select("batch", "pk", "fault")


def min_active(pins: DataFrame, epoch: int) -> DataFrame:
    """pins(pin_id, seq, created_epoch, lease) -> the least sequence of the pins that have not expired, and their number."""
    return pins.where(F.lit(epoch) <= F.col("created_epoch") + F.col("lease")).agg(F.min("seq").alias("min_seq"), F.count(F.lit(1)).alias("active"))


def classify_batches(ops: DataFrame) -> DataFrame:
    """ops(batch, cf, pos, key, put) -> (batch, cf, sorted): only puts, in strictly ascending order, all above what earlier batches wrote to the family.

    Such batches can be appended as sorted files; the order of results is the same either way.
    """
    w = Window.partitionBy("batch", "cf").orderBy("pos")
    x = ops.withColumn("before", F.lag("key").over(w))
    b = x.groupBy("batch", "cf").agg(F.bool_and("put").alias("puts"), F.bool_and(F.coalesce(F.col("key") > F.col("before"), F.lit(True))).alias("rising"), F.min("key").alias("least"), F.max("key").alias("most"))
    # the highest key before a batch: of the bins of batches before, then within the bin
    b = b.withColumn("tl_bin", F.floor(F.col("batch") / 4096))
    tops = b.groupBy("cf", "tl_bin").agg(F.max("most").alias("top"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("cf", "tl_bin", F.max("top").over(before("cf").orderBy("tl_bin")).alias("tl_before"))
    b = b.withColumn("tl_here", F.max("most").over(before("cf", "tl_bin").orderBy("batch"))).join(tops, ["cf", "tl_bin"])
    return b.withColumn("high", F.greatest("tl_here", "tl_before")).select("batch", "cf", (F.col("puts") & F.col("rising") & F.coalesce(F.col("least") > F.col("high"), F.lit(True))).alias("sorted"))


@dataclass
class ReadToken:
    """A client's watermark: snapshots must not be zero, in the future, or below it; an accepted one raises it."""

    watermark: int = 0

    def acquire(self, seq: int, last: int) -> int:
        if seq == 0 or seq > last or seq < self.watermark:
            raise ValueError(f"snapshot {seq} refused: last {last}, watermark {self.watermark}")
        self.watermark = seq
        return seq


class LockTable:
    """Exclusive key locks of pessimistic transactions. A transaction waits for a key, whoever owns it by then; time is given by the caller."""

    def __init__(self) -> None:
        self.owner: dict[str, int] = {}
        self.waits: dict[int, str] = {}
        self.until: dict[int, float] = {}

    def lock(self, tx: int, key: str, now: float = 0.0, timeout: float | None = None, detect: bool = True) -> bool:
        """True if the lock is held now; False if tx waits, to ask again later.

        A wait that would close a circle is refused (RuntimeError), before its time is looked at. The time of a wait runs from its first call: one
        that is over, or none (timeout 0), is a TimeoutError, and tx waits no more. Without a timeout it waits for ever.
        """
        held = self.owner.setdefault(key, tx)
        if held == tx:
            self._stop(tx)
            return True
        if detect and self._circle(tx, held):
            self._stop(tx)
            raise RuntimeError("deadlock")
        if self.waits.get(tx) != key:
            self._stop(tx)
            self.waits[tx] = key
            if timeout is not None:
                self.until[tx] = now + timeout
        if now >= self.until.get(tx, float("inf")):
            self._stop(tx)
            raise TimeoutError(f"{key} is locked by {held}")
        return False

    def _circle(self, tx: int, at: int | None) -> bool:
        seen: set[int] = set()
        while at is not None and at not in seen:
            if at == tx:
                return True
            seen.add(at)
            key = self.waits.get(at)
            at = None if key is None else self.owner.get(key)
        return False

    def _stop(self, tx: int) -> None:
        self.waits.pop(tx, None)
        self.until.pop(tx, None)

    def release(self, tx: int) -> None:
        self.owner = {k: t for k, t in self.owner.items() if t != tx}
        self._stop(tx)


@dataclass
class Contention:
    """Counts over the transactions of a process."""

    conflicts: int = 0
    retried_commits: int = 0
    exhausted: int = 0


def retried(body: Callable[[], T], conflict: type[Exception], attempts: int = 64, counts: Contention | None = None, sleep: Callable[[float], None] = time.sleep) -> T:
    """Run a transaction until it meets no conflict, pausing longer each time; the last conflict is raised."""
    counts = counts or Contention()
    for attempt in range(attempts):
        try:
            out = body()
        except conflict:
            counts.conflicts += 1
            if attempt == attempts - 1:
                counts.exhausted += 1
                raise
            sleep(backoff(attempt) / 1000)
        else:
            counts.retried_commits += attempt > 0
            return out
    raise ValueError("no attempts")


def backoff(attempt: int, base_ms: int = 2, most_ms: int = 500, seed: int | None = None) -> float:
    """Milliseconds before the next attempt: doubling, capped, with half of it drawn at random."""
    full = min(most_ms, base_ms * 2**attempt)
    return full / 2 + random.Random(seed).uniform(0, full / 2)
