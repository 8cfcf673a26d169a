"""What several operators share: table access, the shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import _written, clear, keep, release, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_counted(rows: DataFrame, by_key: DataFrame, keys: list[str], total: int, count: str = "tl_n", hubs: int = 2000, least: int = 32) -> DataFrame:
    """rows joined with by_key, which has one row a key and in `count` the number of the key's rows; every key of rows is in by_key or the row goes.

    Keys with more than total / hubs rows, and more than `least`, are broadcast: at most `hubs` rows of by_key, whatever the size. All others
    are joined by their key, so no task gets more than a small share of the rows through one key. `count` is dropped.
    """
    limit = max(least, total // hubs)
    hot = by_key.where(F.col(count) > limit).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(by_key.where(F.col(count) <= limit).drop(count), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def connected_components(edges: DataFrame, rounds: int = 50, least: int = 32) -> DataFrame:
    """(a, b) links of longs -> (node, component): the smallest id that links reach.

    Alternating large-star and small-star rounds until the graph is a forest of stars; each round
    moves every link towards the smallest neighbour, so O(log^2) rounds are enough. Minima are map-side combined, and a node of very many
    links (a hub) meets its minimum by a broadcast of the hubs (join_counted), so its links are never gathered.
    Self-links are left out; nodes without a link to another are not returned.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    n, last = F.count(F.lit(1)).alias("tl_n"), e
    for _ in range(rounds):
        total = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), n)
        e = join_counted(both.where("v > u"), low, ["u"], total, least=least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"), n)
        moved = join_counted(e, low, ["u"], total, least=least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = last, keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(before)
        last = e
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p")))
        ends = ends.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
        if ends.where("c > 1 or (c > 0 and p > 0)").isEmpty():
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the index pairs (a, b) in label, in place; label[i] is the smallest index of i's set so far."""
    while len(a):
        x, y = label[a], label[b]
        m = x != y
        if not m.any():
            return
        a, b, x, y = a[m], b[m], x[m], y[m]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches sorted by the columns `by` -> batches that never split a group; holds one open group at most."""
    rest: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        last = np.ones(len(x), dtype=bool)
        for c in by:
            last &= (x[c] == x[c].iloc[-1]).to_numpy()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut == 0 and rest and all(rest[-1][c].iloc[-1] == x[c].iloc[0] for c in by):
            rest.append(x)
            continue
        whole = pd.concat([*rest, x.iloc[:cut]], ignore_index=True) if rest or cut else None
        if whole is not None and len(whole):
            yield whole
        rest = [x.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def starts(x: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Bounds of the groups of a sorted frame: starts of each, and the end."""
    if not len(x):
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(len(x), dtype=bool)
    new[0] = True
    for c in by:
        v = x[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(x))


def blocked(rows: DataFrame, key: list[str], spread: str, block: int, total: int, hubs: int = 2000) -> DataFrame:
    """Deal out the members of each key so that all pairs of members meet, in groups of at most about 2 * block.

    A key with at most `block` members is one group (bi = bj = 0). A larger one is cut in
    n = ceil(members / block) parts by the column `spread`; each pair of parts (bi <= bj) is a group, so a member is
    sent n times rather than once, and no task holds an oversized key. Adds bi, bj and mine (the member's own part).
    total: the number of rows, or more; keys with over total / hubs of them are told by a broadcast, at most `hubs` rows.
    """
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("tl_n")).where(F.col("tl_n") > block)
    hot = hot.select(*key, "tl_n", F.ceil(F.col("tl_n") / block).cast("int").alias("tl_parts"))
    limit = max(block, total // hubs)
    very = hot.where(F.col("tl_n") > limit).drop("tl_n")
    rest = rows.join(F.broadcast(very.select(*key)), key, "left_anti").join(hot.where(F.col("tl_n") <= limit).drop("tl_n"), key, "left")
    x = rows.join(F.broadcast(very), key).unionByName(rest).withColumn("tl_parts", F.coalesce("tl_parts", F.lit(1)))
    x = x.withColumn("mine", F.pmod(F.xxhash64(spread), F.col("tl_parts")).cast("int"))
    x = x.withColumn("tl_other", F.explode(F.sequence(F.lit(0), F.col("tl_parts") - 1)))
    x = x.withColumn("bi", F.least("mine", "tl_other")).withColumn("bj", F.greatest("mine", "tl_other"))
    return x.drop("tl_parts", "tl_other")
