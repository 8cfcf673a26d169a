"""Operator 1: embedding near-dedup by lattice hashing.

Vectors of equal components are one row first, with their count. Unit vectors are projected by TABLES x BLOCKS random orthonormal
maps to 8 dimensions, scaled, and decoded to the nearest point of the E8 lattice. A table's key joins the points of BLOCKS maps.
Each vector is filed under its own cell and under PROBES neighbouring cells of each block: the lattice neighbours whose
minimal vector points most in the direction in which the vector leaves the centre of its cell. Near vectors share at least one
cell of one table with high probability (the recall is measured in the tests), and every candidate is verified by cosine in double precision.

1. Cells are filed as (key, representative) only; keys with one member go, and vectors are fetched for what is left. Within a cell, vectors
   are compared by matrix products; what leaves a task is a spanning forest of the links found, never the pairs. A cell of more than BLOCK
   members is cut in parts. Inside a part members gather in balls: those within a quarter of the threshold's angle of a leader. Then
   leaders alone are compared across parts, and only the members of balls that this leaves undecided meet across parts, in pairs of parts.
2. Components follow from the forests.
3. All links lie inside components. Within each component every pair is compared once, which also finds links that the cells missed, and only the
   counts leave a task. Balls save work here too: all members of a ball link with each other; two balls whose angle is clear of the threshold on
   either side link wholly or not at all, so their counts follow from the leaders and weights. A component of more than BLOCK members is cut as a
   cell is. So a large group of near copies, which is few balls a part, is sent once. A large and loose component, whose balls are undecided,
   is sent as often as it has parts.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of
other lengths. n_links counts rows: copies of a vector link with each other. A null vec_id takes no part: n_links 0, component_id null,
kept null. A repeated vec_id keeps its rows. Ties are none: a link is a cosine at or above the threshold. An empty table gives an empty table. Other
columns (labels) are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocked, connected_components, grouped, hook, join_counted, keep, starts, table

COSINE = 0.95
TABLES = 4
BLOCKS = 2
PROBES = 3
SCALE = 0.26
BLOCK = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for k in range(256):
        signs = 1 - 2 * ((k >> np.arange(8)) & 1)
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


_ROOTS = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points of even sum: round, and where the sum is odd, round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: the better of D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def projections(dim: int, tables: int, blocks: int, seed: int = 17) -> np.ndarray:
    """(tables * blocks, dim, 8): orthonormal columns where dim allows it."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(tables * blocks):
        m = rng.normal(size=(dim, 8))
        out.append(np.linalg.qr(m)[0] if dim >= 8 else m / np.sqrt(8))
    return np.array(out)


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), 0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for c in np.rint(2 * points).astype(np.int64).T.astype(np.uint64):
        h = (h ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Unit vectors (n, dim) -> (n, keys): for each table, the own cell and those with one block replaced by a neighbour."""
    maps = projections(unit.shape[1], tables, blocks)
    # the spread of a projected unit vector in a coordinate is 1 / sqrt(dim): cells shrink with it
    unit = unit * (np.sqrt(unit.shape[1] / 64) / scale)
    out = []
    for t in range(tables):
        own, near = [], []
        for b in range(blocks):
            x = unit @ maps[t * blocks + b]
            c = nearest_e8(x)
            toward = np.argpartition(-((x - c) @ _ROOTS.T), probes, axis=1)[:, :probes]
            salt = t * blocks + b
            own.append(_hash(c, salt))
            near.append([_hash(c + _ROOTS[toward[:, k]], salt) for k in range(probes)])
        whole = sum(own, np.zeros(len(unit), dtype=np.uint64))
        out.append(whole)
        out += [whole - own[b] + h for b in range(blocks) for h in near[b]]
    return np.stack(out, axis=1).view(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors(vec_id, embedding) -> members (vec_id, h1, h2; hashes null if it can't link), and a row for each distinct vector."""
    e = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    v = vectors.select(F.col("vec_id").cast("long"), e.alias("embedding"), (finite & F.col("vec_id").isNotNull()).alias("ok"))
    v = v.withColumn("embedding", F.when(F.col("ok"), F.transform("embedding", lambda x: x + F.lit(0.0))))  # -0 becomes 0
    v = v.withColumn("h1", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), F.col("embedding"))))
    one = v.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by("embedding", "vec_id").alias("embedding"))
    return v.select("vec_id", "h1", "h2"), one


def _balls(u: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Leader of each row, and each leader's radius in radians: rows join the first leader within a quarter of the angle."""
    leader, free, radius, near = np.full(len(u), -1), np.arange(len(u)), np.zeros(len(u)), np.cos(angle / 4)
    while len(free):
        dot = u[free] @ u[free[0]]
        dot[0] = 1.0
        mine = dot >= near
        leader[free[mine]] = free[0]
        radius[free[0]] = np.arccos(np.clip(dot[mine].min(), -1, 1))
        free = free[~mine]
    return leader, radius


def _between(u: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Angles of rows and one vector, summed row by row, so that the same two vectors give the same angle in any task."""
    return np.arccos(np.clip((u * one).sum(axis=1), -1, 1))


def _units(x: pd.DataFrame, column: str = "vec") -> Callable[[np.ndarray], np.ndarray]:
    """Unit vectors of some rows of a frame; all are made at once where they have one length."""
    size = x[column].map(len)
    if len(x) and (size == size.iloc[0]).all():
        every = _unit(_matrix(x[column]))
        return lambda rows: every[rows]
    return lambda rows: _unit(_matrix(x[column].iloc[rows]))


def _groups(x: pd.DataFrame, keys: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows of each group of a sorted frame, those of vectors of another length apart, and whether the group is one part."""
    bounds, size = starts(x, keys), x["vec"].map(len).to_numpy()
    same = (x["bi"] == x["bj"]).to_numpy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if (size[lo:hi] == size[lo]).all():
            yield np.arange(lo, hi), bool(same[lo])
        else:
            for s in np.unique(size[lo:hi]):
                yield lo + np.flatnonzero(size[lo:hi] == s), bool(same[lo])


def _frame(out: list[tuple], **kinds: str) -> pd.DataFrame:
    """A frame of columns given in pieces; a piece of one value stands for as many as its row's first piece has."""
    columns = {}
    for i, (name, kind) in enumerate(kinds.items()):
        pieces = [r[i] if isinstance(r[i], np.ndarray) else np.full(len(r[0]), r[i], dtype=kind) for r in out]
        columns[name] = np.concatenate([np.zeros(0, dtype=kind), *pieces])
    return pd.DataFrame(columns)


_KEYS = ["key", "bi", "bj"]
_SLACK = 1e-9


def _dealt(rows: DataFrame, vectors: DataFrame, block: int, total: int, by: str = "rep", spread: str | None = None) -> DataFrame:
    """rows(key, <by>, ...) dealt to groups by blocked(), with the columns of vectors(<by>, ...), sorted by group."""
    x = blocked(rows, ["key"], spread or by, block, total).join(vectors, by)
    return x.repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def _parts(rows: DataFrame, sizes: DataFrame, vectors: DataFrame, block: int, total: int) -> DataFrame:
    """rows(key, rep) of the keys of sizes(key, tl_n), each key cut in parts as groups of their own (bi = bj), with the vectors."""
    x = join_counted(rows, sizes.withColumn("parts", F.ceil(F.col("tl_n") / block).cast("int")), ["key"], total)
    x = x.withColumn("bi", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("bj", F.col("bi"))
    return x.join(vectors, "rep").repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def links(reps: DataFrame, cosine: float = COSINE, block: int = BLOCK, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """reps(rep, vec binary of doubles) -> (a, b) of reps: a forest of the links found in the cells."""
    angle = float(np.arccos(cosine))
    vectors = reps.select("rep", "vec")

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            size = x["vec"].map(len)
            for _, part in x.groupby(size, sort=False):
                for lo in range(0, len(part), 512):
                    some = part.iloc[lo : lo + 512]
                    k = cells(_unit(_matrix(some["vec"])), tables=tables, probes=probes)
                    yield pd.DataFrame({"key": k.ravel(), "rep": np.repeat(some["rep"].to_numpy(), k.shape[1])})

    def forest(u: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each row's root, by links of left rows with right rows."""
        label = np.arange(len(u))
        for top in range(0, len(left), 512):
            i, j = np.nonzero(u[left[top : top + 512]] @ u[right].T >= cosine)
            i, j = left[i + top], right[j]
            hook(label, i[i != j], j[i != j])
        return label

    def edges(rep: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up = np.flatnonzero(label != np.arange(len(label)))
        return rep[up], rep[label[up]]

    def sides(x: pd.DataFrame, rows: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Indices within rows of the two parts that meet."""
        if same:
            return (np.arange(len(rows)),) * 2
        mine, bi = x["mine"].to_numpy()[rows], x["bi"].iloc[rows[0]]
        return np.flatnonzero(mine == bi), np.flatnonzero(mine != bi)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links within parts, and the balls of those keys that have other parts."""
        for x in grouped(batches, _KEYS):
            rep, key, many, out, found = x["rep"].to_numpy(), x["key"].to_numpy(), (x["parts"] > 1).to_numpy(), [], []
            units = _units(x)
            for rows, _ in _groups(x, _KEYS):
                if len(rows) == 1 and not many[rows[0]]:
                    continue
                u = units(rows)
                if len(rows) == 2 and not many[rows[0]]:
                    if u[0] @ u[1] >= cosine:
                        found.append((rep[rows[:1]], rep[rows[1:]]))
                    continue
                found.append(edges(rep[rows], forest(u, np.arange(len(rows)), np.arange(len(rows)))))
                if many[rows[0]]:
                    leader, radius = _balls(u, angle)
                    out.append((rep[rows], rep[rows[leader]], key[rows], radius[leader]))
            yield pd.concat([_frame(found, a="i8", b="i8").drop_duplicates().assign(key=0, radius=-1.0), _frame(out, a="i8", b="i8", key="i8", radius="f8")])

    def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of leaders across parts (radius -1), and leaders of balls that may hold others (radius 0)."""
        for x in grouped(batches, _KEYS):
            rep, key, reach, out = x["rep"].to_numpy(), x["key"].to_numpy(), x["radius"].to_numpy(), []
            units = _units(x)
            for rows, same in _groups(x, _KEYS):
                u = units(rows)
                left, right = sides(x, rows, same)
                label = forest(u, left, right)
                out.append((*edges(rep[rows], label), 0, -1.0))
                open_ = np.zeros(len(rows), dtype=bool)
                for i in left.tolist():
                    j = right[label[right] != label[i]]
                    close = _between(u[j], u[i]) - reach[rows[i]] - reach[rows[j]] <= angle + _SLACK
                    open_[j[close]] = True
                    open_[i] |= close.any()
                hit = rows[open_]
                out.append((rep[hit], rep[hit], key[hit], 0.0))
            yield _frame(out, a="i8", b="i8", key="i8", radius="f8")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in grouped(batches, _KEYS):
            rep, out, units = x["rep"].to_numpy(), [], _units(x)
            for rows, same in _groups(x, _KEYS):
                out.append(edges(rep[rows], forest(units(rows), *sides(x, rows, same))))
            yield _frame(out, a="i8", b="i8").drop_duplicates()

    filed = keep(vectors.mapInPandas(file, "key long, rep long"), "cells")
    total = filed.count()
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("tl_n")).where("tl_n > 1")
    row = "a long, b long, key long, radius double"
    first = keep(_parts(filed, sizes, vectors, block, total).mapInPandas(inside, row), "balls")
    found = first.where("radius < 0").select("a", "b")
    balls = first.where("radius >= 0").select("key", F.col("a").alias("rep"), F.col("b").alias("lead"), "radius")
    if balls.isEmpty():
        return found
    tops = balls.groupBy("key", F.col("lead").alias("rep")).agg(F.max("radius").alias("radius"))
    second = keep(_dealt(tops, vectors, block, total).mapInPandas(leaders, row), "leaders")
    left = second.where("radius >= 0").select("key", F.col("a").alias("lead")).distinct()
    third = _dealt(balls.join(left, ["key", "lead"]).select("key", "rep"), vectors, block, total).mapInPandas(across, "a long, b long")
    return found.unionByName(second.where("radius < 0").select("a", "b")).unionByName(third)


def counts(found: DataFrame, vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """found(node, component), vectors(rep, n, vec) -> rep, links: rows that each vector of a component links with, its own copies included."""
    angle = float(np.arccos(cosine))

    def tally(u: np.ndarray, n: np.ndarray, ball: np.ndarray, lead: np.ndarray, radius: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, decided: bool) -> np.ndarray:
        """Weights that rows of a and b link with; ball: the row's place in lead and radius. Pairs of balls decided by their leaders count if `decided`."""
        total = np.zeros(len(u), dtype=np.int64)
        if not len(a) or not len(b):
            return total
        lb, at = np.unique(ball[b], return_inverse=True)
        weight = np.bincount(at, n[b], minlength=len(lb)).astype(np.int64)
        order = a[np.argsort(ball[a], kind="stable")]
        la, first = np.unique(ball[order], return_index=True)
        for p, rows in zip(la.tolist(), np.split(order, first[1:]), strict=True):
            between = _between(lead[lb], lead[p])
            between[lb == p] = 0.0
            reach = radius[p] + radius[lb]
            every, none = between + reach <= angle - _SLACK, between - reach > angle + _SLACK
            if decided:
                total[rows] += weight[every].sum()
                if not same:
                    total[b[every[at]]] += n[rows].sum()
            others = b[(~every & ~none)[at]]
            hit = u[rows] @ u[others].T >= cosine
            hit |= rows[:, None] == others  # a vector links with its own copies
            total[rows] += hit @ n[others]
            if not same:
                total[others] += hit.T @ n[rows]
        return total

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components of one part are counted; of others the balls of each part are given."""
        for x in grouped(batches, _KEYS):
            rep, key, n, many, out = x["rep"].to_numpy(), x["key"].to_numpy(), x["n"].to_numpy(), (x["parts"] > 1).to_numpy(), []
            units = _units(x)
            for rows, _ in _groups(x, _KEYS):
                u = units(rows)
                if many[rows[0]]:
                    leader, radius = _balls(u, angle)
                    out.append((rep[rows], n[rows], rep[rows[leader]], key[rows], radius[leader]))
                elif len(rows) < 64:
                    hit = u @ u.T >= cosine
                    np.fill_diagonal(hit, True)  # a vector links with its own copies
                    out.append((rep[rows], hit @ n[rows], 0, 0, -1.0))
                else:
                    every, (leader, radius) = np.arange(len(rows)), _balls(u, angle)
                    out.append((rep[rows], tally(u, n[rows], leader, u, radius, every, every, True, True), 0, 0, -1.0))
            yield _frame(out, rep="i8", links="i8", lead="i8", key="i8", radius="f8")

    def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each ball links with wholly, and whether another ball is undecided."""
        for x in grouped(batches, _KEYS):
            rep, weight, radius, mine, out = x["rep"].to_numpy(), x["weight"].to_numpy(), x["radius"].to_numpy(), x["mine"].to_numpy(), []
            for rows, same in _groups(x, _KEYS):
                u, bi = _unit(_matrix(x["vec"].iloc[rows])), x["bi"].iloc[rows[0]]
                left, right = (np.arange(len(rows)),) * 2 if same else (np.flatnonzero(mine[rows] == bi), np.flatnonzero(mine[rows] != bi))
                total, open_ = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)
                for i in left.tolist():
                    between, reach = _between(u[right], u[i]), radius[rows[i]] + radius[rows[right]]
                    between[right == i] = 0.0
                    every, none = between + reach <= angle - _SLACK, between - reach > angle + _SLACK
                    total[i] += weight[rows[right[every]]].sum()
                    if not same:
                        total[right[every]] += weight[rows[i]]
                    unsure = ~every & ~none
                    open_[i] |= unsure.any()
                    open_[right[unsure]] = True
                out.append((rep[rows], total, open_))
            yield _frame(out, lead="i8", every="i8", open="?")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members of undecided balls, pair by pair where their balls are undecided."""
        for x in grouped(batches, _KEYS):
            rep, n, mine, reach, out = x["rep"].to_numpy(), x["n"].to_numpy(), x["mine"].to_numpy(), x["radius"].to_numpy(), []
            for rows, same in _groups(x, _KEYS):
                u, bi = _unit(_matrix(x["vec"].iloc[rows])), x["bi"].iloc[rows[0]]
                _, first, ball = np.unique(x["lead"].to_numpy()[rows], return_index=True, return_inverse=True)
                lead = _unit(_matrix(x["top"].iloc[rows[first]]))
                left, right = (np.arange(len(rows)),) * 2 if same else (np.flatnonzero(mine[rows] == bi), np.flatnonzero(mine[rows] != bi))
                out.append((rep[rows], tally(u, n[rows], ball, lead, reach[rows[first]], left, right, same, False)))
            yield _frame(out, rep="i8", links="i8")

    rows = found.select(F.col("component").alias("key"), F.col("node").alias("rep"))
    total = found.count()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("tl_n"))
    first = keep(_parts(rows, sizes, vectors, block, total).mapInPandas(whole, "rep long, links long, lead long, key long, radius double"), "counts")
    small = first.where("radius < 0").select("rep", "links")
    balls = first.where("radius >= 0").select("key", "rep", "lead", "radius", F.col("links").alias("weight"))
    if balls.isEmpty():
        return small
    tops = balls.groupBy("key", F.col("lead").alias("rep")).agg(F.max("radius").alias("radius"), F.sum("weight").alias("weight"))
    decided = _dealt(tops, vectors.select("rep", "vec"), block, total).mapInPandas(leaders, "lead long, every long, open boolean")
    decided = keep(decided.groupBy("lead").agg(F.sum("every").alias("every"), F.max("open").alias("open")), "decided")
    left = balls.join(decided.where("open"), "lead").select("key", "rep", "lead", "radius")
    left = blocked(left, ["key"], "lead", block, total).join(vectors, "rep").join(vectors.select(F.col("rep").alias("lead"), F.col("vec").alias("top")), "lead")
    hits = left.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInPandas(across, "rep long, links long")
    large = balls.join(decided, "lead").select("rep", F.col("every").alias("links")).unionByName(hits)
    return small.unionByName(large.groupBy("rep").agg(F.sum("links").alias("links")))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for x in b.column(4)], type=pa.binary())], ["h1", "h2", "rep", "n", "vec"])

    members, one = classes(vectors)
    one = keep(one.mapInArrow(flat, "h1 long, h2 long, rep long, n long, vec binary"), "vectors")
    found = keep(connected_components(links(one, cosine, block)), "components")
    number = counts(found, one.select("rep", "n", "vec"), cosine, block)
    known = one.select("h1", "h2", "rep", "n").join(number, "rep", "left").join(found, F.col("rep") == found["node"], "left")
    known = known.select("h1", "h2", F.col("n").alias("tl_n"), (F.coalesce("links", "n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = join_counted(members.where("h1 is not null"), known, ["h1", "h2"], one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    out = linked.unionByName(members.where("h1 is null").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id")))
    return out.select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
