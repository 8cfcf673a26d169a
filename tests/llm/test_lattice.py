import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import lattice


def brute(ids, vectors, cosine=0.95):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and ids[i] is not None]
    unit = {i: np.array(vectors[i], dtype=float) / np.linalg.norm(np.array(vectors[i], dtype=float)) for i in ok}
    links, up = {i: 0 for i in range(len(ids))}, {i: i for i in range(len(ids))}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                up[find(a)] = find(b)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [(ids[i], links[i], low[find(i)] if i in unit else ids[i]) for i in range(len(ids))]


def groups(seed, dim=16, n=25):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [np.float32(c + rng.normal(size=dim) * rng.choice([0, 0.01, 0.05, 0.08])).tolist() for _ in range(int(rng.integers(1, 25)))]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("block", [2048, 6])
def test_against_brute_force(spark, block):
    vectors = groups(1) + [[0.0] * 16, None, [], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [2.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [None] * 16]
    vectors += [vectors[0]] * 20 + [[3 * x for x in vectors[0]]]
    ids = [*range(len(vectors) - 1), None]
    d = spark.createDataFrame([(i, v, 1, 9) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, n int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(d, block=block).collect()]
    assert sorted(got, key=key) == sorted(brute(ids, vectors), key=key)


@pytest.mark.parametrize("dim", [4, 16, 768])
def test_dimensions(spark, dim):
    """Planted neighbours at angles around the threshold, in other dimensions, through the whole query."""
    rng, rows = np.random.default_rng(dim), []
    for c in rng.normal(size=(60, dim)):
        c /= np.linalg.norm(c)
        n = rng.normal(size=dim)
        n -= n @ c * c
        n /= np.linalg.norm(n)
        rows += [c.tolist()] + [(cos * c + np.sqrt(1 - cos * cos) * n).tolist() for cos in (0.99, 0.96, 0.951, 0.94)]
    ids = list(range(len(rows)))
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>")).collect()}
    want = {i: n for i, n, _ in brute(ids, rows)}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())


def test_large_group_is_sent_once(spark):
    """Many near copies: a few balls a part settle the counts, and no member is sent to another part."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=16)
    d = spark.createDataFrame([(i, (c + 0.01 * rng.normal(size=16)).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    sent, dealt = [], lattice.blocked

    def counted(rows, *args, **kw):
        sent.append(rows.count())
        return dealt(rows, *args, **kw)

    lattice.blocked = counted
    try:
        got = lattice.near_duplicates(d, block=100)
        assert got.where("n_links = 2999 and component_id = 0").count() == 3000
    finally:
        lattice.blocked = dealt
    members = [n for n in sent if n > 1500]
    assert not members, sent


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = rng.normal(size=u.shape)
    n -= (n * u).sum(axis=1, keepdims=True) * u
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    a, b = lattice.cells(u), lattice.cells(0.95 * u + np.sqrt(1 - 0.95**2) * n)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b, strict=True)]) > 0.98
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, np.roll(b, 1, axis=0), strict=True)]) < 0.05


def test_nearest_point_of_e8():
    x = np.random.default_rng(0).normal(0, 1, (1000, 8))
    c = lattice.nearest_e8(x)
    best = ((x - c) ** 2).sum(axis=1)
    assert all((best <= ((x - c - r) ** 2).sum(axis=1) + 1e-9).all() for r in lattice.minimal_vectors())
    assert len(lattice.minimal_vectors()) == 240


def test_empty(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.near_duplicates(d).count() == 0


def test_query(spark, sf):
    got = lattice.op1_lattice(spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted(want)
    assert got.where(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0
