import random

import numpy as np
import pandas as pd
import pytest

from tidelog.llm import common


def test_components_of_paths_hubs_and_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001 + i) for i in range(80)] + [(2000 + rnd.randrange(150), 2000 + rnd.randrange(150)) for _ in range(120)] + [(5, 5), (3, 4)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    rnd.shuffle(edges)
    for least in (256, 4):  # 4: every node of more links is a hub
        got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), least=least).collect()}
        assert got == {x: find(x) for x in up if any(find(x) == find(y) and x != y for y in up)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_broadcast(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 7, k) for k in range(300)] + [(None, 1), (99, 1)], "k long, v long")
    keys = rows.where("k < 99").groupBy("k").agg(common.F.count("*").alias("tl_n"), common.F.max("v").alias("m"))
    want = sorted(map(tuple, rows.join(keys.drop("tl_n"), "k").collect()))
    for least in (1, 50, 1000):
        assert sorted(map(tuple, common.join_counted(rows, keys, ["k"], 300, hubs=2, least=least).collect())) == want


def test_hook():
    rng, label = np.random.default_rng(1), np.arange(200)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    common.hook(label, a, b)
    assert (label[a] == label[b]).all() and (label <= np.arange(200)).all() and (label[label] == label).all()


def test_groups_are_never_split():
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": np.sort(rng.integers(0, 12, 300)), "j": 0, "v": range(300)})
    for step in (1, 7, 300):
        out = list(common.grouped((x.iloc[i : i + step] for i in range(0, 300, step)), ["k", "j"]))
        assert pd.concat(out, ignore_index=True).equals(x)
        assert sum(o["k"].nunique() for o in out) == x["k"].nunique()


@pytest.mark.parametrize("total", [53, 10**6])  # the large key by a broadcast, or not
def test_blocked_pairs_meet_once(spark, total):
    d = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3)) for i in range(n)], "key long, id long")
    met = {}
    for (k, i, j), g in common.blocked(d, ["key"], "id", 8, total).toPandas().groupby(["key", "bi", "bj"]):
        ids, mine = g["id"].tolist(), dict(zip(g["id"], g["mine"], strict=True))
        for a in ids:
            for b in ids:
                if a < b and (i == j or mine[a] != mine[b]):
                    met[k, a, b] = met.get((k, a, b), 0) + 1
    assert met == {(k, a, b): 1 for k, n in ((1, 50), (2, 3)) for b in range(n) for a in range(b)}


def test_clear(spark, tmp_path):
    kept = common.keep(spark.range(3), "x")
    path = common._written[-1]
    assert kept.count() == 3
    common.clear(spark)
    assert not spark._jvm.java.io.File(path.removeprefix("file:")).exists() and not common._written
