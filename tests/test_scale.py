"""Queries whose plans must hold at many times the size: results against brute force, and what their plans may hold."""

import random

from tidelog.operators import compact, hops, txn
from tidelog.operators.visible import visible

TXNS = "tx_id long, snapshot_seq long, commit_seq long, reads array<string>, writes array<string>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conflicts_unfold_where_they_end(spark):
    """Pairs that share several keys come once, and neither a distinct nor a shuffle follows the pairs; packs of any size lose none; repeated ids are still made distinct."""
    rng = random.Random(5)
    t = [(i, c - rng.randrange(1, 60), c, rng.choices("abcd", k=3), rng.choices("abcd", k=2)) for i, c in enumerate(rng.sample(range(100, 300), 80))]
    for rows in (t, t + [(0, 1, 400, ["a"], ["b"])]):
        d = spark.createDataFrame(rows, TXNS)
        for literal in (False, True):
            want = {(r[0], w[0]) for r in rows for w in rows if r[0] != w[0] and (literal or w[2] > r[1]) and set(r[3]) & set(w[4])}
            for pack in (3, 512):
                e = txn.conflict_edges(d, literal, pack)
                got = [tuple(x) for x in e.collect()]
                assert len(got) == len(want) and set(got) == want
        assert ("Aggregate" in _plan(e)) == (len(rows) > len(t))


def _cyclic(rows):
    to = {r[0]: {w[0] for w in rows if r[0] != w[0] and w[2] > r[1] and set(r[3]) & set(w[4])} for r in rows}
    found = set()
    for a in to:
        seen, todo = set(), list(to[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(to[x])
        found |= {a} & seen
    return found


def test_cycles_over_blocks(spark):
    """Cycles inside blocks, over several of them and over three levels, and what is left searched in rounds: the same ids."""
    rng = random.Random(9)
    for keys, lives in (("abcdefghijklmnopqrstuvwxyz", (1, 30)), ("abcd", (1, 4)), ("abcdefghijklmnopqrstuvwxyz", (200, 900))):
        t = [(i, c - rng.randrange(*lives), c, rng.choices(keys, k=2), rng.choices(keys, k=1)) for i, c in enumerate(rng.sample(range(600), 120))]
        want, d = _cyclic(t), spark.createDataFrame(t, TXNS)
        assert 0 < len(want)
        for width, small in ((8, 2_000_000), (4096, 2_000_000), (8, 1)):
            got = [r[0] for r in txn.on_conflict_cycle(d, width, small).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_two_hops_without_pairs(spark):
    """Sparse and dense links, a hub, equal sets and nulls, in blocks of any size; no row a pair of nodes is shuffled."""
    rng = random.Random(2)
    for n, m, k in ((200, 300, 2), (300, 12, 5), (130, 40, 1)):
        links = [(rng.randrange(n) * 7, rng.randrange(m)) for _ in range(n * k)] + [(p * 7, 999) for p in range(n // 3)] + [(None, 1), (3, None)]
        want = {}
        for p, _ in links:
            if p is not None:
                mine = {v for q, v in links if q == p and v is not None}
                if mine:
                    want[p] = len({q for q, v in links if v in mine and q is not None})
        d = spark.createDataFrame(links, "src long, via long")
        for sources, ends in ((1 << 18, 1 << 22), (40, 60)):
            got = hops.two_hops(d, sources, ends)
            assert {r.src: r.reached for r in got.collect()} == want
            assert "CoGroup" in _plan(got)


def test_safety_of_rewrites_in_one_pass(spark):
    """Pins of rewrites right and wrong, as read one by one, from one scan of the versions and without a broadcast of what grows with the keys."""
    rng = random.Random(4)
    v = spark.createDataFrame([(i, f"k{rng.randrange(30):02}", int(rng.random() < 0.8), f"v{rng.randrange(3)}" if rng.random() < 0.9 else None) for i in range(1, 400)], "seq long, key string, kind int, value string")
    t = spark.createDataFrame([(f"k{(a := rng.randrange(28)):02}", f"k{a + 2:02}", s) for s in (40, 90, 200, 310, 390)], "start string, end string, seq long")
    pins = [150, 250, 399]
    for flagged in (compact.fate(v, 150), v.withColumn("keep", v["seq"] % 7 != 0)):
        after = flagged.where("keep").drop("keep")
        live = lambda x: [{(p, r.key, r.value) for r in visible(x, t, p).collect()} for p in pins]
        b, a = live(v), live(after)
        changed = sum(len(x ^ y) for x, y in zip(b, a, strict=True))
        got = compact.safety(flagged, t, pins)
        assert [tuple(r) for r in got.orderBy("pin").collect()] == [(p, len(x), len(y), changed) for p, x, y in zip(pins, b, a, strict=True)]
    from tidelog.plans import queries

    assert _plan(queries.QUERIES["gc_safety"](spark, "/root/testdata/sf0.001")).count("events.parquet") == 0
