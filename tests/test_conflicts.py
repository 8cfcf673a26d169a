"""Conflict queries against brute force over whole tables."""

import random

from pyspark.sql import functions as F

from tidelog.operators import txn
from tidelog.plans import queries


def _txns(spark, sf):
    return [(t.tx_id, t.snapshot_seq, t.commit_seq, set(t.reads), set(t.writes)) for t in queries.txns(spark, sf).collect()]


def _edges(spark, sf):
    x = _txns(spark, sf)
    return {(r[0], w[0]) for r in x for w in x if r[0] != w[0] and w[2] > r[1] and r[3] & w[4]}


def test_every_conflict(spark, sf):
    """Writers that commit long after the snapshot too."""
    want = _edges(spark, sf)
    got = [tuple(r) for r in queries.QUERIES["conflict_edges_all"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    snapshot, commit = ({t[0]: t[i] for t in _txns(spark, sf)} for i in (1, 2))
    assert any(commit[w] > snapshot[r] + 120 for r, w in got)


def _cyclic(edges):
    """Ids that reach themselves, by search from each."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(out.get(x, ()))
        found |= {a} & seen
    return found


def test_transactions_on_cycles(spark, sf):
    """Whole ids and not their remainders, of which all are on a cycle where no transaction is."""
    got = [r[0] for r in queries.QUERIES["transaction_cycles"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == _cyclic(_edges(spark, sf))


def test_cycles_of_overlapping_transactions(spark, sf):
    x = _txns(spark, sf)
    edges = {(r[0], w[0]) for r in x for w in x if r[0] != w[0] and w[2] > r[1] and w[1] < r[2] and r[3] & w[4]}
    got = [r[0] for r in queries.QUERIES["serialization_cycles"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == _cyclic(edges)


def test_buckets_lose_nothing(spark):
    """Short and very long lifetimes, in buckets of other widths, against all pairs."""
    rng = random.Random(8)
    t = [(i, c - rng.choice([1, 5, 300]), c, rng.sample("abcdef", 2), rng.sample("abcdef", 1)) for i, c in enumerate(rng.sample(range(400, 900), 60))]
    d = spark.createDataFrame(t, "tx_id long, snapshot_seq long, commit_seq long, reads array<string>, writes array<string>")
    want = {(r[0], w[0]) for r in t for w in t if r[0] != w[0] and w[2] > r[1] and w[1] < r[2] and set(r[3]) & set(w[4])}
    fates = {}
    for p in t:
        active = [q for q in t if q[0] != p[0] and q[1] < p[2] < q[2]]
        i, o = ({q[0] for q in active if set(q[a]) & set(p[b])} for a, b in ((3, 4), (4, 3)))
        if i | o:
            fates[p[0]] = (len(i), len(o), "cycle" if i & o else "structure" if i and o else "safe")
    for width in (7, 100, 5000):
        assert {tuple(r) for r in txn.concurrent_edges(d, width).collect()} == want
        assert {r.tx_id: (r.n_in, r.n_out, r.fate) for r in txn.commit_dangers(d, width).collect()} == fates


def test_cycles_of_small_graphs(spark):
    """1 and 61, 2 and 62 have equal remainders; only 5, 6 and 7 are a cycle."""
    t = [(1, 0, 1, ["a"], ["x"]), (62, 5, 6, ["x"], ["a"]), (61, 9, 10, ["b"], ["c"]), (2, 9, 10, ["d"], ["b"]), (5, 20, 25, ["p"], ["r"]), (6, 20, 26, ["q", "q"], ["p"]), (7, 20, 27, ["r"], ["q"]), (8, 20, 28, ["s"], ["s"])]
    d = spark.createDataFrame(t, "tx_id long, snapshot_seq long, commit_seq long, reads array<string>, writes array<string>")
    assert sorted(r[0] for r in txn.on_conflict_cycle(d).collect()) == [5, 6, 7]
    assert txn.on_conflict_cycle(d.limit(0)).count() == 0
    rng = random.Random(3)
    many = [(i, (c := rng.randrange(40)) - rng.randrange(1, 9), c, [rng.choice("abcdefgh")], [rng.choice("abcdefgh")]) for i in range(30)]
    d = spark.createDataFrame(many, d.schema)
    want = _cyclic({(r[0], w[0]) for r in many for w in many if r[0] != w[0] and w[2] > r[1] and set(r[3]) & set(w[4])})
    assert {r[0] for r in txn.on_conflict_cycle(d).collect()} == want
    e = [(rng.randrange(30), rng.randrange(30)) for _ in range(35)]
    g = spark.createDataFrame(e, "a long, b long")
    assert {r[0] for r in txn.on_cycle(g).select(F.col("id")).collect()} == _cyclic(e)


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(6)
    for n, m in ((12, 18), (30, 45), (8, 30)):
        e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        g = spark.createDataFrame(e, "a long, b long")
        reach = {x: {x} for x in range(n)}
        for _ in range(n):
            for a, b in e:
                reach[a] |= reach[b]
        want = {x: min(y for y in reach[x] if x in reach[y]) for x in range(n)}
        large = {x: c for x, c in want.items() if list(want.values()).count(c) > 1}
        for small in (1000, 0):
            got = {r.id: r.component for r in txn.strong_components(g, small).collect()}
            assert {x: c for x, c in got.items() if list(got.values()).count(c) > 1} == large
