"""Traversals against brute force over whole tables."""

from tidelog.plans import queries


def test_parts_reached_over_shared_suppliers(spark, sf):
    e = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    of = {}
    for p, s in e:
        of.setdefault(s, set()).add(p)
    want = {}
    for p, s in e:
        want.setdefault(p, set()).update(of[s])
    got = queries.QUERIES["two_hops"](spark, sf).collect()
    assert len(got) == len(want) and {r.src: r.reached for r in got} == {p: len(x) for p, x in want.items()}
    assert max(r.reached for r in got) > 25
