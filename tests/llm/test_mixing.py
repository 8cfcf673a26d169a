import os
import re

import duckdb
import pandas as pd

from tidelog.llm import mixing


def same_as_sql(got, con):
    got, want = got.toPandas(), con.sql(mixing.SQL).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    same_as_sql(mixing.op6_mixing(spark, sf), con)


def test_odd_rows(spark, odd, none):
    con = duckdb.connect()
    con.register("documents", odd.toPandas().astype({"doc_id": "Int64"}))
    same_as_sql(mixing.mix(odd), con)
    assert mixing.mix(none).count() == 0


def test_sources_without_words(spark):
    schema = "doc_id long, source string, text string"
    d = spark.createDataFrame([(1, "a", "x y z"), (2, "b", None), (3, None, ""), (4, "a", " ")], schema)
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    same_as_sql(mixing.mix(d), con)
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], schema)).collect()] == [0, 0]
    assert mixing.apply(d).count() == 1


def targets(sizes, weights, epochs=3):
    """Shares by weight, caps, and the excess shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_counts(spark, docs):
    got = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes, (1, 2, 3))
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 * want[s] and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
    total = sum(sizes.values())
    assert total - max(r["size"] for r in got) <= sum(r["taken"] for r in got) <= total


def test_caps(spark):
    d = spark.createDataFrame([(1, "a", "w " * 1000), (2, "b", "w " * 10), (3, "c", "w w")], "doc_id long, source string, text string")
    got = {r["source_size"]: r["target"] for r in mixing.mix(d).collect()}
    assert got == {1000: 976.0, 10: 30.0, 2: 6.0}


def test_apply(spark, docs, odd, none):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    got = {}
    for r in mixing.apply(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in taken.items() if n}
    out = mixing.apply(odd)
    assert out.columns == odd.columns and out.count() == sum(r["taken"] // r["size"] for r in mixing.mix(odd).collect() if r["size"])
    assert mixing.apply(none).count() == 0
