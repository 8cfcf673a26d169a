import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.common import connected_components


def components(values, ids, radius=4):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("block", [4096, 3])
def test_links_are_whole(spark, block):
    rng = np.random.default_rng(1)
    values = set()
    for _ in range(60):
        base = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(int(rng.integers(1, 8))):
            v = base
            for p in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                v ^= 1 << int(p)
            values.add(v)
    values = sorted(values)
    d = spark.createDataFrame(pd.DataFrame({"fp": np.array(values, dtype=np.uint64).view(np.int64), "rep": range(len(values))}))
    got = {r.node: r.component for r in connected_components(simhash.links(d, block=block)).collect()}
    assert [got.get(i, i) for i in range(len(values))] == components(values, list(range(len(values))))


def test_fingerprints_by_sparks_hash(spark, docs):
    """The same bits from Spark's XXH64 with seed 42."""
    w = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    grams = F.when(F.size("w") >= 4, F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))).otherwise(F.array(F.array_join("w", " ")))
    h = docs.select("doc_id", w.alias("w")).select("doc_id", F.explode(grams).alias("g")).select("doc_id", F.xxhash64("g").alias("h"))
    bits = h.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)])
    want = {r["doc_id"]: f"{sum(1 << i for i in range(64) if 2 * r[f'b{i}'] > r['n']):016x}" for r in bits.collect()}
    got = {r.doc_id: r.fingerprint for r in simhash.simhash(docs).collect()}
    assert {k: got[k] for k in want} == want


def test_query(spark, sf):
    got = simhash.op3_simhash(spark, sf).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == components([int(r.fingerprint, 16) for r in got], [r.doc_id for r in got])


def test_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash(odd).collect()))
    by = {i: (f, c) for i, f, c in got}
    assert len(got) == 9 and by[2] == by[3] == by[7] == ("0" * 16, 2)
    assert by[1] == by[4] and by[1][1] == 1
    assert simhash.simhash(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]


def test_counters():
    """Bit-sliced distances against counted bits, for radii of other widths."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    noise = np.array([sum(1 << int(p) for p in rng.choice(64, int(rng.integers(0, 10)), replace=False)) for _ in range(130)], dtype=np.uint64)
    fps = base ^ noise
    store = simhash.planes(np.append(fps, np.zeros(62, dtype=np.uint64)))
    for radius in (1, 3, 4, 6):
        q = np.repeat(fps[:5], 3)
        k, mask = simhash.within(store, q, np.tile(np.arange(3), 5), radius)
        got = {(int(i) // 3, int(i) % 3 * 64 + b) for i, m in zip(k, mask, strict=True) for b in range(64) if int(m) >> b & 1 and int(i) % 3 * 64 + b < 130}
        want = {(i, j) for i in range(5) for j in range(130) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert got == want


def test_rows_of_one_id(spark):
    """Texts that differ under one doc_id are documents of their own; rows without one are compared too; the choice is the same on any order."""
    a, b = "the cat sat on the mat and looked at the moon", "a wholly other text of ten or so words that differs"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (2, a, "y"), (None, b, "z"), (None, "nobody has this text but this one row here", "z"), (None, a, "w")]
    for order in (rows, rows[::-1]):
        got = simhash.deduplicate(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.text, r.source) for r in got) == sorted([(1, a, "x"), (1, b, "x"), (0, rows[5][1], "z")])
