"""Operator 3: SimHash near-dedup with bit-sliced comparison.

Fingerprints: words are runs of bytes other than ASCII white space, A-Z in lower case; each run of four words,
repeats included, is hashed by XXH64 (seed 42), and a bit is set if it is set in over half of the hashes.

Pairs within `radius` bits: documents of equal fingerprints are one row first, so copies cost nothing more. The 64 bits are cut
in `radius + 2` parts; two fingerprints within the radius agree in at least two of them, so they meet in one of
the tables of part pairs (15 of about 21 bits for radius 4). Within a key of such a table, fingerprints are stored as 64 bit planes
of 64 lanes a word. A fingerprint is compared with 64 others at once: plane by plane, XOR with its bit, added into bitwise
counters with carry-save; words are abandoned as soon as all lanes exceed the radius. This is exact: no link is lost.

Fingerprints go to their classes by a join that broadcasts the few classes with a large share of all documents (common.join_counted).
Oversized keys are dealt to several tasks in pairs of parts (common.blocked), and each group hands on a
spanning forest of its links and not its pairs. Components come from common.connected_components.

Defined results: null or word-less text has fingerprint zero and links like any other; fewer than four words are one
shingle; a null doc_id gets its fingerprint and the component of its class; repeated rows return repeated rows; component_id is the smallest
non-null doc_id of the component, null if there is none. Texts of any length are read whole. Other columns are not read. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import blocked, connected_components, grouped, hook, join_counted, keep, starts, table

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of a key in one part, and (fingerprint, word of 64) comparisons held at once.
BLOCK = 4096
CHUNK = 1 << 15

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, ...) -> fp (the 64 bits as a signed long) and the other columns but text."""
    others = [c for c in docs.columns if c != "text"]
    x = docs.select(F.col("text").cast("string"), *others)
    schema = StructType([StructField("fp", LongType()), *x.drop("text").schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), *b.columns[1:]], ["fp", *others])

    return x.mapInArrow(run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """n fingerprints -> (64, ceil(n / 64)) words: bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    n = -(-len(fps) // 64) * 64
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((n, 64), dtype=np.uint8)
    padded[: len(fps)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


def within(store: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare query[k] with the 64 lanes of word[k] of the planes: (k, lanes as a bit mask) of those within the radius.

    Counters are bit-sliced: count[i] holds bit i of the distance of each lane. A lane that leaves the range of the counters stays
    in `over`. Every eight planes, the words all of whose lanes are over the radius are dropped.
    """
    width = radius.bit_length()
    one, alive = np.uint64(1), np.arange(len(query))
    count = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
    over = np.zeros(len(query), dtype=np.uint64)
    for p in range(64):
        carry = store[p, word] ^ (np.uint64(0) - ((query >> np.uint64(p)) & one))
        for i in range(width):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if p % 8 == 7:
            # lanes with a count over the radius, from the highest bit down
            more, same = np.zeros_like(over), ~np.zeros_like(over)
            for i in reversed(range(width)):
                if radius >> i & 1:
                    same = same & count[i]
                else:
                    more, same = more | (same & count[i]), same & ~count[i]
            dead = over | more
            if p == 63:
                hit = dead != ~np.uint64(0)
                return alive[hit], ~dead[hit]
            live = dead != ~np.uint64(0)
            if live.sum() < 0.7 * len(live):
                alive, query, word, over = alive[live], query[live], word[live], over[live]
                count = [c[live] for c in count]
    raise AssertionError


def _pairs(x: pd.DataFrame, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of each group of a sorted frame whose fingerprints are within the radius, in chunks."""
    fps = x["fp"].to_numpy().view(np.uint64)
    size = np.diff(bounds)
    first, size = bounds[:-1][size > 1], size[size > 1]
    if not len(first):
        return
    words = -(-size // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    lanes = np.zeros(base[-1] * 64, dtype=np.uint64)  # groups begin at whole words
    row = np.full(base[-1] * 64, -1, dtype=np.int64)
    spot = np.repeat(base[:-1] * 64 - first, size) + (src := np.concatenate([np.arange(f, f + n) for f, n in zip(first, size, strict=True)]))
    lanes[spot], row[spot] = fps[src], src
    store = planes(lanes)
    # Each member meets the words of its group from its own on: the pairs behind it come from the other member.
    own = spot // 64
    todo = np.repeat(base[1:], size) - own
    ends = np.cumsum(todo)
    for lo in range(0, int(ends[-1]), CHUNK):
        k = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
        m = np.searchsorted(ends, k, side="right")
        w = own[m] + k - (ends[m] - todo[m])
        at, mask = within(store, fps[src[m]], w, radius)
        bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, lane = np.nonzero(bits)
        i, j = src[m[at[a]]], row[w[at[a]] * 64 + lane]
        ok = (j >= 0) & (i < j)
        yield i[ok], j[ok]


def links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """classes(fp, rep): distinct fingerprints -> (a, b) of reps: a forest that connects all within the radius."""
    parts = radius + 2
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    field = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    tables = [F.struct(F.lit(t).alias("t"), F.shiftleft(field[i], cuts[j + 1] - cuts[j]).bitwiseOR(field[j]).alias("v")) for t, (i, j) in enumerate(combinations(range(parts), 2))]
    rows = classes.select("fp", "rep", F.explode(F.array(*tables)).alias("k")).select(F.concat_ws(":", "k.t", "k.v").alias("k"), "fp", "rep")
    rows = rows.select(F.xxhash64("k").alias("key"), "fp", "rep")  # keys that collide are compared in vain, no more
    keys = ["key", "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in grouped(batches, keys):
            label = np.arange(len(x))
            for i, j in _pairs(x, starts(x, keys), radius):
                hook(label, i, j)
            rep, up = x["rep"].to_numpy(), label != np.arange(len(x))
            yield pd.DataFrame({"a": rep[up], "b": rep[label[up]]})

    dealt = blocked(rows, ["key"], "fp", block, len(tables) * classes.count()).drop("mine").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a long, b long")


def simhash(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id."""
    fps = keep(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, seed), "fingerprints")
    classes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("tl_n")), "classes")
    found = connected_components(links(classes.where("rep is not null"), radius))
    classes = classes.join(found, classes["rep"] == found["node"], "left").select("fp", "tl_n", F.coalesce("component", "rep").alias("component_id"))
    out = join_counted(fps, classes, ["fp"], fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with the columns it came with, and of each component of fingerprints one row: that of the smallest doc_id, null last.

    Rows are told apart by a hash of all columns, the least of which decides among rows of one doc_id: so rows of one doc_id but different texts
    are documents of their own, rows without a doc_id are compared like any other, and of rows alike in all columns one stays.
    """
    columns, row, best = docs.columns, F.sha2(F.to_json(F.struct("*")), 256), F.struct(F.col("tl_id").isNull(), "tl_id", "tl_row")
    fps = keep(fingerprints(docs.select(F.col("doc_id").cast("long").alias("tl_id"), row.alias("tl_row"), "text"), shingle, seed), "fingerprints")
    classes = keep(fps.groupBy("fp").agg(F.min(best).alias("best")), "classes")
    found = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), radius))
    kept = classes.join(found, classes["fp"] == found["node"], "left").groupBy(F.coalesce("component", "fp")).agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.tl_row").alias("tl_row"))
    return docs.withColumn("tl_row", row).join(kept, "tl_row", "left_semi").dropDuplicates(["tl_row"]).select(*[f"`{c}`" for c in columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))
