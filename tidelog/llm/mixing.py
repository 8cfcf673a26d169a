"""Operator 6: mix sources to target weights by weighted fair queueing. DataFrame functions only.

Every source is a queue of its documents in a keyed shuffle order, replayed for up to `epochs` passes. The copy
of a document that ends at c words of its queue has the virtual finish time c / target of its source.
Served in that order, all sources stay in step with their targets; service stops at the total budget.

Distribution: running sums are never taken over a whole source or over all rows. Documents are put in bins of
their shuffle key, whose number follows the size of the source, bins are summed before any shuffle, and only the small
table of bins is scanned in order. The global order by finish time is cut the same way: sums by range of finish
time find the one range in which the budget ends, and only that range is sorted.

Defined results: null text has size 0; null source is a source of its own, the last; a document of size 0 is
never taken (taken 0, as every repetition of it has no words); repeated rows are documents of their own and may have different
counts; a row with a null doc_id takes part like any other, its place in the shuffle given by its text. Texts of any length are read whole; other
columns are not read (apply() hands them on). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_counted, keep, table

WEIGHTS = (1, 2, 3)
EPOCHS = 3
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a source in one bin of its shuffle order.
BIN_ROWS = 4096


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> with weight and target: shares of all words by weight, capped at epochs * source_size.

    The capped sources are those of the smallest cap / weight. With the sources in that order, the words for each unit of
    weight are (total - caps before) / weights from here on. That level rises as long as capping the source is right and
    falls afterwards, so its maximum is the level of the sources that are not capped. One row a source: windows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("final", F.max("level").over(whole))
    s = s.withColumn("target", F.least("cap", F.col("weight") * F.col("final")))
    return s.select("source", "source_size", "total", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, key: str = "mix", row: Column | None = None) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, and the expression `row` if given; one row a document."""
    d = keep(docs.select("doc_id", "source", words("text").alias("size"), F.md5(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col("text"), F.lit("")))))).alias("order"), (F.lit(None) if row is None else row).cast("string").alias("row")), "sizes")
    by_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    t = targets(by_source.select("source", "source_size"), weights, epochs).join(by_source.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    t = keep(t.withColumn("bins", F.ceil(F.col("n") / BIN_ROWS)), "targets")
    sources, rows = t.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = max(64, int((epochs * rows) ** 0.5))  # of finish time, for each pass: as many ranges as copies in one
    per_source = F.broadcast(t) if sources <= 10_000 else t  # else Spark chooses the join
    d = d.join(per_source.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    d = d.withColumn("bin", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("bins")).cast("long"))

    # The running sum in the shuffle order of a source: sum of the bins before, then within the bin.
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    bins = bins.withColumn("base", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")).select(F.col("source").alias("s2"), F.col("bin").alias("b2"), "base")
    within = Window.partitionBy("source", "bin").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    q = d.withColumn("here", F.sum("size").over(within)).join(bins, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bin") == F.col("b2"))).drop("s2", "b2")
    q = q.withColumn("end", F.col("base") + F.col("here")).select("doc_id", "source", "size", "source_size", "target", "total", "order", "end", "row")
    q = keep(q, "queues")

    # Copies that can be served: the finish time of the last that the budget reaches is 1 or little more.
    copies = q.where("size > 0").select("doc_id", "size", "target", "total", "order", "source", "end", "source_size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("pass"))
    copies = copies.withColumn("finish", F.try_divide(F.col("pass") * F.col("source_size") + F.col("end"), F.col("target")))
    copies = copies.withColumn("range", F.floor(F.col("finish") * ranges))
    sums = copies.groupBy("range").agg(F.sum("size").alias("range_size"), F.first("total").alias("total"))
    upto = F.sum("range_size").over(Window.orderBy("range"))
    sums = sums.withColumn("upto", upto)
    edge = sums.where(F.col("upto") > F.col("total")).agg(F.min("range").alias("edge"))
    base = sums.where(F.col("upto") <= F.col("total")).agg(F.coalesce(F.max("upto"), F.lit(0)).alias("served"))
    cut = keep(edge.crossJoin(base), "cut")  # one row
    last = copies.join(F.broadcast(cut), copies["range"] == cut["edge"])
    served = F.col("served") + F.sum("size").over(Window.orderBy("finish", "source", "order", "doc_id", "size", "pass"))
    limit = last.withColumn("now", served).where(F.col("now") > F.col("total")).agg(F.min("finish").alias("stop")).crossJoin(cut)
    limit = keep(limit, "limit")  # one row: copies finishing before `stop` are taken, or all if the budget takes all
    taken = q.crossJoin(F.broadcast(limit))
    finish = [F.try_divide(F.lit(p) * F.col("source_size") + F.col("end"), F.col("target")) for p in range(epochs)]
    count = sum((F.when(F.col("stop").isNull() | (f < F.col("stop")), 1).otherwise(0) for f in finish), F.lit(0))
    return taken.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * count).otherwise(0).cast("long").alias("taken"), *([] if row is None else ["row"]))


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, key: str = "mix") -> DataFrame:
    """The mix itself: docs with the columns it came with, each row as often as the mix takes it.

    Rows are found again by a hash of doc_id, source and text. Rows alike in all three are one row in the result, as often as
    the mix takes them together.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.sha2(F.to_json(F.struct("doc_id", "source", "text")), 256)
    copies = mix(docs, weights, epochs, key, row=row).groupBy("row").agg(F.coalesce(F.try_divide(F.sum("taken"), F.max("size")), F.lit(0)).cast("int").alias("tl_copies"), F.count(F.lit(1)).alias("tl_rows"))
    copies = keep(copies.where("tl_copies > 0"), "copies")
    d = docs.withColumn("tl_row", row)
    out = d.join(copies.where("tl_rows = 1"), d["tl_row"] == copies["row"])
    if not (alike := copies.where("tl_rows > 1")).isEmpty():
        alike = alike.select(F.col("row").alias("tl_row"), "row", "tl_copies", "tl_rows", F.col("tl_rows").alias("tl_n"))
        out = out.unionByName(join_counted(d, alike, ["tl_row"], d.count()).dropDuplicates(["tl_row"]).select(*out.columns))
    return out.withColumn("tl_copy", F.explode(F.sequence(F.lit(1), F.col("tl_copies")))).select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, max(level) OVER () AS final FROM l),
t AS (SELECT source, source_size, total, least(cap, weight * final) AS target FROM f),
q AS (SELECT d.*, source_size, total, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, p, CAST(p * source_size + e AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1), (2)) v(p) WHERE size > 0),
g AS (SELECT finish, total, sum(size) OVER (ORDER BY finish, source NULLS FIRST, o, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS served FROM c),
z AS (SELECT min(finish) AS stop FROM g WHERE served > total)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * ((CASE WHEN stop IS NULL OR CAST(e AS DOUBLE) / target < stop THEN 1 ELSE 0 END)
    + (CASE WHEN stop IS NULL OR CAST(source_size + e AS DOUBLE) / target < stop THEN 1 ELSE 0 END)
    + (CASE WHEN stop IS NULL OR CAST(2 * source_size + e AS DOUBLE) / target < stop THEN 1 ELSE 0 END)) END AS BIGINT) AS taken
FROM q, z
"""
