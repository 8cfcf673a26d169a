"""A history tier: superseded versions under a second root, in segments named by their content."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, release
from .store import VERSION, Store, _names

_COLUMNS = _names(VERSION)


class HistoryTier:
    """Segments are never changed: the same rows have the same name, so that putting them again after a lost commit adds nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._files = spark, root.rstrip("/"), Store(spark, root)

    def _digest(self, rows: DataFrame) -> dict:
        """Two sums over hashes of the rows, whatever their order; equal rows don't cancel out."""
        half = lambda *seed: F.sum(F.xxhash64(*_COLUMNS, *seed).cast("decimal(38,0)"))
        one = rows.agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"), half().alias("a"), half(F.lit(1)).alias("b")).first()
        return {"rows": one["rows"], "low": one["low"], "high": one["high"], "name": f"{one['rows']:x}-{int(one['a'] or 0) % (1 << 64):016x}{int(one['b'] or 0) % (1 << 64):016x}"}

    def _manifests(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self._files._list("manifest"))

    def segments(self) -> list[dict]:
        """Those of the newest manifest, in the order they were put."""
        numbers = self._manifests()
        return json.loads(self._files._read(f"manifest/{numbers[-1]}.json"))["segments"] if numbers else []

    def put(self, versions: DataFrame) -> str:
        """Write rows as a segment and list it. Written aside, checked, then renamed; a name that is taken holds the same rows. No rows, no segment: ''."""
        rows = keep(versions.select(*_COLUMNS), "tier")  # computed once: the sort takes a sample first
        aside = f"aside/{uuid.uuid4().hex}"
        rows.repartitionByRange("cf", "key").sortWithinPartitions("cf", "key", "seq").write.parquet(f"{self.root}/{aside}")
        release(rows)
        entry = self._digest(self._read(aside))
        fs, name = self._files._fs, entry["name"]
        if not entry["rows"]:
            fs.delete(self._files._path(aside), True)
            return ""
        fs.mkdirs(self._files._path("segments"))
        if fs.exists(self._files._path("segments", name)) or not fs.rename(self._files._path(aside), self._files._path("segments", name)):
            fs.delete(self._files._path(aside), True)
        listed = self.segments()
        if name not in {s["name"] for s in listed}:
            self._files._create(f"manifest/{(self._manifests() or [0])[-1] + 1}.json", json.dumps({"segments": [*listed, entry]}))
        return name

    def _read(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], VERSION)

    def read(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Versions with low <= seq <= high; segments outside are not opened. A version that two segments hold is given once."""
        wanted = [s for s in self.segments() if (low is None or s["high"] >= low) and (high is None or s["low"] <= high)]
        rows = self._read(*[f"segments/{s['name']}" for s in wanted]).dropDuplicates(["cf", "key", "seq"])
        return rows.where((F.lit(True) if low is None else F.col("seq") >= low) & (F.lit(True) if high is None else F.col("seq") <= high))

    def verify(self) -> list[str]:
        """Names of segments that are missing or whose rows no longer give their name."""
        there = set(self._files._list("segments"))
        return [s["name"] for s in self.segments() if s["name"] not in there or self._digest(self._read(f"segments/{s['name']}"))["name"] != s["name"]]

    def restore(self, versions: DataFrame, seq: int) -> DataFrame:
        """What a store still holds and what the tier has, up to a sequence: versions for reads below the store's watermark."""
        both = versions.select(*_COLUMNS).unionByName(self.read(high=seq)).where(F.col("seq") <= seq)
        return both.dropDuplicates(["cf", "key", "seq"])
