"""A store of a versioned log in Parquet: immutable commits, a JSON manifest, checkpoints, backups and point-in-time restore.

Layout below the root, all through Hadoop's file system API:

  data/commit=<c>/cf=<f>/   versions of one commit, or a compacted base, sorted by key within a family
  ranges/commit=<c>/        its range tombstones
  history/commit=<c>/       versions that GC removed
  manifest/<n>.json         version n of the store: the live commits, the last sequence, families, cursors

A commit writes its data and then installs the next manifest: the text is written aside and renamed to its number, which fails if the number is
taken. That is the durability point. A writer that loses the race reads the new manifest, validates again and retries; folders no manifest
names are leftovers of lost writers and are not read. A manifest that can't be read (a torn one of a file system without such a rename) is
skipped, and the next writer installs above it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compact as gc_rules
from ..operators import fold as folds
from ..operators.txn import SnapshotTooOld, Transaction, backoff, validate
from ..operators.visible import ordered, uncovered, visible
from .shared import keep, release

FORMAT = 2
VERSION = "cf string, key string, seq long, kind int, value string, commit_id long"
RANGE = "cf string, start string, end string, seq long, commit_id long"
PUT, DELETE, MERGE = 1, 0, 3
#: Options that other engines' users set: accepted by open(), with what they do here. Any other name is refused.
KNOBS = {"compression": "codec of the Parquet files", "separator": "between merge operands", "sync": "no effect: a commit is durable", "disable_wal": "no effect: there is no log apart", "block_cache": "no effect: Spark's memory", "prefix_length": "no effect: prefixes are expressions"}
_NEW = {"last": 0, "oldest": 0, "floor": 0, "families": ["default"], "dropped": {}, "data": [], "ranges": [], "history": [], "old_ranges": [], "masks": [], "commits": 0, "cursors": {}, "merge": False, "seal": None, "options": {}}


class Conflict(RuntimeError):
    pass


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    # files and manifests
    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _list(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []

    def _read(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def _create(self, name: str, text: str) -> None:
        """Whole or not at all: written aside and renamed; fails if the name is taken."""
        aside = f"aside/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        to = self._path(name)
        self._fs.mkdirs(to.getParent())
        rename = getattr(self._hadoop, "Options$Rename")
        context = self._hadoop.FileContext.getFileContext(self._path().toUri() if not self.root.startswith("/") else self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._path(aside)), self._fs.makeQualified(to), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            self._fs.delete(self._path(aside), False)
            if "exist" in str(e).lower():
                raise Conflict(f"{name} was created by another writer") from e
            raise

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options: str) -> Store:
        if unknown := sorted(set(options) - set(KNOBS)):
            raise KeyError(f"no option {unknown[0]}")
        s = cls(spark, root)
        if not s._list("manifest"):
            s._create("manifest/0.json", json.dumps({"format_version": FORMAT, "n": 0, **_NEW, "options": options}))
        return s

    @staticmethod
    def destroy(spark: SparkSession, root: str) -> None:
        s = Store(spark, root)
        s._fs.delete(s._path(), True)

    def _numbers(self) -> list[int]:
        return sorted((int(x[:-5]) for x in self._list("manifest") if x.endswith(".json") and x[:-5].isdigit()), reverse=True)

    def _parsed(self, n: int) -> dict | None:
        try:
            return json.loads(self._read(f"manifest/{n}.json"))
        except (ValueError, TypeError):
            return None

    def manifest(self, n: int | None = None) -> dict:
        """The newest that can be read, or number n. `top` is the highest number taken."""
        numbers = self._numbers()
        for k in numbers if n is None else [n]:
            m = self._parsed(k)
            if m is None:
                continue
            if m["format_version"] != FORMAT:
                raise ValueError(f"format {m['format_version']}: see inspect() and migrate()")
            return {**m, "top": numbers[0]}
        raise ValueError("no manifest that can be read")

    def _install(self, m: dict, **changes) -> dict:
        new = {**m, **changes, "n": m["top"] + 1}
        new.pop("top")
        self._create(f"manifest/{new['n']}.json", json.dumps(new))
        return new

    def _tag(self, m: dict) -> str:
        return f"{m['top'] + 1}-{uuid.uuid4().hex[:8]}"

    def _frame(self, kind: str, commits: list[str], schema: str) -> DataFrame:
        """All commits in one read, with the column `commit`."""
        schema += ", commit string"
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/commit={c}" for c in commits]).select(*_names(schema))

    def _put(self, df: DataFrame, kind: str, tag: str, schema: str, partitions: int | None = None) -> bool:
        """Write a commit's folder, sorted; whether it has rows."""
        path, options = f"{self.root}/{kind}/commit={tag}", {"compression": self.manifest()["options"].get("compression", "snappy")}
        if schema == RANGE:
            df.select(*_names(schema)).sortWithinPartitions("cf", "start").write.options(**options).parquet(path)
        else:
            x = df.select(*_names(schema))
            x = x.repartitionByRange(partitions, "cf", "key") if partitions else x.repartitionByRange("cf", "key")
            x.sortWithinPartitions("cf", "key", F.col("seq").desc()).write.options(**options).partitionBy("cf").parquet(path)
        return any(not f.startswith(("_", ".")) for f in self._list(f"{kind}/commit={tag}")) and not self._frame(kind, [tag], schema).isEmpty()

    # relations
    def _kept(self, df: DataFrame, m: dict) -> DataFrame:
        """Without rows of dropped families, and without rows that a compaction of a range has rewritten."""
        for f, seq in m["dropped"].items():
            df = df.where(~((F.col("cf") == f) & (F.col("seq") <= seq)))
        return df

    def versions(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        x = self._kept(self._frame("data", m["data"], VERSION), m)
        for mask in m["masks"]:
            x = x.where(~(F.col("commit").isin(mask["commits"]) & _scope(mask["family"], mask["start"], mask["end"])))
        return x.drop("commit")

    def tombstones(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        return self._kept(self._frame("ranges", m["ranges"], RANGE), m).drop("commit")

    def history(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        return self._kept(self._frame("history", m["history"], VERSION), m).drop("commit")

    def log(self, m: dict | None = None, archived: bool = False) -> tuple[DataFrame, DataFrame]:
        """Versions and tombstones; with those that GC removed if `archived`."""
        m = m or self.manifest()
        if not archived:
            return self.versions(m), self.tombstones(m)
        old = self._kept(self._frame("ranges", m["old_ranges"], RANGE), m).drop("commit")
        return self.versions(m).unionByName(self.history(m)), self.tombstones(m).unionByName(old).distinct()

    def as_of(self, seq: int | None = None, archived: bool = False) -> DataFrame:
        """(cf, key, seq, value) live at a snapshot, merge operands folded. Below the oldest readable sequence only with the history, and never below its floor."""
        m = self.manifest()
        seq = m["last"] if seq is None else seq
        if seq < m["oldest"] and (not archived or seq < m["floor"]):
            raise SnapshotTooOld(f"snapshot {seq}: {'the history' if archived else 'the log'} begins at {m['floor'] if archived else m['oldest']}")
        v, t = self.log(m, seq < m["oldest"])
        if not m["merge"]:
            return visible(v, t, seq, by=("cf", "key"))
        full = lambda c: F.concat("cf", F.lit("\0"), F.col(c))
        x = folds.fold_operands(v.withColumn("key", full("key")), t.select(full("start").alias("start"), full("end").alias("end"), "seq"), seq, m["options"].get("separator", ","))
        at = F.instr("key", "\0")
        return x.select(F.substring("key", F.lit(1), at - 1).alias("cf"), F.substring("key", at + 1, F.length("key")).alias("key"), "seq", "value")

    # writes
    def write(self, ops: DataFrame, base: dict | None = None, cursor: tuple[str, str, int] | None = None) -> int:
        """One atomic commit. ops: pos, cf, op (put / delete / merge / delete_range), key, value (the end of a range). Returns the last sequence.

        Each op gets its own sequence in order of pos, which must be distinct. An empty range in a batch is skipped. A null family is the
        default one. cursor: (source, family, sequence of the source) installed with the commit.
        """
        m = base or self.manifest()
        x = ops.withColumn("cf", F.coalesce("cf", F.lit("default"))).where("not (op = 'delete_range' and key >= value)")
        met = x.groupBy("cf", "op").agg(F.count(F.lit(1)).alias("n"))
        families = x.sparkSession.createDataFrame([(f,) for f in sorted(m["families"])], "cf string")
        bad = met.join(families, "cf", "left_anti").first()
        if bad:
            raise KeyError(f"no family {bad[0]}")
        kinds = {r["op"]: r["n"] for r in ops.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}  # four at most
        if unknown := sorted(set(kinds) - {"put", "delete", "merge", "delete_range"}, key=str):
            raise ValueError(f"no operation {unknown[0]}")
        number, tag = m["top"] + 1, self._tag(m)
        # positions to sequences by counts of position ranges, so that no task sorts the whole batch
        bins = x.withColumn("tl_bin", F.floor(F.col("pos") / 100_000))
        starts = bins.groupBy("tl_bin").agg(F.count(F.lit(1)).alias("n"))
        starts = starts.select("tl_bin", (F.sum("n").over(Window.orderBy("tl_bin")) - F.col("n")).alias("tl_base"))
        seq = F.lit(m["last"]) + F.col("tl_base") + F.row_number().over(Window.partitionBy("tl_bin").orderBy("pos"))
        # computed once: each folder takes a sample of its rows before it sorts them
        numbered = keep(bins.join(starts, "tl_bin").select("cf", "op", "key", "value", seq.cast("long").alias("seq"), F.lit(number).cast("long").alias("commit_id")), "write")
        x = numbered
        data = ranges = False
        if set(kinds) - {"delete_range"}:
            points = x.where("op <> 'delete_range'").withColumn("kind", F.when(F.col("op") == "put", PUT).when(F.col("op") == "merge", MERGE).otherwise(DELETE))
            data = self._put(points.withColumn("value", F.when(F.col("op") != "delete", F.col("value"))), "data", tag, VERSION)
        if "delete_range" in kinds:
            ranges = self._put(x.where("op = 'delete_range'").select("cf", F.col("key").alias("start"), F.col("value").alias("end"), "seq", "commit_id"), "ranges", tag, RANGE)
        release(numbered)
        tops = [m["last"]] + [self._frame(k, [tag], s).agg(F.max("seq")).first()[0] for k, s, some in (("data", VERSION, data), ("ranges", RANGE, ranges)) if some]
        cursors = m["cursors"]
        if cursor:
            cursors = {**cursors, cursor[1]: {**cursors.get(cursor[1], {}), cursor[0]: cursor[2]}}
        self._install(m, last=max(tops), data=m["data"] + [tag] * data, ranges=m["ranges"] + [tag] * ranges, commits=m["commits"] + 1, cursors=cursors, merge=m["merge"] or "merge" in kinds)
        return max(tops)

    def put_same(self, keys: DataFrame, value: str, family: str = "default") -> int:
        """One value under many keys (pos, key), as one commit."""
        return self.write(keys.select("pos", F.lit(family).alias("cf"), F.lit("put").alias("op"), "key", F.lit(value).alias("value")))

    def commit(self, tx: Transaction, attempts: int = 5) -> int:
        """Optimistic commit of a transaction: validated against everything above its snapshot; a lost race is tried again.

        Ranges come before writes: a staged write inside a range either followed it or became a delete when the range was staged.
        """
        rows = [(i, "default", "delete_range", a, b) for i, (a, b) in enumerate(tx.ranges)]
        rows += [(len(rows) + i, "default", "put" if kind else "delete", k, v) for i, (k, (kind, v)) in enumerate(tx.writes.items())]
        one = self.spark.createDataFrame([(1, tx.snapshot, sorted(tx.reads), sorted(tx.writes))], "tx_id long, snapshot_seq long, reads array<string>, writes array<string>")
        for attempt in range(attempts):
            m = self.manifest()
            default = F.col("cf") == "default"
            fate = validate(one, self.versions(m).where(default), self.tombstones(m).where(default), m["oldest"]).first()["fate"]
            if fate == "too_old":
                raise SnapshotTooOld(str(tx.snapshot))
            if fate == "conflict":
                raise Conflict("a key was written after the snapshot")
            if not rows:
                return m["last"]
            try:
                return self.write(self.spark.createDataFrame(rows, "pos long, cf string, op string, key string, value string"), base=m)
            except Conflict:
                if attempt == attempts - 1:
                    raise
                time.sleep(backoff(attempt) / 1000)
        raise AssertionError

    def fold(self, updates: DataFrame, family: str = "default", source: str = "default") -> int:
        """updates(seq, op, key, value) of a source into a family, with the source's sequence as cursor, in one commit.

        Each source has a cursor of its own in each family and hands on its rows in order: rows at or below the cursor were folded before and
        are skipped. purge is a delete.
        """
        m = self.manifest()
        fresh = updates.where(F.col("seq") > int(m["cursors"].get(family, {}).get(source, 0)))
        top = fresh.agg(F.max("seq")).first()[0]
        if top is None:
            return m["last"]
        best = fresh.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("u"))
        # the source's sequence may repeat among keys: positions are places in the order of both
        best = ordered(best.select("key", "u.seq", "u.op", "u.value"), ["seq", "key"])
        ops = best.select(F.col("n").alias("pos"), F.lit(family).alias("cf"), F.when(F.col("op") == "put", "put").otherwise("delete").alias("op"), "key", "value")
        return self.write(ops, base=m, cursor=(source, family, int(top)))

    def ingest(self, files: DataFrame, family: str = "default") -> int:
        """Rows (key, value) of external files as one commit with fresh sequences, in key order; of equal keys the greatest value is the newest."""
        rows = ordered(files.select("key", "value"), ["key", "value"])
        return self.write(rows.select(F.col("n").alias("pos"), F.lit(family).alias("cf"), F.lit("put").alias("op"), "key", "value"))

    # families
    def create_family(self, name: str) -> None:
        m = self.manifest()
        if name in m["families"]:
            raise ValueError(f"family {name} exists")
        self._install(m, families=[*m["families"], name])

    def drop_family(self, name: str) -> None:
        """The family's rows and tombstones so far are hidden by the manifest alone; the next compaction deletes them."""
        m = self.manifest()
        self._install(m, families=[f for f in m["families"] if f != name], dropped={**m["dropped"], name: m["last"]}, cursors={f: c for f, c in m["cursors"].items() if f != name})

    # rewrites
    def compact(self, oldest: int | None = None, bottom: bool = True, partitions: int | None = None, family: str | None = None, start: str | None = None, end: str | None = None) -> dict:
        """GC below the oldest pin: what goes is written to the history first, then the base is replaced.

        On a bottommost rewrite, versions at or below the pin under a tombstone at or below it go too, and so do those tombstones if the whole store
        is rewritten. With a family or bounds [start, end) only that range is rewritten, and a mask hides its rows in older commits.
        """
        m = self.manifest()
        oldest = m["last"] if oldest is None else oldest
        whole = family is None and start is None and end is None
        v, t = self.versions(m), self.tombstones(m)
        v = v if whole else v.where(_scope(family, start, end))
        # computed once: each folder takes a sample of its rows before it sorts them
        x = keep(gc_rules.fate(v, oldest, bottom, by=("cf", "key")), "compact")
        kept, gone, live = x.where("keep").drop("keep"), x.where("not keep").drop("keep"), None
        if bottom and m["ranges"]:
            low = kept.where(F.col("seq") <= oldest)
            live = keep(uncovered(low, t.where(F.col("seq") <= oldest), cf=True).select(*low.columns), "live")
            gone = gone.unionByName(low.join(live, ["cf", "key", "seq"], "left_anti"))
            kept = kept.where(F.col("seq") > oldest).unionByName(live)
        tag = self._tag(m)
        history = self._put(gone, "history", tag, VERSION)
        data = self._put(kept, "data", tag, VERSION, partitions)
        for done in (x, live):
            if done is not None:
                release(done)
        changes = {"history": m["history"] + [tag] * history, "data": [tag] * data, "masks": [], "oldest": max(m["oldest"], oldest)}
        if not whole:
            changes |= {"data": m["data"] + [tag] * data, "masks": m["masks"] + [{"commits": m["data"], "family": family, "start": start, "end": end}]}
        elif bottom and m["ranges"]:
            left = self._put(t.where(F.col("seq") > oldest), "ranges", tag, RANGE)
            changes |= {"ranges": [tag] * left, "old_ranges": m["old_ranges"] + m["ranges"]}
        return self._install(m, **changes)

    def prune_history(self, floor: int) -> dict:
        """Drop what only reads below `floor` need; the floor never falls."""
        m = self.manifest()
        floor = max(m["floor"], min(floor, m["oldest"]))
        both = self.versions(m).withColumn("old", F.lit(0)).unionByName(self.history(m).withColumn("old", F.lit(1)))
        left = keep(gc_rules.fate(both, floor, by=("cf", "key")).where("keep and old = 1"), "pruned")
        tag = self._tag(m)
        history = self._put(left, "history", tag, VERSION)
        release(left)
        return self._install(m, floor=floor, history=[tag] * history)

    def leftovers(self) -> list[str]:
        """Commit folders that no readable manifest names: of lost writers, or replaced."""
        m = self.manifest()
        live = {"data": m["data"], "ranges": m["ranges"] + m["old_ranges"], "history": m["history"]}
        return sorted(f"{kind}/{f}" for kind, names in live.items() for f in self._list(kind) if f.startswith("commit=") and f[7:] not in names)

    def vacuum(self) -> list[str]:
        """Delete leftovers and manifests other than the newest; no writer may be at work and no older version be read."""
        gone, m = self.leftovers(), self.manifest()
        for f in gone:
            self._fs.delete(self._path(f), True)
        for n in self._numbers():
            if n != m["n"] and n != m["top"]:
                self._fs.delete(self._path(f"manifest/{n}.json"), False)
        return gone

    def repair(self) -> list[int]:
        """Delete manifests that can't be read; their numbers."""
        bad = [n for n in self._numbers() if self._parsed(n) is None]
        for n in bad:
            self._fs.delete(self._path(f"manifest/{n}.json"), False)
        return bad

    # copies
    def checkpoint(self, dest: str) -> Store:
        """An openable copy at the present version, copied by the executors."""
        m = self.manifest()
        other = Store(self.spark, dest)
        for kind, commits, schema in (("data", m["data"], VERSION), ("ranges", m["ranges"] + m["old_ranges"], RANGE), ("history", m["history"], VERSION)):
            if commits:
                by = ["commit", "cf"] if schema == VERSION else ["commit"]
                self._frame(kind, commits, schema).sortWithinPartitions(*by, _names(schema)[1]).write.partitionBy(*by).parquet(f"{other.root}/{kind}")
        other._create("manifest/0.json", json.dumps({k: v for k, v in {**m, "n": 0}.items() if k != "top"}))
        return other

    def ship(self, archive: str) -> int:
        """Append to an archive what it lacks, from the sequence that it was last shipped to; returns the last sequence. Shipping again changes nothing."""
        m, other = self.manifest(), Store(self.spark, archive)
        after = max([int(x) for x in other._list("shipped")], default=0)
        if m["last"] > after:
            for kind, rows in (("data", self.versions(m)), ("ranges", self.tombstones(m))):
                rows.where(F.col("seq") > after).write.mode("overwrite").parquet(f"{archive}/{kind}/upto={m['last']}")
            other._create(f"shipped/{m['last']}", "")
        return m["last"]

    @staticmethod
    def read_archive(spark: SparkSession, archive: str) -> tuple[DataFrame, DataFrame]:
        """Versions and tombstones of all whole shipments."""
        done = Store(spark, archive)._list("shipped")
        out = []
        for kind, schema in (("data", VERSION), ("ranges", RANGE)):
            paths = [f"{archive}/{kind}/upto={n}" for n in done]
            out.append(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))
        return out[0], out[1]

    @staticmethod
    def restore(versions: DataFrame, tombstones: DataFrame, archive: tuple[DataFrame, DataFrame], base: int, target: int) -> tuple[DataFrame, DataFrame]:
        """The log at a point in time: the base copy and the archived commits whose highest sequence is in (base, target]. A commit that
        straddles the target is left out whole."""
        a, r = archive
        tops = a.select("commit_id", "seq").unionByName(r.select("commit_id", "seq")).groupBy("commit_id").agg(F.max("seq").alias("top"))
        ok = tops.where((F.col("top") > base) & (F.col("top") <= target)).select("commit_id")
        return versions.where(F.col("seq") <= base).unionByName(a.join(ok, "commit_id", "left_semi").select(*versions.columns)), tombstones.where(F.col("seq") <= base).unionByName(r.join(ok, "commit_id", "left_semi").select(*tombstones.columns))

    # checks
    def files(self) -> DataFrame:
        """Live files with rows, key bounds and an order-free checksum."""
        m = self.manifest()
        v = self._frame("data", m["data"], VERSION)
        return v.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("records"), F.min("key").alias("least"), F.max("key").alias("greatest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.bit_xor(F.xxhash64("cf", "key", "seq", "kind", "value")).alias("checksum"))

    def _sums(self) -> DataFrame:
        return self.files().select(F.substring_index("file", "/data/", -1).alias("file"), "records", "checksum")

    def seal(self) -> None:
        """Record the checksums of the live files in a table that the manifest names."""
        m = self.manifest()
        tag = self._tag(m)
        self._sums().write.parquet(f"{self.root}/seals/{tag}")
        self._install(m, seal=tag)

    def scrub(self) -> list[str]:
        """Names of sealed files that are missing or whose rows changed; only those come to the driver."""
        tag = self.manifest()["seal"]
        if not tag:
            return []
        sealed = self.spark.read.parquet(f"{self.root}/seals/{tag}")
        now = self._sums().select("file", F.col("records").alias("r"), F.col("checksum").alias("c"))
        bad = sealed.join(now, "file", "left").where("r is null or r <> records or c <> checksum")
        return sorted(r["file"] for r in bad.select("file").collect())

    def properties(self) -> dict:
        m = self.manifest()
        return {"last_sequence": m["last"], "earliest_readable_sequence": m["oldest"], "history_floor": m["floor"], "families": m["families"], "commits": m["commits"], "cursors": m["cursors"], "folders": len(m["data"]), "options": m["options"], "unreadable_manifests": m["top"] - m["n"]}

    # backups
    def backup(self, root: str) -> int:
        """A checkpoint under the next number of a catalogue, with the rows and checksum of its log."""
        catalogue = Store(self.spark, root)
        n = max([int(x[:-5]) for x in catalogue._list("catalogue")], default=0) + 1
        copy = self.checkpoint(f"{root}/{n}")
        catalogue._create(f"catalogue/{n}.json", json.dumps({"id": n, "last": self.manifest()["last"], **copy._digest()}))
        return n

    def _digest(self) -> dict:
        v, t = self.log(archived=True)
        a = v.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("cf", "key", "seq", "kind", "value")), F.lit(0)).alias("x")).first()
        b = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("cf", "start", "end", "seq")), F.lit(0)).alias("x")).first()
        return {"versions": a["n"], "tombstones": b["n"], "checksum": a["x"] ^ b["x"]}

    @staticmethod
    def backups(spark: SparkSession, root: str) -> list[dict]:
        s = Store(spark, root)
        return sorted((json.loads(s._read(f"catalogue/{x}")) for x in s._list("catalogue")), key=lambda x: x["id"])

    @staticmethod
    def verify_backup(spark: SparkSession, root: str, n: int) -> bool:
        entry = next(x for x in Store.backups(spark, root) if x["id"] == n)
        return Store(spark, f"{root}/{n}")._digest() == {k: entry[k] for k in ("versions", "tombstones", "checksum")}

    @staticmethod
    def purge_backups(spark: SparkSession, root: str, keep: int) -> list[int]:
        """Delete all but the newest `keep`; entries first, so that no entry names a half deleted copy."""
        s, all_ = Store(spark, root), Store.backups(spark, root)
        gone = [x["id"] for x in all_[: max(0, len(all_) - keep)]]
        for n in gone:
            s._fs.delete(s._path(f"catalogue/{n}.json"), False)
            s._fs.delete(s._path(str(n)), True)
        return gone

    # formats
    @staticmethod
    def inspect(spark: SparkSession, root: str) -> dict:
        """Format and counts of a store of any format."""
        s = Store(spark, root)
        m = next(x for x in map(s._parsed, s._numbers()) if x)
        return {"format_version": m["format_version"], "last_sequence": m["last"], "families": m["families"], "folders": len(m["data"]), "current": m["format_version"] == FORMAT}

    @staticmethod
    def migrate(spark: SparkSession, root: str) -> dict:
        """Rewrite a store of format 1 (folders <kind>/<commit>) as one of this format; one of this format stays."""
        s = Store(spark, root)
        numbers = s._numbers()
        old = next(x for x in map(s._parsed, numbers) if x)
        if old["format_version"] == FORMAT:
            return s.manifest()
        if old["format_version"] != 1:
            raise ValueError(f"format {old['format_version']}")
        moved: dict[str, list[str]] = {}
        for kind, schema in (("data", VERSION), ("ranges", RANGE), ("history", VERSION)):
            moved[kind] = [f.rsplit("/", 1)[-1] for f in old[kind]]
            for f, c in zip(old[kind], moved[kind], strict=True):
                w = spark.read.schema(schema).parquet(f"{root}/{f}").select(*_names(schema)).sortWithinPartitions("cf", _names(schema)[1]).write.mode("overwrite")
                (w.partitionBy("cf") if schema == VERSION else w).parquet(f"{root}/{kind}/commit={c}")
        cursors = {"default": {"default": int(old["cursor"])}} if old.get("cursor") else {}
        m = {"format_version": FORMAT, **_NEW, **moved, "last": old["last"], "oldest": old["oldest"], "families": old["families"], "commits": len(old["commits"]), "cursors": cursors, "top": numbers[0]}
        return s._install(m)


def _scope(family: str | None, start: str | None, end: str | None) -> Column:
    out = F.lit(True)
    for test in ((F.col("cf") == family) if family is not None else None, (F.col("key") >= start) if start is not None else None, (F.col("key") < end) if end is not None else None):
        out = out if test is None else out & test
    return out
