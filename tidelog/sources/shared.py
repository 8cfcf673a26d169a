"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []
_paths: dict[int, tuple[str, weakref.ref]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset and get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidelog-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; clear() deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/tidelog-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what was written through here in this process; DataFrames that read it can't be used any more."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (path, weakref.ref(out, lambda _, k=id(out): _paths.pop(k, None)))
    return out


def release(df: DataFrame) -> None:
    """Delete the table of a DataFrame that keep() returned, once nothing reads it any more; of any other DataFrame nothing."""
    path, _ = _paths.pop(id(df), (None, None))
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)
