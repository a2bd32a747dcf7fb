"""Which files of an event store hold which sessions, so that a read or an erasure opens no others.

The index is a table below the store (``_sessions``), sorted by session: a lookup reads the row groups that can hold the
sessions asked for.  Readers of the store skip names that start with an underscore.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewrank.sources.flat import FLAT_SCHEMA

INDEX, JOURNAL = "_sessions", "_erasure"
_DDL = "session_id string, file string, n_events long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.schema(FLAT_SCHEMA).parquet(*paths)
    return rows.groupBy("session_id", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_events"))


def _write(entries: DataFrame, store: str) -> None:
    """Replace the index: a new folder is written, then named in the place of the old one."""
    spark, fresh = entries.sparkSession, f"{store}/{INDEX}-{uuid.uuid4().hex}"
    entries.repartitionByRange("session_id").sortWithinPartitions("session_id").write.parquet(fresh)
    fs, at = _fs(spark, f"{store}/{INDEX}")
    fs.delete(at, True)
    fs.rename(_fs(spark, fresh)[1], at)


def build(spark: SparkSession, store: str) -> None:
    """Index all files of a store."""
    _write(_entries(spark, [store]), store)


def entries(spark: SparkSession, store: str) -> DataFrame:
    """``session_id, file, n_events``."""
    return spark.read.schema(_DDL).parquet(f"{store}/{INDEX}")


def files_of(spark: SparkSession, store: str, sessions: DataFrame | list[str]) -> list[str]:
    """The files that hold any of ``sessions``: a list of ids, or a frame with ``session_id`` of any size."""
    held = entries(spark, store)
    if isinstance(sessions, list):
        hit = held.where(F.col("session_id").isin(sessions))
    else:
        hit = held.join(sessions.select("session_id"), "session_id", "left_semi")
    return sorted(r["file"] for r in hit.select("file").distinct().collect())  # names of files, as a read lists them anyway


def read_sessions(spark: SparkSession, store: str, sessions: list[str]) -> DataFrame:
    """The events of some sessions, from the files that hold them."""
    files = files_of(spark, store, sessions)
    if not files:
        return spark.createDataFrame([], FLAT_SCHEMA)
    return spark.read.schema(FLAT_SCHEMA).parquet(*[f"{store}/{f}" for f in files]).where(F.col("session_id").isin(sessions))


def erase_sessions(spark: SparkSession, store: str, gone: DataFrame) -> list[str]:
    """Remove all events of ``gone(session_id)``; returns the names of the files that were rewritten.

    What stays of those files is written beside the store first, then a journal names old and new files, and only then are
    they exchanged.  An erasure that was cut off is finished by :func:`recover`, which every erasure begins with; until then
    a reader may see the exchange half done, but nothing is lost.
    """
    recover(spark, store)
    old = files_of(spark, store, gone)
    if not old:
        return []
    staged = f"_erased-{uuid.uuid4().hex}"
    kept = spark.read.schema(FLAT_SCHEMA).parquet(*[f"{store}/{f}" for f in old]).join(gone.select("session_id"), "session_id", "left_anti")
    sorted_again = kept.repartitionByRange(len(old), "session_id", "ts_ms").sortWithinPartitions("session_id", "ts_ms")
    sorted_again.write.option("compression", "zstd").parquet(f"{store}/{staged}")
    fs, folder = _fs(spark, f"{store}/{staged}")
    new = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    plan = json.dumps({"old": old, "new": new, "staged": staged})
    spark.createDataFrame([(plan,)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/{JOURNAL}-new")
    fs.rename(_fs(spark, f"{store}/{JOURNAL}-new")[1], _fs(spark, f"{store}/{JOURNAL}")[1])
    recover(spark, store)
    return old


def recover(spark: SparkSession, store: str) -> None:
    """Finish an erasure that has a journal; each step may be repeated."""
    fs, at = _fs(spark, f"{store}/{JOURNAL}")
    if not fs.exists(at):
        return
    plan = json.loads(spark.read.text(f"{store}/{JOURNAL}").first()[0])
    for name in plan["new"]:
        there = _fs(spark, f"{store}/{plan['staged']}/{name}")[1]
        if fs.exists(there):
            fs.rename(there, _fs(spark, f"{store}/{name}")[1])
    for name in plan["old"]:
        fs.delete(_fs(spark, f"{store}/{name}")[1], False)
    rest = entries(spark, store).where(~F.col("file").isin(plan["old"] + plan["new"]))
    fresh = [f"{store}/{n}" for n in plan["new"]]
    _write(rest.unionByName(_entries(spark, fresh)) if fresh else rest, store)
    fs.delete(_fs(spark, f"{store}/{plan['staged']}")[1], True)
    fs.delete(at, True)
