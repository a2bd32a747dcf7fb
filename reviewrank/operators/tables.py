"""Changes to stored tables, expressed as new contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.operators.listing import latest


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, each key once."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """Both sets with one row per key, the newest."""
    both = existing.unionByName(incoming)
    return latest(both, key, newest, [c for c in both.columns if c not in key])


def replace_by_origin(events: DataFrame, incoming: DataFrame, origin: str) -> DataFrame:
    """Rows of ``origin`` are replaced for the sessions that ``incoming`` covers; other rows stay."""
    fresh = incoming.select("session_id").distinct().withColumn("_fresh", F.lit(True))
    kept = events.join(fresh, "session_id", "left").where(
        F.col("_fresh").isNull() | (F.col("origin") != origin)).drop("_fresh")
    return kept.unionByName(incoming)
