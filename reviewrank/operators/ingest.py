"""Ingest of event batches: rejects by index, browser telemetry rules, idempotent delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators.records import validate_records


def explode_batches(batches: DataFrame, column: str = "events") -> DataFrame:
    """JSON arrays of events -> one row per event with its ``index`` in the array."""
    items = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    others = [c for c in batches.columns if c != column]
    return batches.select(*others, F.posexplode_outer(items).alias("index", "event"))


def telemetry_rules(route: str = "route_session", uid: str = "event_uid") -> list[Column]:
    """Rules browser telemetry must meet on top of the event contract."""
    sent_to = F.coalesce(F.col("_t_session_id") == F.col(route), F.lit(False))
    channel = F.coalesce(F.col("_t_channel").isin(R.TELEMETRY_CHANNELS), F.lit(False))
    length = F.coalesce(F.length(uid).between(8, 64), F.lit(False))
    return [
        F.when(~sent_to, F.lit("session_id does not match the URL")),
        F.when(~channel, F.lit("only screen/device/behavioral telemetry may be posted by the browser")),
        F.when(~length, F.lit("event_uid (8-64 chars) is required for idempotent delivery")),
    ]


def validate_telemetry(posted: DataFrame) -> DataFrame:
    """``event`` (JSON), ``route_session`` and ``event_uid`` -> parsed rows with ``reason``."""
    return validate_records(posted, "event", telemetry_rules())


def delivery_counts(valid: DataFrame, stored: DataFrame) -> DataFrame:
    """``accepted`` and ``duplicates`` per session for rows keyed by (session_id, event_uid).

    Stored keys and new rows meet in one aggregation, so repeated deliveries shrink before the shuffle.
    """
    key = ["session_id", "event_uid"]
    both = valid.select(*key, F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(
        stored.select(*key, F.lit(0).alias("new"), F.lit(1).alias("old")))
    per_event = both.groupBy(*key).agg(F.sum("new").alias("sent"), F.max("old").alias("known")).where("sent > 0")
    accepted = F.sum((F.col("known") == 0).cast("bigint"))
    return per_event.groupBy("session_id").agg(
        accepted.alias("accepted"), (F.sum("sent") - accepted).alias("duplicates"))


def accepted_rows(valid: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append: one per key, none that is already stored."""
    key = ["session_id", "event_uid"]
    return valid.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
