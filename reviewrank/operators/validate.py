"""Contract validation: every broken rule of an event becomes text; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.session import small_table


def registry_table(spark: SparkSession) -> DataFrame:
    """One row per event type with a struct per flat slot (25 rows, fixed size)."""
    slots = ["p0", "p1", "p2", "p3", "label"]
    cell = "STRUCT<name: STRING, kind: STRING, lo: DOUBLE, hi: DOUBLE, allowed: ARRAY<STRING>>"
    rows = []
    for name, t in R.TYPES.items():
        row = {"event_type": name, "_home": t["channel"]} | {f"_{s}": None for s in slots}
        for f in t["fields"]:
            lo, hi = (None if f[b] is None else float(f[b]) for b in ("lo", "hi"))
            row[f"_{f['slot']}"] = {"name": f["name"], "kind": f["kind"], "lo": lo, "hi": hi, "allowed": f["allowed"]}
        rows.append(row)
    return small_table(spark, rows, "event_type STRING, _home STRING, " + ", ".join(f"_{s} {cell}" for s in slots))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _slot_reason(slot: str) -> Column:
    spec, v = F.col(f"_{slot}"), F.col(slot)
    invalid = F.concat(F.lit("payload."), spec["name"], F.lit(" invalid"))
    if slot == "label":
        bad = ~F.coalesce(F.array_contains(spec["allowed"], v), F.lit(False))
    else:
        bad = (
            ~_finite(v)
            | ((spec["kind"] == "bool") & ~v.isin(0.0, 1.0))
            | ((spec["kind"] == "int") & (v != F.floor(v)))
            | F.coalesce(v < spec["lo"], F.lit(False))
            | F.coalesce(v > spec["hi"], F.lit(False))
        )
    return F.when(spec.isNotNull() & bad, invalid)


def with_reason(flat: DataFrame) -> DataFrame:
    """Flat events plus ``reason``: NULL when valid, else all broken rules joined by '; '."""
    missing = [c for c in R.FLAT_COLUMNS if c not in flat.columns]
    if missing:
        raise ValueError(f"batch is missing columns {missing}")
    known = F.broadcast(registry_table(flat.sparkSession))
    df = flat.join(known, "event_type", "left")
    ts, conf = F.col("ts_ms").cast("double"), F.col("confidence")
    home = F.col("_home")

    def rule(bad: Column, text: Column | str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(text) if isinstance(text, str) else text)

    def soft(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))

    checks = [
        rule(~F.col("session_id").rlike(R.SESSION_ID_PATTERN), "invalid session_id"),
        rule(~_finite(ts) | (ts < 0) | (ts != F.floor(ts)), "invalid ts_ms"),
        soft(ts > R.MAX_TS_MS, "ts_ms beyond the longest session"),
        rule(~F.col("channel").isin(R.CHANNELS), "unknown channel"),
        rule(F.col("detector") == "", "empty detector"),
        rule(F.col("detector_version") == "", "empty detector_version"),
        rule(~_finite(conf) | (conf < 0) | (conf > 1), "confidence out of [0,1]"),
        rule(home.isNull(), "unregistered event_type"),
        F.when(
            home.isNotNull() & ~F.coalesce(F.col("channel") == home, F.lit(False)),
            F.concat("event_type", F.lit(" on wrong channel")),
        ),
        *[_slot_reason(s) for s in ("label", "p0", "p1", "p2", "p3")],
        soft((F.col("frame_blur") < 0) | (F.col("frame_blur") > 1), "quality.frame_blur out of range"),
        soft((F.col("frame_luma") < 0) | (F.col("frame_luma") > 255), "quality.frame_luma out of range"),
    ]
    joined = F.concat_ws("; ", *checks)
    return df.select(*[flat[c] if c != "event_type" else F.col(c) for c in flat.columns], F.nullif(joined, F.lit("")).alias("reason"))


def split_valid(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; together they hold every input row."""
    checked = with_reason(flat)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())
