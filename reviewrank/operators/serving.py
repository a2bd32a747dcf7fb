"""From raw session records to assessments, for any number of sessions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.operators import features as FE
from reviewrank.operators import flags as L
from reviewrank.operators import grid as G
from reviewrank.operators import records as C
from reviewrank.operators import scoring as S


def score_records(records: DataFrame, meta: DataFrame, model: S.RiskModel, step_ms: int = 1000, late_ms: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """``(assessments, failures)`` of ``session_id, index, event`` rows with optional ``session_id, duration_s``.

    A session with a record that is not JSON fails as a whole; the others are scored.  Records that break
    the contract are left out; events too late in arrival order are dropped.
    """
    parsed = C.validate_records(records.withColumnRenamed("session_id", "_file"))
    named = parsed.withColumn("broken", (F.col("event").isNull() | F.col("_v").isNull()).cast("int"))
    failed = named.groupBy("_file").agg(F.sum("broken").alias("n")).where("n > 0").select(
        F.col("_file").alias("session_id"), F.concat(F.col("n").cast("string"), F.lit(" records are not JSON")).alias("error"))
    good = named.where("reason IS NULL").select("_file", F.col("index").cast("bigint").alias("event_seq"), *C.flat_columns())
    good = good.drop("session_id").withColumnRenamed("_file", "session_id").join(failed.select("session_id"), "session_id", "left_anti")
    events = G.late_flags(good, late_ms, ["event_seq"]).where(~F.col("late")).drop("late")
    every = records.select("session_id").distinct().join(failed.select("session_id"), "session_id", "left_anti")
    given = every.join(meta, "session_id", "left")
    seen = G.default_lengths(events, step_ms).select("session_id", F.col("duration_s").alias("_seen"))
    sized = given.join(seen, "session_id", "left").select("session_id", F.coalesce("duration_s", "_seen", F.lit(1.0)).alias("duration_s"))
    grid = G.session_grid(events, G.lengths_of(sized, step_ms), step_ms)
    return S.assessments(FE.session_features(grid), L.flags(grid, step_ms), model), failed
