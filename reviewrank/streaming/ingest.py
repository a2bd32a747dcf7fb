"""Structured Streaming forms of ingest, lateness, grids and drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from reviewrank.functions import registry as R
from reviewrank.operators import validate as V
from reviewrank.sources import sinks


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there into Parquet, then stop."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_windows(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write every micro-batch's new or changed windows, then stop.

    Windows still open at the end of the input are written too; each micro-batch owns a folder and replaces it when it
    is run again.  :func:`latest` reads the newest version of every window.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window of what :func:`run_windows` wrote: that of the last micro-batch that changed it.

    A micro-batch writes a window once, so all values are found under the same one.  Each is picked by itself: numbers are then
    aggregated by hash, where a struct would have all windows sorted.
    """
    values = [c for c in written.columns if c not in (*keys, "batch_id")]
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``each``, then stop."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def late_flags(events: DataFrame, window_ms: int = R.LATE_WINDOW_MS) -> DataFrame:
    """``session_id, event_seq, ts_ms, late`` on a live stream.

    The state of a session is the newest time seen.  It is exact for each session, which a watermark is
    not: that is one value for the whole stream, moved only between micro-batches.  A micro-batch brings
    the rows of a session in no order, so they are put in arrival order first; only four narrow columns
    reach Python.
    """
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["arrival_ms", "event_seq"], kind="stable")
        before = state.get[0] if state.exists else np.iinfo(np.int64).min
        ts = rows["ts_ms"].to_numpy(np.int64)
        newest = np.maximum(np.maximum.accumulate(ts), before)
        state.update((int(newest[-1]),))
        yield pd.DataFrame({"session_id": key[0], "event_seq": rows["event_seq"].to_numpy(), "ts_ms": ts, "late": ts < newest - window_ms})

    return events.select("session_id", "event_seq", "arrival_ms", "ts_ms").groupBy("session_id").applyInPandasWithState(
        step, "session_id string, event_seq long, ts_ms long, late boolean", "newest long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, event_time: str, retry: str = "1 day") -> DataFrame:
    """One row per delivery id; the state forgets ids once no resend can come any more."""
    return events.withWatermark(event_time, retry).dropDuplicatesWithinWatermark(["session_id", "event_uid"])


def ingest(events: DataFrame, valid_path: str, dead_path: str, checkpoint: str) -> None:
    """Split every micro-batch into the event store and the dead letter.

    Each micro-batch owns a folder, so a batch that is run again replaces its own output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = V.with_reason(batch).persist()
        try:
            good = checked.where("reason IS NULL").drop("reason")
            good.write.mode("overwrite").option("compression", "zstd").parquet(f"{valid_path}/batch_id={batch_id}")
            sinks.write_dead_letter_batch(checked.where("reason IS NOT NULL"), f"{dead_path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    run_batches(events, write, checkpoint)


def tick_counts(events: DataFrame, event_time: str, width: str = "1 second", delay: str = "30 seconds") -> DataFrame:
    """Per session and tumbling tick: events by channel and the values the grid reduces first."""
    et, p0 = F.col("event_type"), F.col("p0")
    return events.withWatermark(event_time, delay).groupBy("session_id", F.window(event_time, width)).agg(
        F.count("*").alias("n_events"), F.max(F.when(et == "FACE_OBSERVATION", p0)).alias("faces"),
        F.sum(F.when(et == "PASTE", p0)).alias("pasted"), F.min(F.when(et == "IDENTITY_CHECK", F.col("p1"))).alias("verified"),
    ).select("session_id", F.col("window.start").alias("tick_start"), "n_events", "faces", "pasted", "verified")


def typing_counts(keys: DataFrame, event_time: str, width: str = "10 seconds", delay: str = "30 seconds", least_s: float = 1.0) -> DataFrame:
    """Keystrokes per tumbling window; one that closes early counts only from ``least_s`` seconds on.

    ``keys`` has ``session_id``, the event time and ``ended`` (NULL, or when the session ended).
    """
    counted = keys.withWatermark(event_time, delay).groupBy("session_id", F.window(event_time, width)).agg(
        F.count("*").alias("keystrokes"), F.max("ended").alias("ended"))
    close = F.least(F.col("window.end"), F.coalesce("ended", F.col("window.end")))
    seconds = close.cast("double") - F.col("window.start").cast("double")
    full = F.col("ended").isNull() | (F.col("ended") >= F.col("window.end"))
    return counted.where(full | (seconds >= least_s)).select(
        "session_id", F.col("window.start").alias("window_start"), "keystrokes", F.round(seconds, 3).alias("window_s"))


def drift(scored: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """One drift report per arriving batch; ``report`` gets rows with ``batch``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch", F.lit(batch_id + 1).cast("bigint"))
        report(numbered).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(scored, write, checkpoint)
