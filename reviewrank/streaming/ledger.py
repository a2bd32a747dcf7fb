"""Exact rules on a stream whose state outgrows a task: the late rule, loss-free ingest and sliding means.

Every micro-batch owns one folder per table below a base folder, and replaces it when it is run again; it reads only what
batches before it wrote.  Newest times and delivery ids of earlier batches are such tables: joined by key like any other,
spread over tasks, however many rows a session has.  State is written as changes; every few batches they are merged, so a
batch reads one merged table and a bounded number of changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import grid as G
from reviewrank.operators import validate as V
from reviewrank.sources import sinks
from reviewrank.streaming.ingest import run_batches

MERGE_EVERY = 16  # batches after which changes are merged
RETRY_MS = 86_400_000  # how long after an event its sender may repeat it
TOO_OLD = "arrived after its retry time"


def _folders(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batches that have a folder below ``base``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def _before(spark: SparkSession, base: str, batch_id: int, ddl: str) -> DataFrame:
    """What batches before ``batch_id`` left in ``base``: the newest merged table among them, and all changes since."""
    merged = [i for i in _folders(spark, f"{base}/merged") if i < batch_id]
    from_ = merged[-1] if merged else -1
    paths = [f"{base}/merged/batch_id={from_}"] if merged else []
    paths += [f"{base}/changes/batch_id={i}" for i in _folders(spark, f"{base}/changes") if from_ < i < batch_id]
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def _keep(state: DataFrame, changes: DataFrame, base: str, batch_id: int, merge, every: int) -> None:
    changes.write.mode("overwrite").parquet(f"{base}/changes/batch_id={batch_id}")
    if (batch_id + 1) % every == 0:
        own = changes.sparkSession.read.schema(changes.schema).parquet(f"{base}/changes/batch_id={batch_id}")
        merge(state.unionByName(own)).write.mode("overwrite").parquet(f"{base}/merged/batch_id={batch_id}")


def split_late(events: DataFrame, base: str, checkpoint: str, window_ms: int = R.LATE_WINDOW_MS, every: int = MERGE_EVERY) -> None:
    """Write a live stream's events into ``base/accepted`` and, where the late rule of their session holds, ``base/late``.

    Inside a micro-batch the newest time before an event comes from running maxima over chunks in arrival order; that of
    earlier batches is one row per session.  No task holds a session, and late events are kept, not dropped.  A row without a
    session or time can be neither early nor late and is accepted; validation is what refuses it.
    """
    ddl = "session_id string, newest long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _before(spark, f"{base}/state", batch_id, ddl)
        most = state.groupBy("session_id").agg(F.max("newest").alias("_before"))
        seen = G.with_newest(batch, "_newest").join(most, "session_id", "left")
        late = F.coalesce(F.col("ts_ms") < F.greatest("_newest", "_before") - window_ms, F.lit(False))
        split = seen.withColumn("_late", late).persist()
        try:
            for name, rows in (("accepted", ~F.col("_late")), ("late", F.col("_late"))):
                split.where(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
            newest = split.groupBy("session_id").agg(F.max("ts_ms").alias("newest"))
            _keep(state, newest, f"{base}/state", batch_id, lambda s: s.groupBy("session_id").agg(F.max("newest").alias("newest")), every)
        finally:
            split.unpersist()

    run_batches(events, write, checkpoint)


def ingest_all(events: DataFrame, base: str, checkpoint: str, sent_ms: Column, retry_ms: int = RETRY_MS, every: int = MERGE_EVERY) -> None:
    """Write every arriving event once: into ``base/accepted``, ``base/dead`` with its reason, or ``base/duplicates``.

    ``events`` are flat rows with ``event_uid``; ``sent_ms`` is the sender's clock.  A delivery whose (session, uid) was
    accepted before, in this batch or an earlier one, is a duplicate.  Ids are remembered for ``retry_ms`` behind the newest
    time of all batches before; what was sent earlier than that could repeat a forgotten id and goes to the dead letter,
    so nothing vanishes: accepted, duplicate and dead rows of a batch add up to its input, see :func:`balance`.
    """
    ddl = "session_id string, event_uid string, sent_ms long"
    key = ["session_id", "event_uid"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _before(spark, f"{base}/ids", batch_id, ddl)
        newest = state.agg(F.max("sent_ms")).first()[0]
        floor = None if newest is None else newest - retry_ms
        old = F.lit(False) if floor is None else F.coalesce(F.col("_sent") < floor, F.lit(False))
        nameless = F.when(F.col("session_id").isNull() | F.col("event_uid").isNull(), F.lit("no session or delivery id"))
        checked = V.with_reason(batch.withColumn("_sent", sent_ms.cast("long")))
        checked = checked.withColumn("reason", F.coalesce("reason", nameless, F.when(old, F.lit(TOO_OLD)))).withColumn("_row", F.monotonically_increasing_id()).persist()
        try:
            good = checked.where("reason IS NULL")
            fresh = good.join(state.select(*key), key, "left_anti")
            first = fresh.groupBy(*key).agg(F.min("_row").alias("_row"))
            names = [c for c in checked.columns if c not in ("_sent", "_row", "reason")]
            taken = good.join(first.select("_row"), "_row", "left_semi").persist()
            taken.select(*names).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/accepted/batch_id={batch_id}")
            good.join(first.select("_row"), "_row", "left_anti").select(*names).write.mode("overwrite").parquet(f"{base}/duplicates/batch_id={batch_id}")
            sinks.write_dead_letter_batch(checked.where("reason IS NOT NULL").drop("_sent", "_row"), f"{base}/dead/batch_id={batch_id}")
            ids = taken.select(*key, F.coalesce("_sent", F.lit(0).cast("long")).alias("sent_ms"))
            alive = (lambda s: s) if floor is None else (lambda s: s.where(F.col("sent_ms") >= floor))
            _keep(state, ids, f"{base}/ids", batch_id, alive, every)
            taken.unpersist()
        finally:
            checked.unpersist()

    run_batches(events, write, checkpoint)


def balance(spark: SparkSession, base: str) -> DataFrame:
    """``batch_id, accepted, duplicates, dead``: rows written per batch."""
    parts = None
    for name in ("accepted", "duplicates", "dead"):
        read = spark.read.text(f"{base}/{name}") if name == "dead" else spark.read.schema("session_id string, batch_id long").option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
        mine = read.groupBy("batch_id").agg(F.count("*").alias("n")).withColumn("to", F.lit(name))
        parts = mine if parts is None else parts.unionByName(mine)
    n = lambda to: F.coalesce(F.sum(F.when(F.col("to") == to, F.col("n"))), F.lit(0)).alias(to)
    return parts.groupBy("batch_id").agg(n("accepted"), n("duplicates"), n("dead"))


def _micros(spark: SparkSession, length: str) -> int:
    """Microseconds of a length like ``10 hours``."""
    return spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {length})").first()[0]


def sliding_means(events: DataFrame, event_time: str, value: Column, base: str, checkpoint: str, width: str = "60 seconds",
                  slide: str = "1 second", delay: str = "30 seconds", every: int = MERGE_EVERY) -> DataFrame:
    """Read a live stream until it is used up: ``session_id, window_start, window_end, mean, observed`` of all sliding windows with events.

    The batch rolling mean is the exact per-tick form.  An event is in up to ``width / slide`` windows but is copied into none:
    a micro-batch writes one row per session and slide with events, which names the first and last window they are in, and
    windows are put together from these rows where the result is read.  An event counts in windows that end later than
    ``delay`` before the newest event of all batches up to the last but one, as with a watermark.
    """
    spark = events.sparkSession
    wide, step, wait = (_micros(spark, x) for x in (width, slide, delay))
    if step > wide:
        raise ValueError("slide must not be longer than width")
    slide_of = lambda at: at - F.pmod(at, F.lit(step))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{base}/panes/batch_id={batch_id}"
        newest = lambda until: _before(spark, f"{base}/newest", until, "newest long")
        most = lambda rows: rows.agg(F.max("newest").alias("newest"))
        before = most(newest(batch_id - 1)).first()[0]
        closed = 0 if before is None else max(0, before // 1000 * 1000 - wait)  # a watermark has whole milliseconds
        starts = batch.withColumns({"first": F.greatest(slide_of(F.col("_at") - wide), slide_of(F.lit(closed - wide))) + step, "last": slide_of(F.col("_at"))})
        panes = starts.where("first <= last").groupBy("session_id", "first", "last").agg(
            F.sum("_value").alias("total"), F.count("_value").alias("observed"), F.max("_at").alias("newest"))
        panes.write.mode("overwrite").parquet(path)
        _keep(newest(batch_id), most(spark.read.schema("newest long").parquet(path)), f"{base}/newest", batch_id, most, every)

    run_batches(events.select("session_id", F.unix_micros(event_time).alias("_at"), value.cast("double").alias("_value")), write, checkpoint)
    panes = spark.read.schema("session_id string, first long, last long, total double, observed long").parquet(f"{base}/panes").repartition("session_id")
    if len(_folders(spark, f"{base}/panes")) > 1:
        panes = panes.groupBy("session_id", "first", "last").agg(F.sum("total").alias("total"), F.sum("observed").alias("observed"))
    windows = _windows_of(panes, step, (wide - 1) // step * step)
    return windows.select("session_id", F.timestamp_micros("start").alias("window_start"), F.timestamp_micros(F.col("start") + wide).alias("window_end"),
                          F.when(F.col("observed") > 0, F.col("total") / F.col("observed")).alias("mean"), "observed")


def _windows_of(panes: DataFrame, step: int, span: int) -> DataFrame:
    """``session_id, start, total, observed``: every window once, from panes that are each in the windows ``first`` to ``last``, ``span`` apart at most.

    A pane makes the windows up to its last one that no pane before it is in.  All other panes in them are at most ``span``
    ahead; sorted by their first windows, those in a window come first.  So windows from one such start to the next hold the same
    panes, are added up once, and no row is shuffled or hashed by window.
    """
    ordered = Window.partitionBy("session_id").orderBy("last", "first")
    ahead = Window.partitionBy("session_id").orderBy("last").rangeBetween(0, span)
    part = F.struct("first", F.coalesce("total", F.lit(0.0)).alias("total"), "observed")
    near = panes.withColumn("_before", F.lag("last").over(ordered)).withColumn("_in", F.array_sort(F.collect_list(part).over(ahead)))
    begin = lambda i: F.greatest(F.get("_in", i)["first"], F.col("_before") + step)
    end = lambda i: F.least(F.get("_in", i + 1)["first"] - step, F.col("last"))

    def run(i: Column) -> Column:
        held = F.slice("_in", F.lit(1), i + 1)
        add = lambda name, zero: F.aggregate(held[name], zero, lambda a, x: a + x).alias(name)
        return F.struct(begin(i).alias("from"), end(i).alias("to"), add("total", F.lit(0.0)), add("observed", F.lit(0).cast("long")))

    some = F.filter(F.sequence(F.lit(0), F.size("_in") - 1), lambda i: begin(i) <= end(i))
    runs = near.where("_before IS NULL OR _before < last").select("session_id", F.inline(F.transform(some, run)))
    return runs.select("session_id", F.explode(F.sequence("from", "to", F.lit(step))).alias("start"), "total", "observed")
