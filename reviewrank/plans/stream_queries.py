"""Streaming queries over the event table, run until the available input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import drift as D
from reviewrank.operators import records as C
from reviewrank.operators import scoring as S
from reviewrank.operators import serving as V
from reviewrank.plans.catalog import query, r6, sql_r6
from reviewrank.plans.feature_queries import valid_events
from reviewrank.plans.metric_queries import sql_psi
from reviewrank.sources import bridge as B
from reviewrank.sources import flat as FL
from reviewrank.sources import sinks
from reviewrank.session import cut_lineage
from reviewrank.streaming import ingest as I
from reviewrank.streaming import ledger as L

_EV = f"WITH {B.SQL_EVENTS}"
_HOUR = "1 hour"


def _stream(spark, sf_dir):
    """The event table as a stream of flat rows with an event time."""
    flat = B.flat_events(B.event_stream(spark, sf_dir))
    return flat.withColumn("at", F.timestamp_millis(F.col("ts_ms") + 1704067200000))


def _into_parquet(spark, df, name, mode="append"):
    path = sinks.new_folder(spark, name)
    I.run_available(df, path, sinks.new_folder(spark, f"{name}-checkpoint"), mode)
    return spark.read.schema(df.schema).parquet(path)


@query(f"""{_EV}, o AS (SELECT *, max(ts_ms) OVER (PARTITION BY session_id ORDER BY arrival_ms, event_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM ev)
SELECT event_seq, session_id, ts_ms FROM o WHERE ts_ms < newest - {B.LATE_MS}""")
def stream_late(spark, sf_dir):
    """The per-session late rule on a stream finds the same events as the batch rule."""
    out = _into_parquet(spark, I.late_flags(_stream(spark, sf_dir), B.LATE_MS), "late")
    return out.where("late").select("event_seq", "session_id", "ts_ms")


@query(f"""{_EV}, o AS (SELECT *, max(ts_ms) OVER (PARTITION BY session_id ORDER BY arrival_ms, event_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM ev)
SELECT event_seq, session_id, ts_ms, coalesce(ts_ms < newest - {B.LATE_MS}, false) AS late FROM o""")
def stream_split_late(spark, sf_dir):
    """The same rule with state in tables: every event comes out, accepted or late."""
    base = sinks.new_folder(spark, "late-split")
    L.split_late(_stream(spark, sf_dir), base, sinks.new_folder(spark, "late-split-checkpoint"), B.LATE_MS)
    of = lambda name, late: spark.read.schema("event_seq BIGINT, session_id STRING, ts_ms BIGINT").parquet(f"{base}/{name}").withColumn("late", F.lit(late))
    return of("accepted", False).unionByName(of("late", True)).select("event_seq", "session_id", "ts_ms", "late")


@query(f"""{_EV} SELECT CAST(count(*) FILTER (WHERE k % 50 > 1) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE k % 50 > 1) AS BIGINT) AS duplicates,
  CAST(2 * count(*) FILTER (WHERE k % 50 <= 1) AS BIGINT) AS dead FROM ev""")
def stream_balance(spark, sf_dir):
    """Every event sent twice: accepted, duplicate and dead rows add up to what arrived."""
    once = _stream(spark, sf_dir).withColumn("event_uid", F.concat(F.lit("event-"), F.col("event_seq").cast("string")))
    sent = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    base = sinks.new_folder(spark, "balance")
    L.ingest_all(sent, base, sinks.new_folder(spark, "balance-checkpoint"), F.col("ts_ms"), 100 * L.RETRY_MS)
    return L.balance(spark, base).agg(*[F.sum(c).alias(c) for c in ("accepted", "duplicates", "dead")])


@query(f"""{_EV} SELECT coalesce(CASE k % 50 WHEN 0 THEN 'confidence out of [0,1]' WHEN 1 THEN concat('unknown channel; ', event_type, ' on wrong channel') END, 'accepted') AS outcome,
  CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1""")
def stream_ingest(spark, sf_dir):
    """Every event sent twice: resends vanish, rejects go to the dead letter with their reason."""
    once = _stream(spark, sf_dir).withColumn("event_uid", F.concat(F.lit("event-"), F.col("event_seq").cast("string")))
    sent = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    valid, dead = sinks.new_folder(spark, "stream-events"), sinks.new_folder(spark, "stream-dead")
    I.ingest(I.deduplicated(sent, "at"), valid, dead, sinks.new_folder(spark, "stream-ingest-checkpoint"))
    good = spark.read.schema("event_seq BIGINT").parquet(valid).select(F.lit("accepted").alias("outcome"))
    bad = spark.read.text(dead).select(F.get_json_object("value", "$.reason").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n"))


def _windows(spark, df, name, keys):
    """Every window, closed or still open at the end of the input; starts as whole seconds since the epoch."""
    path = sinks.new_folder(spark, name)
    I.run_windows(df, path, sinks.new_folder(spark, f"{name}-checkpoint"))
    return _in_seconds(I.latest(spark.read.schema(df.schema.add("batch_id", "long")).parquet(path), keys))


def _in_seconds(windows):
    return windows.withColumns({c: F.unix_timestamp(c) for c, t in windows.dtypes if t == "timestamp"})


_MS = "(ts_ms + 1704067200000)"


def _sql_ticks(ms: int) -> str:
    return f"""{_EV} SELECT session_id, CAST({_MS} // {ms} * {ms // 1000} AS BIGINT) AS tick_start, CAST(count(*) AS BIGINT) AS n_events,
  max(p0) FILTER (WHERE event_type = 'FACE_OBSERVATION') AS faces, {sql_r6("sum(p0) FILTER (WHERE event_type = 'PASTE')", 'pasted')},
  min(p1) FILTER (WHERE event_type = 'IDENTITY_CHECK') AS verified FROM ev GROUP BY 1, 2"""


@query(_sql_ticks(3_600_000))
def stream_ticks(spark, sf_dir):
    """Hourly ticks of every session."""
    out = _windows(spark, I.tick_counts(_stream(spark, sf_dir), "at", _HOUR, _HOUR), "ticks", ["session_id", "tick_start"])
    return out.withColumn("pasted", r6("pasted"))


@query(f"SELECT * FROM ({_sql_ticks(36_000_000)}) WHERE n_events >= 2")
def stream_lanes(spark, sf_dir):
    """Ten-hour bins of every session that are active: two events at least."""
    out = _windows(spark, I.tick_counts(_stream(spark, sf_dir), "at", "10 hours", _HOUR), "lanes", ["session_id", "tick_start"])
    return out.where("n_events >= 2").withColumn("pasted", r6("pasted"))


@query(f"""{_EV}, w AS (SELECT session_id, CAST(({_MS} // 3600000 - k.k) * 3600 AS BIGINT) AS window_start, CASE WHEN event_type = 'IDENTITY_CHECK' THEN CAST(p1 < 0.5 AS DOUBLE) END AS v
  FROM ev, range(10) k(k))
SELECT session_id, window_start, CAST(window_start + 36000 AS BIGINT) AS window_end, {sql_r6('avg(v)', 'mean')}, CAST(count(v) AS BIGINT) AS observed FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Sliding means of identity mismatch over ten hours in hourly steps."""
    miss = F.when(F.col("event_type") == "IDENTITY_CHECK", (F.col("p1") < 0.5).cast("double"))
    base, checkpoint = sinks.new_folder(spark, "sliding"), sinks.new_folder(spark, "sliding-checkpoint")
    out = L.sliding_means(_stream(spark, sf_dir), "at", miss, base, checkpoint, "10 hours", _HOUR, _HOUR)
    return _in_seconds(out).withColumn("mean", r6("mean"))


@query(f"""{_EV}, w AS (SELECT session_id, {_MS} // 36000000 * 36000 AS s, count(*) AS n, max(CASE WHEN k % 5 = 0 THEN {_MS} / 1000.0 + 1200 END) AS e
  FROM ev WHERE event_type = 'INPUT_ACTIVITY' GROUP BY 1, 2)
SELECT session_id, CAST(s AS BIGINT) AS window_start, CAST(n AS BIGINT) AS keystrokes, {sql_r6('least(s + 36000, coalesce(e, s + 36000)) - s', 'window_s')} FROM w
WHERE e IS NULL OR e >= s + 36000 OR e - s >= 14400""")
def stream_keys(spark, sf_dir):
    """Input events in ten-hour windows; a fifth of them say that the session ends twenty minutes later."""
    ended = F.when(F.col("k") % 5 == 0, F.col("at") + F.expr("INTERVAL 20 MINUTES"))
    keys = _stream(spark, sf_dir).where("event_type = 'INPUT_ACTIVITY'").withColumn("ended", ended)
    out = _windows(spark, I.typing_counts(keys, "at", "10 hours", _HOUR, 14_400.0), "keys", ["session_id", "window_start"])
    return out.withColumn("window_s", r6("window_s"))


_CHECKS = "CAST(1 - p1 AS INT) AS y, 1 - p0 AS p, k / 100 AS load, CAST(k % 3 AS VARCHAR) AS lighting"


# all files that wait make one batch
@query(f"""{_EV}, ref AS (SELECT {_CHECKS} FROM valid WHERE event_type = 'IDENTITY_CHECK'), cur AS (SELECT 1 AS batch, {_CHECKS} FROM ev WHERE event_type = 'IDENTITY_CHECK'),
{sql_psi('ref', 'cur', 'batch', ['p', 'load'])}, mx AS (SELECT max(psi) AS max_psi FROM psi)
SELECT CAST(1 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS sessions, {sql_r6('any_value(max_psi)', 'max_psi')}, {sql_r6('avg(CAST(p >= 0.05 AS INT))', 'review_rate')},
  {sql_r6('count(*) FILTER (WHERE y = 0 AND p >= 0.05) / greatest(1, count(*) FILTER (WHERE y = 0))', 'clean_fpr')} FROM cur, mx""")
def stream_drift(spark, sf_dir):
    """Arriving identity checks as scored rows against the whole table as reference."""
    def scored(df):
        return df.where("event_type = 'IDENTITY_CHECK'").select(
            (1 - F.col("p1")).cast("int").alias("y"), (1 - F.col("p0")).alias("p"), (F.col("k") / 100).alias("load"), (F.col("k") % 3).cast("string").alias("lighting"))

    reference = scored(valid_events(spark, sf_dir))
    rate = D.review_rate(reference, 0.05)
    path = sinks.new_folder(spark, "drift")
    shares = cut_lineage(D.reference_shares(D.long_features(reference, ["p", "load"])))  # once, not in every micro-batch
    report = lambda rows: D.drift_report(None, rows, ["p", "load"], 0.05, "lighting", rate, shares=shares)
    I.drift(scored(_stream(spark, sf_dir)), report, path, sinks.new_folder(spark, "drift-checkpoint"))
    return spark.read.parquet(path).select("batch", "sessions", r6("max_psi").alias("max_psi"), r6("review_rate").alias("review_rate"), r6("clean_fpr").alias("clean_fpr"))


@query()
def score_directory(spark, sf_dir):
    """Session records written as text by session, scored with the baseline weights as a linear model."""
    path = sinks.new_folder(spark, "sessions")
    records = valid_events(spark, sf_dir).select("session_id", "event_seq", C.canonical_json().alias("value"))
    FL.write_session_lines(records, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = FL.read_session_lines(spark, path)
    model = S.RiskModel(list(R.RULE_WEIGHTS), list(R.RULE_WEIGHTS.values()), R.RULE_BIAS, {}, [0.0] * len(R.RULE_WEIGHTS))
    meta = valid_events(spark, sf_dir).select("session_id").distinct().withColumn("duration_s", F.lit(B.TICKS * B.STEP_MS / 1000.0))
    scored, failed = V.score_records(lines, meta, model, B.STEP_MS, B.LATE_MS)
    return scored.select("session_id", "overall_risk", "recommendation", F.size("flags").alias("n_flags")).unionByName(
        failed.select("session_id", F.lit(None).cast("double").alias("overall_risk"), F.lit("FAILED").alias("recommendation"), F.lit(0).alias("n_flags")))
