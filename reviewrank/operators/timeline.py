"""What happened in a session: digests, counters, lanes, toggles, sounds and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.prefix import Ordered
from reviewrank.functions.reshape import exploded
from reviewrank.functions.runs import merged_runs
from reviewrank.functions.scalars import capitalized, duration_text

_ORDER = ["ts_ms", "event_seq"]


def activity_runs(grid: DataFrame, merge_gap: int = 2) -> DataFrame:
    """``session_id, signal, start, end, active`` for every listed signal above one half."""
    cells = [F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s, *_ in R.ACTIVITY]
    long = exploded(grid, ["session_id", "sec"], F.array(*cells)).where("x.v > 0.5").select("session_id", "sec", "x.signal")
    return merged_runs(long, ["session_id", "signal"], "sec", F.lit(True), merge_gap)


def session_digest(grid: DataFrame) -> DataFrame:
    """Seconds, share of observed time, episodes, longest and first episode per session and signal."""
    runs = activity_runs(grid).groupBy("session_id", "signal").agg(
        F.sum("active").alias("seconds"), F.count("*").alias("episodes"),
        F.max(F.col("end") - F.col("start")).alias("longest"), F.min("start").alias("first"))
    names = [s for s, *_ in R.ACTIVITY]
    seen = grid.groupBy("session_id").agg(*[F.count(s).alias(s) for s in names])
    seen = seen.unpivot(["session_id"], names, "signal", "observed_s")
    zero = F.lit(0).cast("bigint")
    seconds = F.coalesce("seconds", zero)
    return seen.join(runs, ["session_id", "signal"], "left").select(
        "session_id", "signal", seconds.alias("seconds"),
        F.when(F.col("observed_s") > 0, seconds / F.col("observed_s")).alias("share"),
        F.coalesce("episodes", zero).alias("episodes"), F.coalesce("longest", zero).alias("longest"), "first", "observed_s")


def _label_counts(kind: str, labels: list[str]) -> Column:
    """Map label -> count; the contract bounds the labels."""
    pairs = [
        F.struct(F.lit(x).alias("k"), F.count(F.when((F.col("event_type") == kind) & (F.col("label") == x), 1)).alias("v"))
        for x in labels
    ]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"] > 0))


def session_counters(events: DataFrame) -> DataFrame:
    """Event counts and totals of each session in one aggregation."""
    et, p0, p1 = F.col("event_type"), F.col("p0"), F.col("p1")
    n = lambda cond: F.count(F.when(cond, 1))
    of = lambda kind, v: F.when(et == kind, v)
    return events.groupBy("session_id").agg(
        n((et == "TAB_VISIBILITY") & (p0 == 1)).alias("tab_leaves"),
        n((et == "FULLSCREEN_CHANGE") & (p0 == 0)).alias("fullscreen_exits"),
        n(et == "PASTE").alias("pastes"),
        F.coalesce(F.sum(of("PASTE", p0)), F.lit(0.0)).cast("bigint").alias("pasted_chars"),
        F.sum(of("INPUT_ACTIVITY", p0)).cast("bigint").alias("keystrokes"),
        F.max(of("MONITOR_COUNT", p0)).cast("bigint").alias("max_monitors"),
        n(et == "LIVENESS_CHECK").alias("liveness_checks"),
        n((et == "LIVENESS_CHECK") & (p1 == 0)).alias("liveness_failed"),
        n(et == "IDENTITY_CHECK").alias("identity_checks"),
        F.min(of("IDENTITY_CHECK", p0)).alias("identity_min_similarity"),
        _label_counts("AUDIO_EVENT", R.AUDIO_EVENT_LABELS).alias("audio_events"),
        _label_counts("OBJECT_DETECTED", R.OBJECT_LABELS).alias("objects"),
        F.count("*").alias("events_total"))


def toggle_pairs(events: DataFrame, kind: str, on_value: float) -> DataFrame:
    """``session_id, start_ms, end_ms`` of on..off stretches; repeats are ignored, an open one ends NULL."""
    rows = events.where((F.col("event_type") == kind) & F.col("p0").isin(0.0, 1.0)).select("session_id", *_ORDER, "p0")
    order = [F.col(c) for c in _ORDER]
    seen = Ordered(rows, ["session_id"], order).neighbours(prev={"_was": F.col("p0")})
    changes = seen.where(F.col("p0") != F.coalesce("_was", F.lit(1.0 - on_value))).drop("_was")
    paired = Ordered(changes, ["session_id"], order).neighbours(following={"end_ms": F.col("ts_ms")})
    return paired.where(F.col("p0") == on_value).select("session_id", F.col("ts_ms").alias("start_ms"), "end_ms")


def sound_runs(events: DataFrame) -> DataFrame:
    """Sounds of one label heard in close succession; typing is left out."""
    rows = events.where((F.col("event_type") == "AUDIO_EVENT") & (F.col("label") != "keyboard_burst"))
    rows = rows.select("session_id", *_ORDER, "label")
    order = [F.col(c) for c in _ORDER]
    seen = Ordered(rows, ["session_id"], order).neighbours(prev={"_label": F.col("label"), "_t": F.col("ts_ms")})
    same = (F.col("_label") == F.col("label")) & (F.col("ts_ms") - (F.col("_t") + R.SOUND_TAIL_MS) <= R.SOUND_GAP_MS)
    opened = seen.select("session_id", *_ORDER, "label", F.when(same, 0).otherwise(1).alias("_new"))
    numbered = Ordered(opened, ["session_id"], order).running(sums={"_run": F.col("_new")})
    return numbered.groupBy("session_id", "_run", "label").agg(
        F.min("ts_ms").alias("start_ms"), (F.max("ts_ms") + R.SOUND_TAIL_MS).alias("end_ms")).drop("_run")


def _lane_hits() -> list[Column]:
    et, lab = F.col("event_type"), F.col("label")
    p0, p1, p3 = F.col("p0"), F.col("p1"), F.col("p3")
    cond = {
        "Second face": (et == "FACE_OBSERVATION") & (p0 >= 2),
        "No face": (et == "FACE_OBSERVATION") & (p0 == 0),
        "Gaze off screen": (et == "HEAD_GAZE") & (p3 < 0.5),
        "Phone detected": (et == "OBJECT_DETECTED") & (lab == "cell_phone"),
        "Paper detected": (et == "OBJECT_DETECTED") & (lab == "paper"),
        "Identity mismatch": (et == "IDENTITY_CHECK") & (p1 == 0),
        "Other voice": (et == "VOICE_ACTIVITY") & (p3 == 1),
        "Channel unknown": et.endswith("_UNKNOWN"),
    }
    return [F.count(F.when(cond[name], 1)).alias(name) for name, _ in R.LANES]


def signal_lanes(events: DataFrame, lengths: DataFrame, bin_ms: int = R.LANE_MS) -> DataFrame:
    """``session_id, lane, start_ms, end_ms`` of active bins; a bin needs its lane's number of events."""
    last = lengths.select("session_id", F.ceil(F.col("duration_s") * 1000 / bin_ms).alias("_last"))
    binned = events.withColumn("_bin", F.floor(F.col("ts_ms") / bin_ms))
    counts = binned.groupBy("session_id", "_bin").agg(*_lane_hits()).join(last, "session_id")
    counts = counts.withColumn("_bin", F.least("_bin", "_last")).groupBy("session_id", "_bin").agg(
        *[F.sum(n).alias(n) for n, _ in R.LANES])
    cells = [F.struct(F.lit(n).alias("lane"), (F.col(n) >= least).alias("on")) for n, least in R.LANES]
    hits = exploded(counts, ["session_id", "_bin"], F.array(*cells)).where("x.on").select("session_id", "x.lane", "_bin")
    tab = toggle_pairs(events, "TAB_VISIBILITY", 1.0).join(last, "session_id").select(
        "session_id", F.lit("Tab hidden").alias("lane"),
        F.explode(F.sequence(
            F.least(F.floor(F.col("start_ms") / bin_ms), F.col("_last")),
            F.coalesce(F.least(F.floor(F.col("end_ms") / bin_ms), F.col("_last")), F.col("_last")))).alias("_bin"))
    every = hits.unionByName(tab).distinct()
    runs = merged_runs(every, ["session_id", "lane"], "_bin", F.lit(True), 0)
    return runs.select("session_id", "lane", (F.col("start") * bin_ms).alias("start_ms"), (F.col("end") * bin_ms).alias("end_ms"))


def event_log(events: DataFrame, grid: DataFrame, step_ms: int = 1000) -> DataFrame:
    """``session_id, t, end, kind, text``: everything a reviewer reads, one row per entry."""
    none = F.lit(None).cast("bigint")

    def text(name: str, *values: Column) -> Column:
        """The sentence with its gaps filled."""
        first, *rest = R.LOG_SENTENCES[name].split("{}")
        return F.concat(F.lit(first), *[p for v, r in zip(values, rest, strict=True) for p in (v, F.lit(r))]).alias("text")

    took = duration_text((F.col("end_ms") - F.col("start_ms")) / 1000)
    row = lambda df, t, end, kind, txt: df.select(
        "session_id", t.alias("t"), end.alias("end"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), txt)

    tab = toggle_pairs(events, "TAB_VISIBILITY", 1.0)
    full = toggle_pairs(events, "FULLSCREEN_CHANGE", 0.0).where("end_ms IS NOT NULL")
    left = F.when(F.col("end_ms").isNull(), text("tab_open")).otherwise(text("tab", took)).alias("text")
    start, end = F.col("start_ms"), F.col("end_ms")
    et, p0 = F.col("event_type"), F.col("p0").cast("bigint").cast("string")
    single = (
        F.when(et == "PASTE", F.struct(F.lit("screen").alias("kind"), text("paste", p0)))
        .when((et == "MONITOR_COUNT") & (F.col("p0") >= 2), F.struct(F.lit("device").alias("kind"), text("monitors", p0)))
        .when((et == "LIVENESS_CHECK") & (F.col("p1") == 0),
              F.struct(F.lit("liveness").alias("kind"), text("liveness")))
    )
    points = events.select("session_id", "ts_ms", single.alias("e")).where("e IS NOT NULL")
    sound = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in R.SOUND_NAMES.items()], F.col("label"))

    shown = {s: (n, sentence) for s, n, sentence in R.ACTIVITY if R.SIGNAL_CHANNEL[s] != "screen" and s != "pad_fail"}
    runs = activity_runs(grid.select("session_id", "sec", *[F.col(s) for s, *_ in R.ACTIVITY])).where(F.col("signal").isin(list(shown)))
    length = F.col("end") - F.col("start")
    least = F.coalesce(*[F.when(F.col("signal") == s, F.lit(n)) for s, (n, _) in shown.items()])
    channel = F.coalesce(*[F.when(F.col("signal") == s, F.lit(R.SIGNAL_CHANNEL[s])) for s in shown])
    span = duration_text(length * step_ms / 1000)
    sentence = F.coalesce(*[
        F.when(F.col("signal") == s, F.concat(F.lit(t.partition("{d}")[0]), span, F.lit(t.partition("{d}")[2])))
        for s, (_, t) in shown.items()])
    episodes = runs.where(length >= least)
    branches = [
        row(tab, start, end, "screen", left),
        row(full, start, end, "screen", text("full", took)),
        row(points, F.col("ts_ms"), none, F.col("e.kind"), F.col("e.text").alias("text")),
        row(sound_runs(events), start, end, "sound", text("sound", sound, took)),
        row(episodes, F.col("start") * step_ms, F.col("end") * step_ms, channel, capitalized(sentence).alias("text")),
    ]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
