"""Flags, digests, lanes and logs over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.scalars import browser_name, clock_text, duration_text
from reviewrank.operators import flags as L
from reviewrank.operators import grid as G
from reviewrank.operators import timeline as T
from reviewrank.plans.catalog import query, r6, sql_r6
from reviewrank.plans.feature_queries import event_grid, valid_events
from reviewrank.plans.grid_sql import SQL_GRID, col
from reviewrank.sources import bridge as B

STEP = B.STEP_MS
_EV = f"WITH {B.SQL_EVENTS}"
_SIG = {
    "PHONE_USE": "coalesce(phone, 0)",
    "SECOND_PERSON": "CASE WHEN multi_face IS NOT NULL AND extra_person IS NOT NULL THEN greatest(multi_face, extra_person) ELSE 0 END",
    "IMPERSONATION": "coalesce(id_mismatch, 0)",
    "TAB_SWITCH": "coalesce(tab_hidden, 0)",
    "REMOTE_ASSISTANCE": "coalesce(foreign_ * (1 - coalesce(multi_face, 0)), 0)",
    "NOTE_READING": "coalesce(least(paper, 1) * CAST(coalesce(pitch_down, 0) > 12 AS INT), 0)",
}


def _sql_density() -> str:
    sig = ", ".join(f"{e} AS sig_{t}" for t, e in _SIG.items())
    out = []
    for t, w, *_ in R.FLAG_RULES:
        h = w // 2
        # trailing mean at sec + h, read back at sec; nothing beyond the last second
        lo = w - 1 - h
        before = f"{lo} PRECEDING" if lo > 0 else "CURRENT ROW"
        after = f"{h} FOLLOWING" if h > 0 else "CURRENT ROW"
        mean = f"avg(sig_{t}) OVER (PARTITION BY session_id ORDER BY sec ROWS BETWEEN {before} AND {after})"
        out.append(f"CASE WHEN sec + {h} < 720 THEN {mean} ELSE 0 END AS dens_{t}")
    return f"{SQL_GRID}, sg AS (SELECT session_id, sec, {sig} FROM grid), dn AS (SELECT *, {', '.join(out)} FROM sg)"


@query(_sql_density() + " SELECT session_id, CAST(sec AS BIGINT) AS sec, "
       + ", ".join(sql_r6(f"dens_{t}", f"dens_{t}") for t in _SIG) + " FROM dn")
def flag_density(spark, sf_dir):
    return L.flag_density(event_grid(spark, sf_dir)).select("session_id", "sec", *[r6(f"dens_{t}").alias(f"dens_{t}") for t in _SIG])


def _sql_flags() -> str:
    parts = [
        f"SELECT session_id, sec, '{t}' AS type, {i} AS rank, {gap} AS gap, '{text.replace(chr(39), chr(39) * 2)}' AS txt, "
        f"sig_{t} AS sig, dens_{t} >= {thr} AS act FROM dn"
        for i, (t, _, thr, gap, text) in enumerate(R.FLAG_RULES)
    ]
    return (
        _sql_density() + f", lg AS ({' UNION ALL '.join(parts)}), "
        "a AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY session_id, type ORDER BY sec) - 1 <= gap THEN 0 ELSE 1 END AS nw FROM lg WHERE act), "
        "b AS (SELECT *, sum(nw) OVER (PARTITION BY session_id, type ORDER BY sec) AS run FROM a), "
        "c AS (SELECT session_id, type, rank, txt, run, min(sec) AS s, max(sec) + 1 AS e FROM b GROUP BY ALL HAVING max(sec) + 1 - min(sec) >= 5), "
        "m AS (SELECT c.session_id, c.type, c.rank, c.txt, c.s, c.e, avg(lg.sig) AS conf FROM c JOIN lg ON lg.session_id = c.session_id AND lg.type = c.type "
        "AND lg.sec >= c.s AND lg.sec < c.e GROUP BY ALL), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank, s) AS nr FROM m) "
        "SELECT session_id, 'flg_' || lpad(CAST(nr AS VARCHAR), 3, '0') AS flag_id, type, "
        f"CAST(s * {STEP} AS BIGINT) AS t_start_ms, CAST(e * {STEP} AS BIGINT) AS t_end_ms, "
        "round_even(least(1.0, conf), 3) AS confidence, txt || ' for ' || (e - s) || ' seconds.' AS explanation FROM n"
    )


@query(_sql_flags())
def flags(spark, sf_dir):
    return L.flags(event_grid(spark, sf_dir), STEP).drop("evidence_ref")


def _sql_runs() -> str:
    long = " UNION ALL ".join(f"SELECT session_id, sec, '{s}' AS signal, {col(s)} AS v FROM grid" for s, *_ in R.ACTIVITY)
    return (
        f"{SQL_GRID}, ln AS ({long}), "
        "ra AS (SELECT session_id, signal, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY session_id, signal ORDER BY sec) <= 3 THEN 0 ELSE 1 END AS nw FROM ln WHERE v > 0.5), "
        "rb AS (SELECT *, sum(nw) OVER (PARTITION BY session_id, signal ORDER BY sec) AS run FROM ra), "
        "runs AS (SELECT session_id, signal, run, min(sec) AS a, max(sec) + 1 AS b, count(*) AS n FROM rb GROUP BY ALL)"
    )


@query(_sql_runs() + " SELECT session_id, signal, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS \"end\", CAST(n AS BIGINT) AS active FROM runs")
def runs_merged(spark, sf_dir):
    return T.activity_runs(event_grid(spark, sf_dir)).select("session_id", "signal", "start", "end", "active")


@query(_sql_runs() + """, o AS (SELECT session_id, signal, count(v) AS observed_s FROM ln GROUP BY ALL),
d AS (SELECT session_id, signal, sum(n) AS seconds, count(*) AS episodes, max(b - a) AS longest, min(a) AS first FROM runs GROUP BY ALL)
SELECT o.session_id, o.signal, CAST(coalesce(seconds, 0) AS BIGINT) AS seconds,
  CASE WHEN observed_s > 0 THEN round(coalesce(seconds, 0) / observed_s, 6) + 0.0 END AS share,
  CAST(coalesce(episodes, 0) AS BIGINT) AS episodes, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(d.first AS BIGINT) AS first,
  CAST(observed_s AS BIGINT) AS observed_s FROM o LEFT JOIN d ON o.session_id = d.session_id AND o.signal = d.signal""")
def session_digest(spark, sf_dir):
    return T.session_digest(event_grid(spark, sf_dir)).withColumn("share", r6("share"))


def _sql_labels(kind: str, labels: list[str], name: str) -> str:
    return f"""(SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM valid v
  WHERE v.session_id = s.session_id AND v.event_type = '{kind}' GROUP BY label)) AS {name}"""


@query(f"""{_EV}, s AS (SELECT session_id,
  count(*) FILTER (WHERE event_type = 'TAB_VISIBILITY' AND p0 = 1) AS tab_leaves, count(*) FILTER (WHERE event_type = 'FULLSCREEN_CHANGE' AND p0 = 0) AS fullscreen_exits,
  count(*) FILTER (WHERE event_type = 'PASTE') AS pastes, CAST(coalesce(sum(p0) FILTER (WHERE event_type = 'PASTE'), 0) AS BIGINT) AS pasted_chars,
  CAST(sum(p0) FILTER (WHERE event_type = 'INPUT_ACTIVITY') AS BIGINT) AS keystrokes, CAST(max(p0) FILTER (WHERE event_type = 'MONITOR_COUNT') AS BIGINT) AS max_monitors,
  count(*) FILTER (WHERE event_type = 'LIVENESS_CHECK') AS liveness_checks, count(*) FILTER (WHERE event_type = 'LIVENESS_CHECK' AND p1 = 0) AS liveness_failed,
  count(*) FILTER (WHERE event_type = 'IDENTITY_CHECK') AS identity_checks, min(p0) FILTER (WHERE event_type = 'IDENTITY_CHECK') AS identity_min_similarity,
  count(*) AS events_total FROM valid GROUP BY 1)
SELECT s.*, {_sql_labels('AUDIO_EVENT', R.AUDIO_EVENT_LABELS, 'audio_events')}, {_sql_labels('OBJECT_DETECTED', R.OBJECT_LABELS, 'objects')} FROM s""")
def session_counters(spark, sf_dir):
    out = T.session_counters(valid_events(spark, sf_dir))
    pairs = lambda c: F.nullif(F.array_join(F.array_sort(F.transform(
        F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","), F.lit(""))
    return out.withColumn("audio_events", pairs("audio_events")).withColumn("objects", pairs("objects"))


def _sql_toggle(name: str, kind: str, on: int) -> str:
    return f"""{name}0 AS (SELECT session_id, ts_ms, event_seq, p0, lag(p0, 1, {1 - on}) OVER (PARTITION BY session_id ORDER BY ts_ms, event_seq) AS was
  FROM valid WHERE event_type = '{kind}'),
{name}1 AS (SELECT session_id, p0, ts_ms, lead(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, event_seq) AS nxt FROM {name}0 WHERE p0 <> was),
{name} AS (SELECT session_id, ts_ms AS start_ms, nxt AS end_ms FROM {name}1 WHERE p0 = {on})"""


@query(f"{_EV}, {_sql_toggle('tab', 'TAB_VISIBILITY', 1)}, {_sql_toggle('fs', 'FULLSCREEN_CHANGE', 0)} "
       "SELECT 'tab' AS what, session_id, start_ms, end_ms FROM tab UNION ALL SELECT 'fullscreen', session_id, start_ms, end_ms FROM fs")
def toggle_pairs(spark, sf_dir):
    ev = valid_events(spark, sf_dir)
    tab = T.toggle_pairs(ev, "TAB_VISIBILITY", 1.0).withColumn("what", F.lit("tab"))
    return tab.unionByName(T.toggle_pairs(ev, "FULLSCREEN_CHANGE", 0.0).withColumn("what", F.lit("fullscreen")))


_SOUND = """snd0 AS (SELECT session_id, ts_ms, event_seq, label, lag(label) OVER (PARTITION BY session_id ORDER BY ts_ms, event_seq) AS pl,
  lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, event_seq) AS pt FROM valid WHERE event_type = 'AUDIO_EVENT' AND label <> 'keyboard_burst'),
snd1 AS (SELECT *, sum(CASE WHEN pl = label AND ts_ms - pt - 1000 <= 2500 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts_ms, event_seq) AS run FROM snd0),
snd AS (SELECT session_id, label, min(ts_ms) AS start_ms, max(ts_ms) + 1000 AS end_ms FROM snd1 GROUP BY session_id, label, run)"""


@query(f"{_EV}, {_SOUND} SELECT session_id, label, start_ms, end_ms FROM snd")
def sound_runs(spark, sf_dir):
    return T.sound_runs(valid_events(spark, sf_dir)).select("session_id", "label", "start_ms", "end_ms")


_LANE_BIN = 10 * STEP
_LANE_COND = {
    "Second face": "event_type = 'FACE_OBSERVATION' AND p0 >= 2", "No face": "event_type = 'FACE_OBSERVATION' AND p0 = 0",
    "Gaze off screen": "event_type = 'HEAD_GAZE' AND p3 < 0.5", "Phone detected": "event_type = 'OBJECT_DETECTED' AND label = 'cell_phone'",
    "Paper detected": "event_type = 'OBJECT_DETECTED' AND label = 'paper'", "Identity mismatch": "event_type = 'IDENTITY_CHECK' AND p1 = 0",
    "Other voice": "event_type = 'VOICE_ACTIVITY' AND p3 = 1", "Channel unknown": "event_type LIKE '%UNKNOWN'",
}
_LANE_SQL = " UNION ALL ".join(
    f"SELECT session_id, '{n}' AS lane, least(ts_ms // {_LANE_BIN}, 72) AS bin FROM valid WHERE {_LANE_COND[n]} GROUP BY ALL HAVING count(*) >= {m}"
    for n, m in R.LANES)


@query(f"""{_EV}, {_sql_toggle('tab', 'TAB_VISIBILITY', 1)}, lanes AS ({_LANE_SQL} UNION
  SELECT session_id, 'Tab hidden', unnest(range(start_ms // {_LANE_BIN}, coalesce(end_ms // {_LANE_BIN}, 72) + 1)) FROM tab),
la AS (SELECT session_id, lane, bin, bin - row_number() OVER (PARTITION BY session_id, lane ORDER BY bin) AS grp FROM (SELECT DISTINCT * FROM lanes))
SELECT session_id, lane, CAST(min(bin) * {_LANE_BIN} AS BIGINT) AS start_ms, CAST((max(bin) + 1) * {_LANE_BIN} AS BIGINT) AS end_ms FROM la GROUP BY session_id, lane, grp""")
def signal_lanes(spark, sf_dir):
    """Lanes of ten grid ticks."""
    ev = valid_events(spark, sf_dir)
    return T.signal_lanes(ev, B.session_lengths(ev), _LANE_BIN)


def _sql_span(sec: str) -> str:
    s = f"CAST(round_even({sec}, 0) AS BIGINT)"
    return (
        f"CASE WHEN {s} < 60 THEN {s} || ' s' WHEN {s} < 3600 THEN ({s} // 60) || ' min ' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || ' s' "
        f"ELSE ({s} // 3600) || ' h ' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ' min' END")


def _sql_log() -> str:
    took = _sql_span("(end_ms - start_ms) / 1000.0")
    sounds = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SOUND_NAMES.items()) + " END"
    branches = [
        f"SELECT session_id, start_ms AS t, end_ms AS \"end\", 'screen' AS kind, CASE WHEN end_ms IS NULL THEN 'Left the exam tab and did not return before the end' "
        f"ELSE 'Left the exam tab; returned after ' || {took} END AS text FROM tab",
        f"SELECT session_id, start_ms, end_ms, 'screen', 'Left full-screen mode for ' || {took} FROM fs WHERE end_ms IS NOT NULL",
        "SELECT session_id, ts_ms, NULL, 'screen', 'Pasted ' || CAST(p0 AS BIGINT) || ' characters into an answer' FROM valid WHERE event_type = 'PASTE'",
        "SELECT session_id, ts_ms, NULL, 'device', CAST(p0 AS BIGINT) || ' displays connected' FROM valid WHERE event_type = 'MONITOR_COUNT' AND p0 >= 2",
        "SELECT session_id, ts_ms, NULL, 'liveness', 'Liveness check failed (no blink in the last minute)' FROM valid WHERE event_type = 'LIVENESS_CHECK' AND p1 = 0",
        f"SELECT session_id, start_ms, end_ms, 'sound', {sounds} || ' heard for ' || {took} FROM snd",
    ]
    for s, n, sentence in R.ACTIVITY:
        if R.SIGNAL_CHANNEL[s] == "screen" or s == "pad_fail":
            continue
        words = sentence.replace("{d}", "").replace("'", "''").lower()
        branches.append(
            f"SELECT session_id, CAST(a * {STEP} AS BIGINT), CAST(b * {STEP} AS BIGINT), '{R.SIGNAL_CHANNEL[s]}', {_sql_span(f'(b - a) * {STEP} / 1000.0')} || '{words}' "
            f"FROM runs WHERE signal = '{s}' AND b - a >= {n}")
    return (_sql_runs() + f", {_sql_toggle('tab', 'TAB_VISIBILITY', 1)}, {_sql_toggle('fs', 'FULLSCREEN_CHANGE', 0)}, {_SOUND} "
            + " UNION ALL ".join(branches))


@query(_sql_log())
def event_log(spark, sf_dir):
    return T.event_log(valid_events(spark, sf_dir), event_grid(spark, sf_dir), STEP)


@query("SELECT event_id, " + _sql_span("value") + " AS short, " + _sql_span("value * 60") + " AS long, "
       "CASE WHEN m >= 3600 THEN (m // 3600) || ':' || lpad(CAST(m % 3600 // 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(m // 60 AS VARCHAR), 2, '0') END "
       "|| ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, value, CAST(round_even(value * 10, 0) AS BIGINT) AS m FROM events)", name="duration_text")
def duration_words(spark, sf_dir):
    """Durations and clock times as words."""
    ev = B.table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select("event_id", duration_text(v).alias("short"), duration_text(v * 60).alias("long"),
                     clock_text(F.rint(v * 10) * 1000).alias("clock"))
