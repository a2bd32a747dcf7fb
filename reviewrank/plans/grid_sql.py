"""The grid and the features as SQL over dense scaffolds, written apart from the Spark plans they check."""

from __future__ import annotations

from reviewrank.functions import registry as R
from reviewrank.plans.catalog import sql_r6
from reviewrank.sources.bridge import SQL_EVENTS

_P = "(PARTITION BY session_id ORDER BY sec"
_UP = f"{_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _held(col: str, k: int) -> str:
    return f"last_value({col} IGNORE NULLS) OVER {_P} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _of(fn: str, value: str, kind: str, more: str = "") -> str:
    return f"{fn}({value}) FILTER (WHERE event_type = '{kind}'{more})"


def _newest(kind: str) -> str:
    return _of("max", "{'t': ts_ms, 's': event_seq, 'v': p0}", kind)


SQL_GRID = f"""WITH {SQL_EVENTS},
sess AS (SELECT DISTINCT session_id FROM valid),
scaf AS (SELECT session_id, unnest(range(720)) AS sec FROM sess),
tk AS (SELECT session_id, least(ts_ms // 3600000, 719) AS sec,
  {_of('max', 'p0', 'FACE_OBSERVATION')} AS faces, {_of('max', 'p1', 'FACE_OBSERVATION')} AS face_area,
  {_of('max', 'sqrt(p2 * p2 + p3 * p3)', 'FACE_OBSERVATION')} AS face_offset, {_of('max', 'frame_luma', 'FACE_OBSERVATION')} AS luma,
  {_of('min', 'p0', 'IDENTITY_CHECK')} AS sim, {_of('min', 'p1', 'IDENTITY_CHECK')} AS ver, {_of('min', 'p1', 'LIVENESS_CHECK')} AS live,
  {_of('max', 'abs(p0)', 'HEAD_GAZE')} AS yaw, {_of('min', 'p1', 'HEAD_GAZE')} AS pitch, {_of('min', 'p3', 'HEAD_GAZE')} AS gaze,
  {_of('max', 'p0', 'PERSON_COUNT')} AS persons,
  {_of('count', '*', 'OBJECT_DETECTED', " AND label = 'cell_phone'")} AS phone_n,
  {_of('count', '*', 'OBJECT_DETECTED', " AND label IN ('book', 'paper')")} AS paper_n,
  {_of('min', 'p0', 'BODY_POSE')} AS hands, {_of('max', 'p1', 'BODY_POSE')} AS reach,
  {_of('max', 'p0', 'VOICE_ACTIVITY')} AS vad, {_of('max', 'p3', 'VOICE_ACTIVITY')} AS forn,
  {_of('count', '*', 'AUDIO_EVENT', " AND label = 'phone_ring'")} AS ring_n,
  {_of('count', '*', 'AUDIO_EVENT', " AND label = 'paper_rustle'")} AS rustle_n,
  {_of('sum', 'p0', 'PASTE')} AS pasted,
  {_newest('TAB_VISIBILITY')} AS tab, {_newest('FULLSCREEN_CHANGE')} AS fulls, {_newest('MONITOR_COUNT')} AS mon,
  {_of('count', '*', 'AUDIO_EVENT')} AS snd_n, {_of('count', '*', 'AUDIO_EVENT_UNKNOWN')} AS snd_x,
  {_of('count', '*', 'SCREEN_UNKNOWN')} AS scr_x FROM valid GROUP BY 1, 2),
kx AS (SELECT session_id, unnest(range(greatest(0, sec - w + 1), sec + 1)) AS sec, ts_ms, event_seq, p0 / w AS r FROM (
  SELECT session_id, least(ts_ms // 3600000, 719) AS sec, greatest(1, CAST(p1 AS BIGINT)) AS w, ts_ms, event_seq, p0
  FROM valid WHERE event_type = 'INPUT_ACTIVITY')),
kk AS (SELECT session_id, sec, max({{'t': ts_ms, 's': event_seq, 'v': r}}) AS keys FROM kx GROUP BY 1, 2),
wide AS (SELECT * FROM scaf LEFT JOIN tk USING (session_id, sec) LEFT JOIN kk USING (session_id, sec)),
st AS (SELECT *, {_held('sim', 5)} AS h_sim, {_held('ver', 5)} AS h_ver, {_held('live', 10)} AS h_live,
  {_held('persons', 2)} AS h_per, {_held('hands', 2)} AS h_hands, {_held('reach', 2)} AS h_reach,
  last_value(tab.v IGNORE NULLS) OVER {_UP} AS h_tab, last_value(fulls.v IGNORE NULLS) OVER {_UP} AS h_full,
  last_value(mon.v IGNORE NULLS) OVER {_UP} AS h_mon,
  median(pitch) OVER (PARTITION BY session_id) AS base_pitch,
  count(mon) OVER (PARTITION BY session_id) > 0 AS any_mon, count(keys) OVER (PARTITION BY session_id) > 0 AS any_keys,
  coalesce(sum(snd_x) OVER (PARTITION BY session_id), 0) > 0 AND coalesce(sum(snd_n) OVER (PARTITION BY session_id), 0) = 0 AS no_snd,
  coalesce(sum(scr_x) OVER (PARTITION BY session_id), 0) > 0 AND count(tab) OVER (PARTITION BY session_id) = 0 AS no_scr
  FROM wide),
grid AS (SELECT session_id, sec,
  CAST(faces < 1 AS DOUBLE) AS no_face, CAST(faces >= 2 AS DOUBLE) AS multi_face, face_area, face_offset,
  CAST(h_ver < 0.5 AS DOUBLE) AS id_mismatch, 1.0 - h_sim AS id_sim_low, CAST(h_live < 0.5 AS DOUBLE) AS pad_fail,
  yaw AS yaw_abs, CASE WHEN pitch IS NOT NULL THEN greatest(0.0, base_pitch - pitch) END AS pitch_down,
  CAST(gaze < 0.5 AS DOUBLE) AS gaze_off, CAST(h_per >= 2 AS DOUBLE) AS extra_person,
  CASE WHEN h_per IS NOT NULL THEN CAST(coalesce(phone_n, 0) > 0 AS DOUBLE) END AS phone,
  CASE WHEN h_per IS NOT NULL THEN CAST(coalesce(paper_n, 0) > 0 AS DOUBLE) END AS paper,
  h_reach AS reach, CAST(h_hands < 1 AS DOUBLE) AS hands_low, vad, forn AS foreign_,
  CASE WHEN vad IS NOT NULL AND NOT no_snd THEN CAST(coalesce(ring_n, 0) > 0 AS DOUBLE) END AS phone_ring,
  CASE WHEN vad IS NOT NULL AND NOT no_snd THEN CAST(coalesce(rustle_n, 0) > 0 AS DOUBLE) END AS paper_rustle,
  CASE WHEN NOT no_scr THEN coalesce(h_tab, 0.0) END AS tab_hidden,
  CASE WHEN NOT no_scr THEN 1.0 - coalesce(h_full, 1.0) END AS fs_off,
  CASE WHEN NOT no_scr THEN coalesce(pasted, 0.0) END AS paste_chars,
  CASE WHEN any_mon THEN CAST(coalesce(h_mon, 1.0) >= 2 AS DOUBLE) END AS multi_monitor,
  CASE WHEN any_keys THEN coalesce(keys.v, 0.0) END AS keys_per_s, luma,
  faces IS NOT NULL AS obs_presence, h_ver IS NOT NULL AS obs_identity, h_live IS NOT NULL AS obs_liveness,
  pitch IS NOT NULL AS obs_attention, h_per IS NOT NULL AS obs_environment, h_reach IS NOT NULL AS obs_pose,
  vad IS NOT NULL AS obs_audio_voice, vad IS NOT NULL AND NOT no_snd AS obs_audio_event, NOT no_scr AS obs_screen,
  any_mon AS obs_device, any_keys AS obs_behavioral FROM st)"""


def col(signal: str) -> str:
    return "foreign_" if signal == "foreign" else signal


def rolling(expr: str, w: int, length: int = 720) -> str:
    frame = f"{_P} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    fixed = f"CAST(round_even({expr} * 1e9, 0) AS BIGINT)"
    need = max(1, min(w, length) // 2)
    return f"CASE WHEN count({expr}) OVER {frame} >= {need} THEN sum({fixed}) OVER {frame} / 1e9 / count({expr}) OVER {frame} END"


def whole_stats(signals: list[str]) -> str:
    out = []
    for s in signals:
        c = col(s)
        out += [
            sql_r6(f"coalesce(avg({c}), 0)", f"{s}__mean"),
            sql_r6(f"coalesce(max({c}), 0)", f"{s}__max"),
            sql_r6(f"coalesce(stddev_pop({c}), 0)", f"{s}__std"),
        ]
    return ", ".join(out)


def longest_runs(signals: list[str]) -> str:
    """CTEs ``run_<signal>`` by gaps and islands, and the list of their joins."""
    ctes, cols, joins = [], [], []
    for s in signals:
        ctes.append(
            f"run_{s} AS (SELECT session_id, max(n) AS n FROM (SELECT session_id, grp, count(*) AS n FROM ("
            f"SELECT session_id, sec - row_number() OVER (PARTITION BY session_id ORDER BY sec) AS grp FROM grid "
            f"WHERE coalesce({col(s)}, 0) > {R.THRESHOLD[s]}) GROUP BY 1, 2) GROUP BY 1)"
        )
        cols.append(f"CAST(coalesce(run_{s}.n, 0) AS DOUBLE) AS {s}__longest_run_s")
        joins.append(f"LEFT JOIN run_{s} USING (session_id)")
    return f", {', '.join(ctes)} SELECT session_id, {', '.join(cols)} FROM sess {' '.join(joins)}"


def window_stats(signals: list[tuple], windows: list[int]) -> str:
    inner, outer = [], []
    for w in windows:
        for s, _, kind, thr in signals:
            cut = thr if kind == "continuous" else 0.5 * thr
            r = f"{s}_r{w}"
            inner.append(f"{rolling(col(s), w)} AS {r}")
            outer.append(sql_r6(f"coalesce(max({r}), 0)", f"{s}__w{w}_max"))
            outer.append(sql_r6(f"avg(CAST(coalesce({r}, 0) > {cut} AS DOUBLE))", f"{s}__w{w}_over"))
    return (
        f", rolled AS (SELECT session_id, {', '.join(inner)} FROM grid) "
        f"SELECT session_id, {', '.join(outer)} FROM rolled GROUP BY session_id"
    )


SQL_INTERACTIONS = "SELECT session_id, " + ", ".join(
    sql_r6(f"avg(CAST({cond} AS DOUBLE))", name)
    for name, cond in {
        "x_gaze_off_and_foreign": "coalesce(gaze_off, 0) > 0.5 AND coalesce(foreign_, 0) > 0.5",
        "x_phone_and_pitch_down": "coalesce(phone, 0) > 0.5 AND coalesce(pitch_down, 0) > 15",
        "x_multi_face_and_voice": "(coalesce(multi_face, 0) > 0.5 OR coalesce(extra_person, 0) > 0.5) AND coalesce(vad, 0) > 0.5",
        "x_mismatch_and_face": "coalesce(id_mismatch, 0) > 0.5 AND coalesce(no_face, 0) < 0.5",
        "x_gaze_off_no_typing": "coalesce(gaze_off, 0) > 0.5 AND coalesce(keys_per_s, 0) < 0.2",
        "x_paper_and_pitch_down": "coalesce(paper, 0) > 0.5 AND coalesce(pitch_down, 0) > 12",
        "x_foreign_and_keys": "coalesce(foreign_, 0) > 0.5 AND coalesce(keys_per_s, 0) > 1",
    }.items()
) + " FROM grid GROUP BY session_id"
