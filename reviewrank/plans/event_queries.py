"""Scans, validation and ingest over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import governance as H
from reviewrank.operators import grid as G
from reviewrank.operators import ingest as I
from reviewrank.operators import records as C
from reviewrank.operators import validate as V
from reviewrank.plans.catalog import query, r6, sql_r6
from reviewrank.session import compiled_methods, cut_lineage
from reviewrank.sources import bridge as B
from reviewrank.sources import flat as S
from reviewrank.sources import session_index as IX
from reviewrank.sources import sinks

_EV = f"WITH {B.SQL_EVENTS}"
_FLAT = ", ".join(R.FLAT_COLUMNS)


@query(f"{_EV} SELECT session_id, CAST(count(*) AS BIGINT) AS n_events, CAST(min(ts_ms) AS BIGINT) AS first_ms, "
       "CAST(max(ts_ms) AS BIGINT) AS last_ms FROM valid GROUP BY 1")
def scan_events(spark, sf_dir):
    """Write the valid events as a store, scan it back, and summarise each session."""
    path = sinks.new_folder(spark, "events")
    sinks.write_event_store(V.split_valid(B.session_events(spark, sf_dir))[0].select(*R.FLAT_COLUMNS), path)
    return S.scan(spark, path).groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(f"{_EV} SELECT event_seq, ts_ms, event_type, p0, p1, p3, label FROM ev WHERE session_id = 'usr7'")
def scan_one_session(spark, sf_dir):
    cols = ["event_seq", "ts_ms", "event_type", "p0", "p1", "p3", "label"]
    return S.one_session(B.session_events(spark, sf_dir), "usr7", cols)


def _indexed_store(spark, sf_dir) -> str:
    path = sinks.new_folder(spark, "events")
    sinks.write_event_store(V.split_valid(B.session_events(spark, sf_dir))[0].select(*R.FLAT_COLUMNS), path)
    IX.build(spark, path)
    return path


@query(f"{_EV} SELECT session_id, CAST(count(*) AS BIGINT) AS n_events, true AS in_few_files FROM ev WHERE k % 50 > 1 GROUP BY 1")
def session_file_index(spark, sf_dir):
    """The events of every session by the index of a store, and that a session lies in one or two neighbouring files."""
    found = IX.entries(spark, _indexed_store(spark, sf_dir))
    return found.groupBy("session_id").agg(F.sum("n_events").alias("n_events"), (F.count("*") <= 2).alias("in_few_files"))


@query(f"{_EV} SELECT ts_ms, event_type, confidence FROM ev WHERE k % 50 > 1 AND session_id = 'usr7'")
def indexed_session(spark, sf_dir):
    """One session, read from the files that the index names."""
    return IX.read_sessions(spark, _indexed_store(spark, sf_dir), ["usr7"]).select("ts_ms", "event_type", "confidence")


@query(f"{_EV} SELECT session_id, CAST(count(*) AS BIGINT) AS n_events FROM ev WHERE k % 50 > 1 AND NOT session_id LIKE '%3' GROUP BY 1")
def erase_from_store(spark, sf_dir):
    """A store after an erasure that rewrote only the files concerned."""
    path = _indexed_store(spark, sf_dir)
    gone = IX.entries(spark, path).where("session_id LIKE '%3'").select("session_id").distinct()
    IX.erase_sessions(spark, path, cut_lineage(gone))
    return S.scan(spark, path).groupBy("session_id").agg(F.count("*").alias("n_events"))


@query(f"""{_EV} SELECT event_seq, k % 50 > 1 AS ok, CASE k % 50 WHEN 0 THEN 'confidence out of [0,1]'
  WHEN 1 THEN concat('unknown channel; ', event_type, ' on wrong channel') END AS reason FROM ev""")
def validate_split(spark, sf_dir):
    """Every row lands in exactly one of the two outputs."""
    valid, rejected = V.split_valid(B.session_events(spark, sf_dir))
    none = F.lit(None).cast("string")
    return valid.select("event_seq", F.lit(True).alias("ok"), none.alias("reason")).unionByName(
        rejected.select("event_seq", F.lit(False).alias("ok"), "reason"))


def posted_records(spark, sf_dir):
    """The events as JSON text, with one kind of fault per value of k % 50."""
    ev = B.session_events(spark, sf_dir)
    m = F.col("k") % 50
    paste = F.col("event_type") == "PASTE"
    conf = F.when(m == 6, F.lit("true")).otherwise(F.col("confidence").cast("string"))
    payload = (
        F.when(m == 7, F.lit("null"))
        .when(m == 2, F.concat(F.lit('{"zzz":1,'), F.substring(C.payload_json(), 2, 1_000_000)))
        .when((m == 12) & paste, F.lit('{"length":-5}'))
        .when((m == 13) & paste, F.lit('{"length":2.5}'))
        .when((m == 14) & paste, F.lit('{"length":"9"}'))
        .otherwise(C.payload_json())
    )
    ts = F.when(m == 3, F.lit("-5")).when(m == 11, F.lit("1.5")).otherwise(F.col("ts_ms").cast("string"))
    text = F.concat(
        F.lit('{"schema":"'), F.when(m == 4, F.lit("event.v0")).otherwise(F.lit("event.v1")),
        F.lit('","session_id":"'), F.when(m == 5, F.lit("x!")).otherwise(F.col("session_id")),
        F.lit('","ts_ms":'), ts,
        F.lit(',"channel":"'), F.col("channel"),
        F.lit('","detector":"'), F.when(m == 8, F.lit("")).otherwise(F.col("detector")),
        F.lit('","detector_version":"1.0","event_type":"'), F.when(m == 9, F.lit("NOPE")).otherwise(F.col("event_type")),
        F.lit('","payload":'), payload, F.lit(',"confidence":'), conf,
        F.when(m == 10, F.lit(',"quality":{"usable":"yes","frame_blur":2}')).otherwise(F.lit(',"quality":{"usable":true}')),
        F.lit("}"))
    return ev.withColumn("event", text)


_REASON = f"""CASE k % 50 WHEN 0 THEN 'confidence must be a number in [0, 1]'
  WHEN 1 THEN 'channel must be one of {C._listed(R.CHANNELS).replace("'", "''")}'
  WHEN 2 THEN 'payload has unexpected fields [''zzz'']'
  WHEN 3 THEN 'ts_ms must be a non-negative integer' WHEN 4 THEN 'schema must be ''event.v1'''
  WHEN 5 THEN 'session_id must match ^[A-Za-z0-9_-]{{3,64}}$' WHEN 6 THEN 'confidence must be a number in [0, 1]'
  WHEN 7 THEN 'payload must be an object' WHEN 8 THEN 'detector must be a non-empty string'
  WHEN 9 THEN 'event_type is not registered in event.v1'
  WHEN 10 THEN 'quality.usable must be boolean; quality.frame_blur must be in [0, 1]'
  WHEN 11 THEN 'ts_ms must be a non-negative integer'
  WHEN 12 THEN CASE WHEN event_type = 'PASTE' THEN 'payload.length below 0' END
  WHEN 13 THEN CASE WHEN event_type = 'PASTE' THEN 'payload.length must be an integer' END
  WHEN 14 THEN CASE WHEN event_type = 'PASTE' THEN 'payload.length must be numeric' END END"""


@query(f"{_EV} SELECT event_seq, {_REASON} AS reason FROM ev")
def validate_record(spark, sf_dir):
    return C.validate_records(posted_records(spark, sf_dir)).select("event_seq", "reason")


_SLOTS = "session_id, ts_ms, channel, event_type, confidence, p0, p1, p2, p3, label, usable, frame_luma"


@query(f"{_EV} SELECT event_seq, {_SLOTS} FROM valid")
def to_flat(spark, sf_dir):
    """Flat -> canonical -> flat gives the same rows."""
    valid, _ = V.split_valid(B.session_events(spark, sf_dir))
    parsed = C.parse(valid.select("event_seq", C.canonical_json().alias("event")))
    return parsed.select("event_seq", *C.flat_columns()).select("event_seq", *_SLOTS.split(", "))


def _sql_number(x: str) -> str:
    """A double as JSON text, its shortest digits with an exponent below a thousandth and from ten million on."""
    digits = f"ltrim(regexp_replace(split_part(CAST({x} AS VARCHAR), 'e', 1), '[-.]', '', 'g'), '0')"
    return (f"CASE WHEN {x} <> 0 AND (abs({x}) < 1e-3 OR abs({x}) >= 1e7) THEN CASE WHEN {x} < 0 THEN '-' ELSE '' END || left({digits}, 1) || '.' "
            f"|| coalesce(nullif(rtrim(substr({digits}, 2), '0'), ''), '0') || 'E' || CAST(floor(log10(abs({x}))) AS BIGINT) ELSE CAST(to_json({x}) AS VARCHAR) END")


def _sql_canonical() -> str:
    text = {"bool": "CAST(to_json(CAST({} AS BOOLEAN)) AS VARCHAR)", "int": "CAST(to_json(CAST({} AS BIGINT)) AS VARCHAR)", "label": "CAST(to_json({}) AS VARCHAR)"}
    cell = lambda f: text[f["kind"]].format(f["slot"]) if f["kind"] in text else _sql_number(f["slot"])
    payload = " ".join(
        f"WHEN '{name}' THEN '{{' || " + " || ',' || ".join(f"""'"{f["name"]}":' || coalesce({cell(f)}, 'null')""" for f in t["fields"]) + " || '}'"
        for name, t in R.TYPES.items())
    head = ", ".join(f"{c}: {c}" for c in ("session_id", "ts_ms", "channel", "detector", "detector_version", "event_type"))
    known = lambda c: f"""coalesce(',"{c}":' || {_sql_number(c)}, '')"""
    return f"""{_EV} SELECT event_seq, rtrim(CAST(to_json({{schema: '{R.EVENT_SCHEMA}', {head}}}) AS VARCHAR), '}}') || ',"payload":' || CASE event_type {payload} END
  || ',"confidence":' || {_sql_number('confidence')} || ',"quality":{{"usable":' || to_json(usable) || {known('frame_blur')} || {known('frame_luma')} || '}}}}' AS event FROM valid"""


@query(_sql_canonical())
def to_canonical(spark, sf_dir):
    """Flat rows as JSON texts of the contract, letter by letter."""
    valid, _ = V.split_valid(B.session_events(spark, sf_dir))
    return valid.select("event_seq", C.canonical_json().alias("event"))


@query(f"{_EV} SELECT event_seq, session_id, ts_ms, event_type, p0, p1, p2, p3, label FROM valid WHERE channel = 'screen'")
def events_from_store(spark, sf_dir):
    """Stored rows with a JSON payload -> flat columns of one channel."""
    valid, _ = V.split_valid(B.session_events(spark, sf_dir))
    stored = valid.where("channel = 'screen'").select("event_seq", C.canonical_json().alias("event"))
    flat = C.parse(stored).select("event_seq", *C.flat_columns())
    return flat.select("event_seq", "session_id", "ts_ms", "event_type", "p0", "p1", "p2", "p3", "label")


@query(f"""{_EV}, b AS (SELECT event_seq // 500 AS batch, event_seq % 500 AS index, {_REASON} AS reason FROM ev)
SELECT CAST(batch AS BIGINT) AS batch, CAST(index AS BIGINT) AS index, reason FROM b WHERE reason IS NOT NULL""")
def ingest_json_batch(spark, sf_dir):
    """Batches of 500 records as JSON arrays -> rejects with their index."""
    posted = posted_records(spark, sf_dir).withColumn("batch", F.floor(F.col("event_seq") / 500))
    arrays = posted.groupBy("batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_seq", "event"))), lambda s: s["event"]), ",").alias("a"))
    batches = arrays.select("batch", F.concat(F.lit("["), "a", F.lit("]")).alias("events"))
    checked = C.validate_records(I.explode_batches(batches))
    return checked.where("reason IS NOT NULL").select("batch", F.col("index").cast("bigint").alias("index"), "reason")


def posted_telemetry(spark, sf_dir):
    """Records with a delivery id and the session of the URL they were posted to."""
    return posted_records(spark, sf_dir).select(
        "event_seq", "event", F.col("session_id").alias("own"),
        F.concat(F.lit("evt-"), (F.col("event_seq") * 37).cast("string")).alias("event_uid"),
        F.when(F.col("k") % 7 == 0, F.lit("usr0")).otherwise(F.col("session_id")).alias("route_session"))


_TELEMETRY = f"""{_EV}, base_reason AS (SELECT *, {_REASON} AS r FROM ev), posted AS (SELECT event_seq,
  nullif(concat_ws('; ', r,
    CASE WHEN k % 50 = 5 OR (k % 7 = 0 AND session_id <> 'usr0') THEN 'session_id does not match the URL' END,
    CASE WHEN channel NOT IN ('screen', 'device', 'behavioral') THEN 'only screen/device/behavioral telemetry may be posted by the browser' END,
    CASE WHEN length('evt-' || (event_seq * 37)) NOT BETWEEN 8 AND 64 THEN 'event_uid (8-64 chars) is required for idempotent delivery' END), '') AS reason,
  CASE WHEN k % 7 = 0 THEN 'usr0' ELSE session_id END AS route_session, 'evt-' || (event_seq * 37) AS event_uid FROM base_reason)"""


@query(f"{_TELEMETRY} SELECT event_seq, reason FROM posted")
def ingest_telemetry(spark, sf_dir):
    compiled_methods(spark)  # the contract's rules make one long method
    return I.validate_telemetry(posted_telemetry(spark, sf_dir)).select("event_seq", "reason")


@query(f"""{_TELEMETRY}, sent AS (SELECT * FROM posted UNION ALL SELECT * FROM posted WHERE event_seq % 5 = 0),
good AS (SELECT * FROM sent WHERE reason IS NULL),
fresh AS (SELECT DISTINCT route_session, event_uid FROM good WHERE event_seq % 11 <> 0)
SELECT route_session AS session_id, CAST((SELECT count(*) FROM fresh f WHERE f.route_session = s.route_session) AS BIGINT) AS accepted,
  CAST(count(*) FILTER (WHERE reason IS NULL) - (SELECT count(*) FROM fresh f WHERE f.route_session = s.route_session) AS BIGINT) AS duplicates,
  CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS rejected FROM sent s GROUP BY s.route_session""")
def ingest_dedup(spark, sf_dir):
    """A resend of every fifth record against a store that has every eleventh one."""
    posted = posted_telemetry(spark, sf_dir)
    sent = posted.unionByName(posted.where("event_seq % 5 = 0"))
    checked = I.validate_telemetry(sent).select("event_seq", F.col("route_session").alias("session_id"), "event_uid", "reason")
    stored = posted.where("event_seq % 11 = 0").select(F.col("route_session").alias("session_id"), "event_uid")
    counts = I.delivery_counts(checked.where("reason IS NULL"), stored)
    per_session = checked.groupBy("session_id").agg(F.count("reason").alias("rejected"))
    zero = F.lit(0).cast("bigint")
    return per_session.join(counts, "session_id", "left").select(
        "session_id", F.coalesce("accepted", zero).alias("accepted"), F.coalesce("duplicates", zero).alias("duplicates"), "rejected")


@query(f"""{_EV} SELECT CASE k % 50 WHEN 0 THEN 'confidence out of [0,1]' ELSE concat('unknown channel; ', event_type, ' on wrong channel') END AS reason,
  CAST(count(*) AS BIGINT) AS n FROM ev WHERE k % 50 < 2 GROUP BY 1""")
def dead_letter_out(spark, sf_dir):
    """Write rejects as JSON lines and count them by reason from the file."""
    path = sinks.new_folder(spark, "deadletter")
    sinks.write_dead_letter(V.split_valid(B.session_events(spark, sf_dir))[1], path)
    lines = spark.read.text(path)
    return lines.groupBy(F.get_json_object("value", "$.reason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{_EV}, o AS (SELECT *, max(ts_ms) OVER (PARTITION BY session_id ORDER BY arrival_ms, event_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM ev)
SELECT event_seq, session_id, ts_ms FROM o WHERE ts_ms < newest - {B.LATE_MS}""")
def late_events(spark, sf_dir):
    """Events older than the newest one that arrived before them, by more than the window."""
    narrow = B.session_events(spark, sf_dir).select("session_id", "arrival_ms", "event_seq", "ts_ms")  # what the order is cut from is written
    flagged = G.late_flags(narrow, B.LATE_MS)
    return flagged.where("late").select("event_seq", "session_id", "ts_ms")


@query(f"""{_EV} SELECT CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions, CAST(count(*) FILTER (WHERE k % 50 > 1) AS BIGINT) AS n_events,
  CAST(count(*) FILTER (WHERE k % 50 < 2) AS BIGINT) AS dead_letter_events,
  {sql_r6("avg(CAST(event_type = 'PASTE' AS DOUBLE))", "paste_share")} FROM ev""")
def dataset_manifest(spark, sf_dir):
    """Counts of a registered dataset version; :func:`dataset_content` pins its rows."""
    checked = V.with_reason(B.session_events(spark, sf_dir))
    sessions = checked.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count("reason").alias("dead"), F.count(F.when(F.col("event_type") == "PASTE", 1)).alias("pastes"))
    return sessions.agg(
        F.count("*").alias("n_sessions"), (F.sum("n") - F.sum("dead")).alias("n_events"),
        F.sum("dead").alias("dead_letter_events"), r6(F.sum("pastes") / F.sum("n")).alias("paste_share"))


_CELLS = ["confidence", "detector", "event_type", "session_id", "ts_ms"]
_ROW_SQL = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _CELLS)
_PART_SQL = ", ".join(f"sum(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT)) AS p{i}" for i in range(4))


@query(f"""{_EV}, r AS (SELECT event_type, sha256({_ROW_SQL}) AS d FROM ev), s AS (SELECT event_type AS profile, count(*) AS n, {_PART_SQL} FROM r GROUP BY 1)
SELECT profile, CAST(n AS BIGINT) AS rows, sha256(n || '|' || p0 || '|' || p1 || '|' || p2 || '|' || p3) AS content_sha256 FROM s""")
def dataset_content(spark, sf_dir):
    """Rows and content digest of every part of a dataset, here by event type."""
    rows = B.session_events(spark, sf_dir).withColumn("profile", F.col("event_type"))
    return H.content_digest(rows.select("profile", *_CELLS), by=["profile"])
