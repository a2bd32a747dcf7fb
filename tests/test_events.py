import json

from pyspark.sql import functions as F

from reviewrank.operators import grid as G
from reviewrank.operators import ingest as I
from reviewrank.operators import records as C
from reviewrank.operators import validate as V


def test_late_rule_in_arrival_order(spark, flat):
    rows = flat([("abc", t, "PASTE", 1) for t in (1000, 5000, 2000, 60000, 10000, 61000)])
    late = G.late_flags(rows, 30_000, ["event_seq"]).where("late").collect()
    assert [r["ts_ms"] for r in late] == [10000]


def test_late_rule_with_a_session_cut_into_chunks(spark, flat, tiny_tasks):
    ts = [(i * 7919) % 100_000 for i in range(200)]
    rows = flat([("hot" if i % 3 else f"s{i:03d}", t, "PASTE", 1) for i, t in enumerate(ts)])
    got = {r["event_seq"] for r in G.late_flags(rows, 30_000, ["event_seq"]).where("late").collect()}
    newest, want = {}, set()
    for i, t in enumerate(ts):
        sid = "hot" if i % 3 else f"s{i:03d}"
        newest[sid] = max(newest.get(sid, 0), t)
        if t < newest[sid] - 30_000:
            want.add(i)
    assert got == want and want


def test_valid_and_rejected_partition_the_batch(spark, flat):
    n = 20
    conf = [0.9] * n
    conf[3] = 1.2
    ts = list(range(n))
    kinds = [("abc", t, "PASTE", 5) for t in ts]
    kinds[5] = ("a!", 5, "PASTE", 5)
    kinds[7] = ("abc", -7, "PASTE", 5)
    kinds[9] = ("abc", 9, "PASTE", 2.5)
    rows = flat(kinds, confidence=conf)
    valid, rejected = V.split_valid(rows)
    bad = {r["event_seq"]: r["reason"] for r in rejected.collect()}
    assert bad == {3: "confidence out of [0,1]", 5: "invalid session_id", 7: "invalid ts_ms", 9: "payload.length invalid"}
    assert valid.count() + len(bad) == n


def test_all_reasons_of_a_row_are_listed(spark, flat):
    rows = flat([("abc", 1, "FACE_OBSERVATION", 30, 2, 0, 0)], frame_luma=[400.0], detector=[""])
    reason = V.with_reason(rows).first()["reason"]
    assert reason == "empty detector; payload.face_count invalid; payload.bbox_area_ratio invalid; quality.frame_luma out of range"


EVENT = {"schema": "event.v1", "session_id": "abc-1", "ts_ms": 5, "channel": "environment", "detector": "d", "detector_version": "1",
         "event_type": "OBJECT_DETECTED", "payload": {"label": "book", "bbox_x": 0.1, "bbox_y": 0.1, "bbox_w": 0.2, "bbox_h": 0.2},
         "confidence": 0.5, "quality": {"usable": True, "frame_luma": 90}}


def test_invalid_variants_of_one_record(spark):
    cases = [
        ({"schema": "v0"}, "schema must be"), ({"session_id": "x"}, "session_id must match"), ({"ts_ms": -1}, "ts_ms must be"),
        ({"ts_ms": 1.5}, "ts_ms must be"), ({"ts_ms": True}, "ts_ms must be"), ({"channel": "gps"}, "channel must be one of"),
        ({"confidence": 1.2}, "confidence must be"), ({"confidence": True}, "confidence must be"), ({"channel": "pose"}, "belongs to channel 'environment', not 'pose'"),
        ({"event_type": "NOPE"}, "not registered"), ({"detector": ""}, "detector must be"), ({"payload": {**EVENT["payload"], "label": "cat"}}, "payload.label must be one of"),
        ({"payload": {"label": "book", "bbox_x": 0.1, "bbox_y": 0.1, "bbox_w": 0.2}}, "payload.bbox_h missing"), ({"quality": {"frame_luma": 400}}, "frame_luma must be"),
        ({"payload": {**EVENT["payload"], "extra": 1}}, "unexpected fields ['extra']"), ({"payload": {**EVENT["payload"], "bbox_x": 1.5}}, "payload.bbox_x above 1"),
        ({"payload": []}, "payload must be an object"), ({"quality": {"usable": None}}, "quality.usable must be boolean"),
    ]
    rows = [(i, json.dumps({**EVENT, **change})) for i, (change, _) in enumerate(cases)] + [(99, json.dumps(EVENT)), (98, "not json")]
    got = {r["i"]: r["reason"] for r in C.validate_records(spark.createDataFrame(rows, "i INT, event STRING")).select("i", "reason").collect()}
    for i, (_, want) in enumerate(cases):
        assert want in (got[i] or ""), (i, got[i])
    assert got[99] is None and got[98] == "event must be a JSON object"


def test_flat_and_canonical_round_trip(spark, flat):
    rows = flat([("abc", 1, "HEAD_GAZE", 10.5, -3, 0, 0.25), ("abc", 2, "VOICE_ACTIVITY", 1, 0, 2, 1), ("abc", 3, "PASTE", 12),
                 ("abc", 4, "PRESENCE_UNKNOWN", None, None, None, None, "low_light")])
    text = rows.select("event_seq", C.canonical_json().alias("event"))
    assert json.loads(text.where("event_seq = 1").first()["event"])["payload"] == {
        "vad_active": True, "speaker_is_candidate": False, "n_speakers": 2, "foreign_speech": True}
    checked = C.validate_records(text)
    assert checked.where("reason IS NOT NULL").count() == 0
    back = checked.select("event_seq", *C.flat_columns())
    cols = ["event_seq", "session_id", "ts_ms", "event_type", "p0", "p1", "p2", "p3", "label", "usable", "frame_luma"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, rows.select(cols).collect()))


def test_telemetry_counts(spark):
    good = {**EVENT, "channel": "screen", "event_type": "PASTE", "payload": {"length": 5}}
    bad = {**good, "payload": {"length": -5}}
    rows = [(json.dumps(good), "abc-1", "uid-00001"), (json.dumps(good), "abc-1", "uid-00002"), (json.dumps(good), "abc-1", "uid-00002"),
            (json.dumps(bad), "abc-1", "uid-00003"), (json.dumps(EVENT), "abc-1", "uid-00004"), (json.dumps(good), "other", "short")]
    checked = I.validate_telemetry(spark.createDataFrame(rows, "event STRING, route_session STRING, event_uid STRING"))
    valid = checked.where("reason IS NULL").select(F.col("route_session").alias("session_id"), "event_uid")
    none = valid.limit(0)
    assert tuple(I.delivery_counts(valid, none).first()) == ("abc-1", 2, 1)
    assert tuple(I.delivery_counts(valid, valid).first()) == ("abc-1", 0, 3)
    reasons = [r["reason"] for r in checked.where("reason IS NOT NULL").collect()]
    assert "payload.length below 0" in reasons and any("only screen" in r for r in reasons) and any("match the URL; event_uid" in r for r in reasons)
