import time

import pytest

from reviewrank.operators import grid as G
from reviewrank.operators import scoring as S
from reviewrank.operators import serving as V
from reviewrank.operators import timeline as T
from reviewrank.sources import flat as FL
from reviewrank.streaming import ingest as I


@pytest.mark.parametrize("split", [False, True])
def test_toggles_and_sounds(spark, flat, split, request):
    if split:
        request.getfixturevalue("tiny_tasks")
    ev = flat([("abc", 1000, "TAB_VISIBILITY", 0), ("abc", 2000, "TAB_VISIBILITY", 1), ("abc", 3000, "TAB_VISIBILITY", 1), ("abc", 9000, "TAB_VISIBILITY", 0),
               ("abc", 20000, "TAB_VISIBILITY", 1)] + [("abc", t, "AUDIO_EVENT", None, None, None, None, x) for t, x in
               ((1000, "door"), (4500, "door"), (8100, "door"), (9000, "phone_ring"), (9500, "keyboard_burst"), (10000, "door"))])
    got = sorted(map(tuple, T.toggle_pairs(ev, "TAB_VISIBILITY", 1.0).collect()))
    assert got == [("abc", 2000, 9000), ("abc", 20000, None)]
    runs = sorted((r["start_ms"], r["end_ms"], r["label"]) for r in T.sound_runs(ev).collect())
    assert runs == [(1000, 5500, "door"), (8100, 9100, "door"), (9000, 10000, "phone_ring"), (10000, 11000, "door")]


def test_stream_and_batch_agree_on_late_events(spark, flat, tmp_path):
    ts = [(i * 7919) % 90_000 for i in range(120)]
    rows = flat([(f"s{i % 4:02d}x", t, "PASTE", 1) for i, t in enumerate(ts)], ).withColumnRenamed("event_seq", "event_seq").selectExpr("*", "event_seq AS arrival_ms")
    want = {r["event_seq"] for r in G.late_flags(rows, 30_000).where("late").collect()}
    src = tmp_path / "in"
    for k in range(3):
        rows.where(f"event_seq BETWEEN {k * 40} AND {k * 40 + 39}").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    flagged = I.late_flags(stream, 30_000)
    I.run_available(flagged, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 120 and {r["event_seq"] for r in out.where("late").collect()} == want and want


def test_folder_of_sessions(spark, flat, tmp_path):
    from reviewrank.functions import registry as R
    from reviewrank.operators import records as C

    ev = flat([("abc", t * 1000, "TAB_VISIBILITY", t % 2) for t in range(20)])
    lines = [r[0] for r in ev.select(C.canonical_json()).collect()]
    (tmp_path / "abc.jsonl").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "abc.meta.json").write_text('{"duration_s": 40}')
    (tmp_path / "xyz.json").write_text("[" + ",".join(lines[:5]) + ', {"schema": "v0"}]')
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    records, meta = FL.read_session_folder(spark, str(tmp_path))
    assert [r["index"] for r in records.where("session_id = 'abc'").orderBy("index").collect()] == list(range(20))
    model = S.RiskModel(list(R.RULE_WEIGHTS), list(R.RULE_WEIGHTS.values()), R.RULE_BIAS, {}, [0.0] * len(R.RULE_WEIGHTS))
    scored, failed = V.score_records(records, meta, model)
    assert {r["session_id"] for r in scored.collect()} == {"abc", "xyz"}
    (tmp_path / "same.json").write_text("[" + ",".join(lines) + "]")
    (tmp_path / "same.meta.json").write_text('{"duration_s": 40}')
    scored, _ = V.score_records(*FL.read_session_folder(spark, str(tmp_path)), model)
    rows = {r["session_id"]: r.asDict() | {"session_id": None} for r in scored.drop("flags").collect()}
    assert rows["same"] == rows["abc"]  # a list and lines of the same records
    assert [(r["session_id"], r["error"]) for r in failed.collect()] == [("bad", "1 records are not JSON")]


def test_the_newest_version_of_a_window_needs_no_sort(spark, capsys):
    rows = [("a", 0, 0.5, 2, 0), ("a", 0, None, 3, 1), ("a", 1, 0.25, 4, 0), (None, 0, 1.0, 1, 2), (None, 0, 0.0, 2, 10), ("b", None, None, 0, 0)]
    written = spark.createDataFrame(rows, "session_id STRING, window_start BIGINT, mean DOUBLE, observed BIGINT, batch_id BIGINT")
    out = I.latest(written, ["session_id", "window_start"])
    assert set(map(tuple, out.collect())) == {("a", 0, None, 3), ("a", 1, 0.25, 4), (None, 0, 0.0, 2), ("b", None, None, 0)}
    out.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan
