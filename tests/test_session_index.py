import os

import pytest
from pyspark.sql import functions as F

from reviewrank.sources import flat as FL
from reviewrank.sources import session_index as IX
from reviewrank.sources import sinks


@pytest.fixture
def store(spark, flat, tmp_path):
    rows = flat([(f"s{i % 24:02d}", i * 100, "PASTE", i) for i in range(480)])
    path = str(tmp_path / "store")
    sinks.write_event_store(rows.drop("event_seq"), path, files=6)
    IX.build(spark, path)
    return path


def parts(path):
    return {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path) if n.startswith("part-")}


def counts(spark, path):
    return {r["session_id"]: r["count"] for r in FL.scan(spark, path).groupBy("session_id").count().collect()}


def test_a_read_opens_only_the_files_that_hold_the_session(spark, store):
    assert len(parts(store)) >= 4
    rows = IX.read_sessions(spark, store, ["s05"])
    opened = {os.path.basename(f) for f in rows.inputFiles()}
    assert opened == set(IX.files_of(spark, store, ["s05"])) and len(opened) < len(parts(store)) / 2
    assert sorted(r["p0"] for r in rows.collect()) == [float(i) for i in range(5, 480, 24)]
    assert IX.read_sessions(spark, store, ["nobody"]).count() == 0
    assert IX.entries(spark, store).agg(F.sum("n_events")).first()[0] == 480


def test_an_erasure_rewrites_only_the_files_concerned(spark, store):
    before, gone = parts(store), spark.createDataFrame([("s03",), ("s04",), ("nobody",)], "session_id STRING")
    hit = IX.erase_sessions(spark, store, gone)
    after = parts(store)
    assert 0 < len(hit) < len(before) and not set(hit) & set(after)
    assert {n: t for n, t in before.items() if n not in hit}.items() <= after.items()
    assert counts(spark, store) == {f"s{i:02d}": 20 for i in range(24) if i not in (3, 4)}
    assert {r["session_id"]: r["n"] for r in IX.entries(spark, store).groupBy("session_id").agg(F.sum("n_events").alias("n")).collect()} == counts(spark, store)
    assert IX.erase_sessions(spark, store, gone) == [] and parts(store) == after
    assert [n for n in os.listdir(store) if n.startswith("_erased")] == []


@pytest.mark.parametrize("stop_after", [0, 1, 2])
def test_an_erasure_that_was_cut_off_is_finished(spark, store, stop_after, monkeypatch):
    gone = spark.createDataFrame([("s10",)], "session_id STRING")
    whole, calls = IX._write, []

    def broken(entries, path):
        calls.append(1)
        raise OSError("lost")

    if stop_after == 0:  # before the exchange
        monkeypatch.setattr(IX, "recover", lambda *a: None)
        IX.erase_sessions(spark, store, gone)
        monkeypatch.undo()
        assert counts(spark, store)["s10"] == 20
    else:  # after it, before the index
        monkeypatch.setattr(IX, "_write", broken)
        for _ in range(stop_after):
            with pytest.raises(OSError):
                IX.recover(spark, store) if calls else IX.erase_sessions(spark, store, gone)
        monkeypatch.setattr(IX, "_write", whole)
    IX.recover(spark, store)
    assert counts(spark, store) == {f"s{i:02d}": 20 for i in range(24) if i != 10}
    assert IX.files_of(spark, store, ["s10"]) == [] and not os.path.exists(f"{store}/{IX.JOURNAL}")
