import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewrank.operators import grid as G
from reviewrank.streaming import ledger as L


def stream_of(spark, rows, folder, parts):
    """``rows`` as a stream of as many micro-batches, in order."""
    for k, part in enumerate(parts):
        rows.where(F.col("event_seq").isin(part)).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("every", [2, 16])
def test_late_events_of_a_stream_equal_those_of_the_batch_rule(spark, flat, tmp_path, tiny_tasks, every):
    ts = [(i * 7919) % 90_000 for i in range(160)]
    sessions = ["hot"] * 5 + ["s1x", "s2x"]
    rows = flat([(sessions[i % 7], t, "PASTE", 1) for i, t in enumerate(ts)]).selectExpr("*", "event_seq AS arrival_ms")
    want = {r["event_seq"] for r in G.late_flags(rows, 30_000).where("late").collect()}
    stream = stream_of(spark, rows, tmp_path / "in", [list(range(k * 40, k * 40 + 40)) for k in range(4)])
    base = str(tmp_path / "out")
    L.split_late(stream, base, str(tmp_path / "cp"), 30_000, every)
    late, accepted = (spark.read.parquet(f"{base}/{n}").collect() for n in ("late", "accepted"))
    assert {r["event_seq"] for r in late} == want and want and len(late) + len(accepted) == 160
    assert set(rows.columns) == set(accepted[0].asDict()) - {"batch_id"}
    L.split_late(stream, base, str(tmp_path / "cp"), 30_000, every)  # nothing new: nothing changes
    assert spark.read.parquet(f"{base}/accepted").count() == len(accepted)


def test_every_delivery_is_accepted_once_or_told(spark, flat, tmp_path):
    rng = random.Random(3)
    n = 90
    day = 86_400_000
    made = [("sess", i * 1000, "PASTE", 1) for i in range(n)]
    uid, sent, conf = [], [], []
    for i in range(n):
        again = i > 10 and rng.random() < 0.4
        j = rng.randrange(i) if again else i
        uid.append(f"u{j:06d}")
        sent.append(j)
        conf.append(1.5 if j % 10 == 3 else 0.9)
    uid[70], sent[60], sent[80], uid[81] = None, 3 * day, 5, "never-seen"
    rows = flat(made, confidence=conf)
    extra = spark.createDataFrame(list(zip(range(n), uid, sent)), "event_seq long, event_uid string, sent_ms long")
    rows = rows.join(extra, "event_seq")
    stream = stream_of(spark, rows, tmp_path / "in", [list(range(k * 15, k * 15 + 15)) for k in range(6)])
    base = str(tmp_path / "out")
    L.ingest_all(stream, base, str(tmp_path / "cp"), F.col("sent_ms"), day, every=2)
    told = L.balance(spark, base).collect()
    assert sorted(r["batch_id"] for r in told) == list(range(6)) and all(r["accepted"] + r["duplicates"] + r["dead"] == 15 for r in told)
    accepted = [(r["event_seq"], r["event_uid"]) for r in spark.read.parquet(f"{base}/accepted").collect()]
    seen, want, dead, floor, newest = set(), [], 0, None, None
    for start in range(0, n, 15):
        for i in range(start, start + 15):
            if conf[i] > 1 or uid[i] is None or (floor is not None and sent[i] < floor):
                dead += 1
            elif uid[i] not in seen:
                seen.add(uid[i])
                want.append(i)
        newest = max([sent[i] for i in want])
        floor = newest - day
    assert len(accepted) == len({u for _, u in accepted}) == len(want) and {u for _, u in accepted} == {uid[i] for i in want}
    assert sum(r["dead"] for r in told) == dead
    reasons = [r[0] for r in spark.read.text(f"{base}/dead").collect()]
    assert sum(L.TOO_OLD in r for r in reasons) > 5 and sum("no session or delivery id" in r for r in reasons) == 1


@pytest.mark.parametrize("width, slide, delay", [(10, 2, 20), (7, 3, 5), (4, 4, 1)])
def test_sliding_means_of_many_batches_equal_counting_each_window(spark, tmp_path, tiny_tasks, width, slide, delay):
    rng = random.Random(width)
    n, parts = 120, 5
    ms, rows = 1000, []
    for i in range(n):
        late = rng.randrange(60 * ms) if rng.random() < 0.3 else 0
        at = None if i % 40 == 7 else -20 * ms + i * 500 - late
        rows.append((i, rng.choice(["hot", "hot", "s1x", None]), at, rng.choice([None, 0.0, 1.0, 0.25])))
    made = spark.createDataFrame(rows, "event_seq int, session_id string, ms long, v double").selectExpr("*", "timestamp_millis(ms) AS at")
    stream = stream_of(spark, made, tmp_path / "in", [list(range(k * n // parts, (k + 1) * n // parts)) for k in range(parts)])
    base = str(tmp_path / "out")
    args = (stream, "at", F.col("v"), base, str(tmp_path / "cp"), f"{width} seconds", f"{slide} seconds", f"{delay} seconds", 2)
    want, newest = {}, []
    for k in range(parts):
        closed = max([0, *[x - delay * ms for x in newest[: max(0, k - 1)]]])
        mine = rows[k * n // parts:(k + 1) * n // parts]
        for _, session, at, v in mine:
            for start in range(0 if at is None else (at - width * ms) // (slide * ms) + 1, 0 if at is None else at // (slide * ms) + 1):
                if start * slide * ms + width * ms > closed:
                    want.setdefault((session, start * slide), []).append(v)
        newest.append(max(at for _, _, at, _ in mine if at is not None))
    known = {k: [v for v in vs if v is not None] for k, vs in want.items()}
    for _ in range(2):  # the second time nothing is new and nothing changes
        got = L.sliding_means(*args).selectExpr("session_id", "unix_seconds(window_start) AS s", "unix_seconds(window_end) AS e", "mean", "observed").collect()
        assert {(r["session_id"], r["s"]): (r["e"] - r["s"], r["observed"], r["mean"] and pytest.approx(r["mean"])) for r in got} == {
            k: (width, len(vs), sum(vs) / len(vs) if vs else None) for k, vs in known.items()}
        assert len(got) == len(want)
    assert spark.read.parquet(f"{base}/panes").count() <= n


def test_stream_sliding_keeps_an_event_once_and_agrees_with_sql(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from reviewrank.session import shared_dir
    from tools.oracle_check import compare

    n = 200
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 7919 % 700 * 3600 + i) AS ts, i % 4 AS user_id,
      ['signup', 'error', 'view', 'click', 'purchase'][1 + i % 5] AS event_type, i * 13 % 100 AS value, '{{"k": ' || (i * 31 % 100) || '}}' AS props
      FROM range({n}) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("sliding-*"))
    message, windows = compare(spark, con, queries()["stream_sliding"], oracle_sql()["stream_sliding"], str(tmp_path))
    assert message == "" and windows > 4 * n
    written = [str(p) for made in set(shared.glob("sliding-*")) - before for p in made.rglob("*.parquet") if p.is_file()]
    assert written and con.execute("SELECT count(*) FROM read_parquet(?, union_by_name = true)", [written]).fetchone()[0] <= n + 1  # the newest time is a row too
    assert not [p for made in set(shared.glob("sliding-*")) - before for p in made.rglob("state/*/*/*.delta")]
