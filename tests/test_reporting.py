import random

from pyspark.sql import functions as F

from reviewrank.operators import metrics as M
from reviewrank.operators import reporting as O
from reviewrank.operators import scoring as S


def scored(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = round(rng.random() ** 3, 3)
        rows.append((f"s{i:03d}", int(rng.random() < p), p, rng.choice(["bright", "dim"]), rng.choice(["a", "b", "c"])))
    return spark.createDataFrame(rows, "session_id STRING, y INT, p DOUBLE, lighting STRING, profile STRING")


def test_the_bundle_holds_every_part(spark):
    val, cal = scored(spark, 1), scored(spark, 2)
    span = "session_id STRING, type STRING, start_ms BIGINT, end_ms BIGINT"
    truth = spark.createDataFrame([("s1", "PHONE_USE", 0, 1000), ("s2", "PHONE_USE", 0, 1000)], span)
    flags = spark.createDataFrame([("s1", "PHONE_USE", 100, 1000)], span)
    got = {(r["part"], r["item"], r["metric"]): r["value"] for r in O.evaluation(val, cal, 0.3, ["lighting"], "profile", {"flags": O.episodes(truth, flags)}, 50).collect()}
    assert {p for p, _, _ in got} == {"validation", "intervals", "reliability", "slices", "disparity", "cost", "profiles", "flags"}
    head = M.summary(val, 0.3).first()
    assert got["validation", "all", "pr_auc"] == head["pr_auc"] and got["validation", "all", "fpr"] == head["fpr"]
    assert got["intervals", "pr_auc", "low"] <= head["pr_auc"] <= got["intervals", "pr_auc", "high"]
    for level in ("bright", "dim"):
        assert got["slices", f"lighting|{level}", "low"] <= got["slices", f"lighting|{level}", "fpr"] <= got["slices", f"lighting|{level}", "high"]
        assert got["slices", f"lighting|{level}", "underpowered"] == 1.0
    assert got["disparity", "lighting", "low"] <= got["disparity", "lighting", "high"] and got["disparity", "lighting", "fpr_disparity"] >= 1
    assert got["flags", "PHONE_USE", "mean_best_iou"] == 0.45 and len([k for k in got if k[0] == "profiles"]) == 6


def test_drift_watches_what_the_model_uses_most(spark):
    names = [f"f{i:02d}" for i in range(14)]
    model = S.RiskModel(names, [0.1 * (i + 1) for i in range(14)], -3.0, dict.fromkeys(names, 1), [0.0] * 14)
    rng = random.Random(4)
    make = lambda shift, n: spark.createDataFrame(
        [(f"s{i:04d}", int(rng.random() < 0.1), "bright", *[rng.random() + (shift if j in (2, 13) else 0.0) for j in range(14)]) for i in range(n)],
        "session_id STRING, y INT, lighting STRING, " + ", ".join(f"{n} DOUBLE" for n in names))
    got = O.model_drift(make(0.0, 300), make(0.0, 100).unionByName(make(5.0, 100).withColumn("session_id", F.concat(F.lit("t"), "session_id"))), model, ["session_id"], "lighting", 100).orderBy("batch").collect()
    assert [r["batch"] for r in got] == [1, 2] and set(got[0]["psi_by_feature"]) == set(names[4:])
    assert got[1]["max_psi_feature"] == "f13" and got[1]["max_psi"] > 1 > got[0]["max_psi"]


def test_failed_sessions_are_in_the_summary(spark):
    done = spark.createDataFrame([("a", "NO_ACTION"), ("b", "NO_ACTION"), ("c", "HUMAN_REVIEW")], "session_id STRING, recommendation STRING")
    failed = spark.createDataFrame([("d", "broken")], "session_id STRING, error STRING")
    got = {r["recommendation"]: (r["scored"], r["failed"]) for r in S.summary(done, failed).collect()}
    assert got == {"NO_ACTION": (2, 0), "HUMAN_REVIEW": (1, 0), None: (0, 1)}
