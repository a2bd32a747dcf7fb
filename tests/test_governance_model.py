import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import boosting
from reviewrank.operators import governance as H
from reviewrank.operators import metrics as M
from reviewrank.operators import scoring as S
from reviewrank.operators import training as T
from tests.test_calibration import plain_isotonic


def units(spark, n=2000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        profile = rng.choices(["a", "b", "c", "d"], [0.6, 0.3, 0.05, 0.05])[0]
        rows.append((f"s{i:05d}", f"p{rng.randrange(97):03d}", profile in "cd", profile))
    return rows, spark.createDataFrame(rows, "session_id STRING, unit STRING, violation BOOLEAN, profile STRING")


@pytest.mark.parametrize("split", [False, True])
def test_split_keeps_units_and_proportions(spark, split, request):
    if split:
        request.getfixturevalue("tiny_tasks")
    rows, df = units(spark)
    own = df.withColumn("unit", F.col("session_id"))
    got = H.stratified_split(own, 3).join(df.select("session_id", "profile"), "session_id").collect()
    assert len(got) == len(rows)
    for name, share in R.SPLITS:
        mine = [r for r in got if r["split"] == name]
        assert abs(len(mine) / len(rows) - share) < 0.01 and {r["profile"] for r in mine} == set("abcd")
    grouped = {}
    for r in H.stratified_split(df, 3).join(df.select("session_id", "unit"), "session_id").collect():
        grouped.setdefault(r["unit"], set()).add(r["split"])
    assert all(len(s) == 1 for s in grouped.values())


def test_holdout_opens_twice_only(spark, tmp_path):
    splits = spark.createDataFrame([(f"s{i}", "holdout" if i % 5 == 0 else "train") for i in range(50)], "session_id STRING, split STRING")
    held = splits.where("split = 'holdout'")
    sealed = H.ids_hash(held, "session_id").first()["ids_sha256"]
    log = str(tmp_path / "log")
    with pytest.raises(ValueError):
        H.open_holdout(splits, sealed, log, "short", "me")
    with pytest.raises(H.HoldoutSealed):
        H.open_holdout(splits.withColumn("session_id", F.concat("session_id", F.lit("x"))), sealed, log, "a proper purpose", "me")
    for _ in range(2):
        assert H.open_holdout(splits, sealed, log, "a proper purpose", "me").count() == 10
    with pytest.raises(H.HoldoutSealed):
        H.open_holdout(splits, sealed, log, "a proper purpose", "me")
    assert [r["access_no"] for r in H.accesses(spark, log).orderBy("access_no").collect()] == [1, 2]


def test_plain_ids_hash(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",), ("b",)], "id STRING")
    assert H.ids_hash(df, "id", digits=0).first()["ids_sha256"] == hashlib.sha256(b"a\nb").hexdigest()


def test_script_labels(spark):
    eps = spark.createDataFrame([("s1", 1000, 5000, "PHONE_USE", 1000), ("s1", 8000, -1, "TAB_SWITCH", None), ("s1", 90000, 95000, "NOTE_READING", None),
                                 ("s2", 1000, 5000, "PHONE_USE", 1000)],
                                "session_id STRING, scheduled_start_ms BIGINT, scheduled_end_ms BIGINT, violation_type STRING, shown_at_ms BIGINT")
    ses = spark.createDataFrame([("s1", 10.5, True), ("s2", 4.0, True), ("s3", 4.0, False)], "session_id STRING, duration_s DOUBLE, script_violation BOOLEAN")
    got = {r["session_id"]: r for r in H.script_labels(eps, ses).collect()}
    assert got["s1"]["violation_types"] == ["PHONE_USE", "TAB_SWITCH"] and got["s1"]["confidence"] == "uncertain" and got["s1"]["n_intervals"] == 2
    assert got["s2"]["confidence"] == "certain" and got["s2"]["violation"] and not got["s3"]["violation"]
    iv = {(r["session_id"], r["start_ms"], r["end_ms"]) for r in H.script_intervals(eps, ses).collect()}
    assert iv == {("s1", 1000, 5000), ("s1", 8000, 10500), ("s2", 1000, 4000)}


def feature_rows(spark, n=400):
    rng = random.Random(8)
    names = R.model_features()
    rows = []
    for i in range(n):
        vals = [rng.uniform(0, 0.3) if f.startswith("unk_") else max(0.0, rng.gammavariate(0.5, 1.0) - 0.2) for f in names]
        y = int(vals[names.index("phone__mean")] + vals[names.index("tab_hidden__mean")] + rng.gauss(0, 0.3) > 1.2)
        rows.append((f"s{i:04d}", y, ["train", "train", "validation", "calibration"][i % 4], *vals))
    return spark.createDataFrame(rows, "session_id STRING, y INT, split STRING, " + ", ".join(f"`{f}` DOUBLE" for f in names))


@pytest.mark.parametrize("family", ["trees", "linear"])
def test_missing_channels_never_raise_the_score(spark, family):
    names = [f for f in R.model_features() if f.endswith("__mean") or f.startswith(("unk_", "x_"))]
    frame = feature_rows(spark).select("session_id", "y", "split", *names).persist()
    if family == "trees":
        model = T.train(frame, names, ({"least_rows": 10, "rate": 0.2},), replicates=10, most_trees=20)
        assert model.trees and model.caps is None
        line = T.fit_linear(frame.where("split = 'train'"), names, model.directions)
        ap = {m: M.ranking(S.score(frame.where("split = 'validation'"), x).select("y", F.col("raw").alias("p"))).first()["pr_auc"] for m, x in (("trees", model), ("line", line))}
        assert ap["trees"] >= ap["line"] - 0.02 and ap["trees"] == pytest.approx(model.notes["trials"][0]["val_pr_auc"])
        prepared, parts = S.with_contributions(S.ready(frame, model), model)
        total = S.tree_sum(list(parts.values())) + F.lit(boosting.expected(model.trees, model.intercept))
        assert prepared.where(F.abs(total - S.margin(model)) > 1e-9).count() == 0 and prepared.count() == 400
    else:
        model = T.train(frame, names, [0.03], replicates=10, family="linear")
    assert all(w >= 0 if model.directions[f] > 0 else w <= 0 for f, w in zip(model.features, model.weights, strict=True) if model.directions[f])
    assert model.tiers["ROUTINE_REVIEW"] <= model.tiers["HUMAN_REVIEW"] <= model.tiers["PRIORITY_REVIEW"]
    test = {r["channel"]: r for r in T.missing_channel_test(frame, model).collect()}
    assert set(test) == set(R.CHANNELS)
    for r in test.values():
        assert r["share_increased"] == 0.0 and r["max_increase"] <= 1e-9
    full = {r["session_id"]: r["p"] for r in S.score(frame, model).select("session_id", "p").collect()}
    gone = {r["session_id"]: r["p"] for r in S.score(frame, model, ["environment"]).select("session_id", "p").collect()}
    assert all(gone[k] <= full[k] + 1e-9 for k in full)
    flags = spark.createDataFrame([("s0000", "flg_001", "PHONE_USE", 0, 9000, 0.5, "x", "e")],
                                  "session_id STRING, flag_id STRING, type STRING, t_start_ms BIGINT, t_end_ms BIGINT, confidence DOUBLE, explanation STRING, evidence_ref STRING")
    done = S.assessments(frame.withColumns({f"unk_{c}": F.coalesce(F.col(f"unk_{c}"), F.lit(0.0)) for c in R.CHANNELS}), flags, model)
    checked = done.withColumn("errors", S.assessment_errors())
    assert checked.where(F.size("errors") > 0).count() == 0
    assert done.where("recommendation = 'NO_ACTION' AND size(flags) > 0").count() == 0
    for r in done.limit(20).collect():
        texts = [c["explanation"] for c in r["top_contributors"]]
        assert len(texts) == len(set(texts)) <= 5 and r["confidence_band"][0] <= r["overall_risk"] + 1e-4 and r["overall_risk"] <= r["confidence_band"][1] + 1e-4


def test_illegal_transitions_across_chunks(spark, tiny_tasks):
    path = ["CREATED", "CONSENTED", "RECORDING", "COMPLETED", "REVIEWED"] * 8
    hist = spark.createDataFrame([("s1", i, s) for i, s in enumerate(path)], "session_id STRING, i INT, status STRING")
    bad = [(r["from_status"], r["status"]) for r in H.illegal_transitions(hist, ["i"]).collect()]
    want = [(a, b) for a, b in zip(path, path[1:], strict=False) if b not in R.TRANSITIONS[a]]
    assert sorted(bad) == sorted(want)


def test_a_missing_value_weighs_no_more_than_the_largest_seen(spark):
    rows = [(f"s{i}", int(i % 3 == 0), float(i % 3 == 0) + 0.1, 5.0 - 4 * (i % 3 == 0) + i % 2) for i in range(90)]
    frame = spark.createDataFrame(rows, "session_id STRING, y INT, a DOUBLE, b DOUBLE")
    model = T.fit_linear(frame, ["a", "b"], {"a": 1, "b": -1})
    assert model.caps == {"b": 6.0} and model.weights[1] < 0
    asked = spark.createDataFrame([("null", 1.1, None), ("most", 1.1, 6.0), ("beyond", 1.1, 1e9), ("low", 1.1, 1.0)], "session_id STRING, a DOUBLE, b DOUBLE")
    raw = {r["session_id"]: r["raw"] for r in S.score(asked, model).collect()}
    assert raw["null"] == raw["most"] == raw["beyond"] < raw["low"] and raw["null"] > 1e-4


def test_ablations_and_mitigation_share_their_passes(spark):
    names = ["phone__mean", "phone__w10_max", "bn_yaw_abs__w60_max", "tab_hidden__mean", "foreign__mean", "unk_device", *R.RULE_WEIGHTS]
    names = list(dict.fromkeys(names))
    frame = feature_rows(spark, 320).select("session_id", "y", "split", *names)
    got = {r["variant"]: r for r in T.ablations(frame, names, ["environment", "screen"], most_trees=10).collect()}
    assert set(got) == {"all features", "without environment", "without screen", "baseline normalisation off", "whole-session only", "whole-session + 10 s",
                        "whole-session + 60 s", "whole-session + 300 s", "logistic regression", "rule baseline"}
    assert got["without environment"]["val_pr_auc"] < got["all features"]["val_pr_auc"] and got["all features"]["n_features"] == len(names)
    assert all(0 <= r["val_fpr_at_op"] <= 1 and 0 <= r["val_recall_at_op"] <= 1 for r in got.values())
    cells = frame.withColumn("light", F.when(F.col("phone__mean") > 0.2, "dim").otherwise("bright"))
    out = T.mitigation(cells, names, ["light"], ["light"], most_trees=10).collect()
    assert {(r["variant"], r["factor"]) for r in out} == {("before", "light"), ("after", "light")}


def test_operating_point_equals_the_calibrated_threshold(spark, tiny_tasks):
    rng = random.Random(5)
    rows = [(v, rng.random() < 0.3, s, round(rng.random() ** 2, 2)) for v in "ab" for s in ("calibration", "validation") for _ in range(150)]
    rows += [("none", True, s, 0.5) for s in ("calibration", "validation")]
    frame = spark.createDataFrame([(v, int(y), s, p) for v, y, s, p in rows], "variant STRING, y INT, split STRING, p DOUBLE")
    got = T.operating_points(frame, 0.1).collect()
    for v in "ab":
        cal = [(y, p) for w, y, s, p in rows if w == v and s == "calibration"]
        xs, want = plain_isotonic(np.array([p for _, p in cal]), np.array([int(y) for y, _ in cal]))
        mapped = lambda p: np.interp(p, xs, want)  # noqa: B023, E731
        clean = sorted((mapped(p) for y, p in cal if not y), reverse=True)
        cut = clean[int(0.1 * len(clean))]
        for r in got:
            if r["variant"] == v:
                assert r["flagged"] == (mapped(r["p"]) > cut + 1e-12)
    assert [r["flagged"] for r in got if r["variant"] == "none"] == [True]


def test_content_digest_tells_every_change(spark):
    rows = [("a", 1, None), ("a|", 2, "x"), ("a", 1, None), ("", 3, "-")]
    make = lambda r, parts=1: spark.createDataFrame(r, "s STRING, n INT, t STRING").repartition(parts)
    digest = lambda r, parts=1: tuple(H.content_digest(make(r, parts)).first())
    own = digest(rows)
    assert own[0] == 4 and digest(rows[::-1], 3) == own
    changed = [rows[:3], rows + rows[:1], [("a", 1, ""), *rows[1:]], [("a", 2, None), *rows[1:]], [("a", 1, None), ("a", 2, "|x"), *rows[2:]], rows[:2] + rows[1:2] + rows[3:], []]
    assert len({own, *map(digest, changed)}) == 1 + len(changed)
    assert {r["t"]: r["rows"] for r in H.content_digest(make(rows), by=["t"]).collect()} == {None: 2, "x": 1, "-": 1}
