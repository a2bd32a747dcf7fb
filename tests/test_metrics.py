import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewrank.functions.prefix import Ordered, exact_quantiles
from reviewrank.functions.scalars import wilson_low
from reviewrank.operators import drift as D
from reviewrank.operators import intervals as X
from reviewrank.operators import metrics as M
from reviewrank.operators import resampling as Z


def scored(spark, n=400, seed=1, digits=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((i, y, round(min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2))), digits), rng.choice("abc")))
    return rows, spark.createDataFrame(rows, "id BIGINT, y INT, p DOUBLE, g STRING")


def brute(rows):
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    ap, before = 0.0, 0.0
    for t in sorted({r[2] for r in rows}, reverse=True):
        tp, fp = sum(r[2] >= t for r in pos), sum(r[2] >= t for r in neg)
        ap += (tp / len(pos) - before) * tp / (tp + fp)
        before = tp / len(pos)
    auc = np.mean([1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a in pos for b in neg])
    return ap, auc


@pytest.mark.parametrize("split", [False, True])
def test_ranking_metrics(spark, split, request):
    if split:
        request.getfixturevalue("tiny_tasks")
    rows, df = scored(spark)
    ap, auc = brute(rows)
    got = M.ranking(df).first()
    assert got["pr_auc"] == pytest.approx(ap) and got["roc_auc"] == pytest.approx(auc)
    by_group = {r["g"]: r["pr_auc"] for r in M.ranking(df, ["g"]).collect()}
    for g in "abc":
        assert by_group[g] == pytest.approx(brute([r for r in rows if r[3] == g])[0])


def test_small_identities(spark):
    df = spark.createDataFrame([(0, .1), (0, .2), (0, .3), (0, .8), (1, .7), (1, .9)], "y INT, p DOUBLE")
    cut = M.fpr_thresholds(df, [0.25]).first()
    assert M.rates(df, M.above(cut["cut"], strict=not cut["inclusive"])).first()["fpr"] <= 0.25
    sure = spark.createDataFrame([(0, 0.0), (1, 1.0)], "y INT, p DOUBLE")
    assert M.calibration_error(sure).first()["ece"] == 0
    low = spark.createDataFrame([(0, 50), (10, 50), (0, 0)], "k INT, n INT").select(wilson_low(F.col("k"), F.col("n")).alias("w")).collect()
    assert low[0]["w"] == pytest.approx(0) and 0 < low[1]["w"] < 0.2 and low[2]["w"] == 0


@pytest.mark.parametrize("budget", [0.0, 0.03, 0.5, 1.0])
def test_threshold_is_the_lowest_in_budget(spark, budget):
    rows, df = scored(spark)
    cut = M.fpr_thresholds(df, [budget]).first()
    neg = sorted((r[2] for r in rows if not r[1]), reverse=True)
    k = math.floor(budget * len(neg))
    assert cut["cut"] == (neg[-1] if k >= len(neg) else neg[k]) and cut["inclusive"] == (k >= len(neg))


def test_cost_curve_matches_all_candidates(spark):
    rows, df = scored(spark)
    for r in M.cost_curve(df, df).collect():
        ratio = r["fp_to_fn_cost_ratio"]
        costs = [(ratio * sum(x[2] >= t and not x[1] for x in rows) + sum(x[2] < t and x[1] for x in rows), t) for t in {x[2] for x in rows} | {1.01}]
        assert r["threshold"] == min(costs)[1]


@pytest.mark.parametrize("split", [False, True])
def test_exact_quantiles(spark, split, request):
    if split:
        request.getfixturevalue("tiny_tasks")
    rng = random.Random(3)
    rows = [("ab"[i % 2], round(rng.random(), 2)) for i in range(301)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    probs = [0.0, 0.1, 0.37, 0.5, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        assert r["q"] == pytest.approx(list(np.quantile([v for k, v in rows if k == r["k"]], probs)))


def test_running_values_across_chunks(spark, tiny_tasks):
    rows = [("hot" if i % 4 else "cold", i, float((i * 37) % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "k STRING, i INT, v DOUBLE")
    got = {(r["k"], r["i"]): r for r in Ordered(df, ["k"], [F.col("i")]).running(sums={"s": F.col("v")}, maxes={"m": F.col("v")}).collect()}
    near = {(r["k"], r["i"]): r for r in Ordered(df, ["k"], [F.col("i")]).neighbours(prev={"a": F.col("v")}, following={"b": F.col("i")}).collect()}
    for key in ("hot", "cold"):
        mine = [r for r in rows if r[0] == key]
        for j, (k, i, _) in enumerate(mine):
            assert got[k, i]["s"] == sum(r[2] for r in mine[: j + 1]) and got[k, i]["m"] == max(r[2] for r in mine[: j + 1])
            assert near[k, i]["a"] == (mine[j - 1][2] if j else None) and near[k, i]["b"] == (mine[j + 1][1] if j + 1 < len(mine) else None)


def test_psi_against_histograms(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.normal(0, 1, 500).round(2), rng.normal(0.5, 1, 300).round(2)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, c = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-4, None) for x in (ref, cur))
    frame = lambda x, name, b: [(b, name, float(v)) for v in x]
    flat = [("only", "flat", 3.0)] * 90 + [("only", "flat", 4.0)] * 10
    schema = "b STRING, feature STRING, value DOUBLE"
    got = {x["feature"]: x["psi"] for x in D.psi(
        spark.createDataFrame(frame(ref, "f", "x") + [("x", "flat", 3.0)] * 50, schema).drop("b"),
        spark.createDataFrame(frame(cur, "f", "one") + flat, schema), ["b"]).collect()}
    assert got["f"] == pytest.approx(float(((c - r) * np.log(c / r)).sum()))
    assert got["flat"] == pytest.approx((0.9 - 1) * math.log(0.9) + (0.1 - 1e-4) * math.log(0.1 / 1e-4))


def test_best_iou_against_all_pairs(spark):
    rng = random.Random(9)
    iv = lambda n: [("s" + str(rng.randrange(3)), rng.choice("AB"), a := rng.randrange(2_000_000), a + rng.randrange(1, 900_000)) for _ in range(n)]  # noqa: E731, F841
    truth, found = iv(60), iv(80)
    truth.append(truth[0])
    schema = "session_id STRING, type STRING, start_ms BIGINT, end_ms BIGINT"
    got = {(r[0], r[1], r[2], r[3]): (r["n"], r["iou"]) for r in X.best_iou(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)).collect()}
    for t in truth:
        best = 0.0
        for f in found:
            if f[:2] == t[:2]:
                inter = max(0, min(t[3], f[3]) - max(t[2], f[2]))
                best = max(best, inter / (max(t[3], f[3]) - min(t[2], f[2])))
        assert got[t][1] == pytest.approx(best)
    assert sum(n for n, _ in got.values()) == len(truth)


def test_interpolation_matches_numpy(spark):
    xs, ys = [0.0, 0.1, 0.1005, 0.4, 1.0], [0.0, 0.2, 0.5, 0.5, 0.9]
    vals = [i / 997 for i in range(998)] + [0.0, 1.0, 0.1]
    df = spark.createDataFrame([(v,) for v in vals], "p DOUBLE")
    got = {r["p"]: r["q"] for r in X.interpolate(df, "p", xs, {"q": ys}).collect()}
    for v in vals:
        assert got[v] == pytest.approx(float(np.interp(v, xs, ys)), abs=1e-12)


def test_spearman_with_ties(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), rng.randrange(6), 1.0) for _ in range(200)]
    got = {r["feature"]: r["rho"] for r in M.spearman(spark.createDataFrame(rows, "y INT, a INT, c DOUBLE"), ["a", "c"]).collect()}
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["y", "a", "c"])
    assert got["a"] == pytest.approx(pdf["a"].rank().corr(pdf["y"].rank())) and got["c"] is None


def test_running_sum_starts_at_zero_before_the_first_value(spark, tiny_tasks):
    df = spark.createDataFrame([(None, i, v) for i, v in enumerate([None, None, 5, None, 2])], "k STRING, i INT, v INT")
    out = Ordered(df, ["k"], [F.col("i")])
    assert [r["s"] for r in out.running(sums={"s": F.col("v")}).orderBy("i").collect()] == [0, 0, 5, 5, 7]
    assert [r["m"] for r in out.running(maxes={"m": F.col("v")}).orderBy("i").collect()] == [None, None, 5, 5, 5]
    assert [r["a"] for r in out.neighbours(prev={"a": F.col("v")}).orderBy("i").collect()] == [None, None, None, 5, None]


def test_bootstrap_knows_which_side_of_the_threshold_a_row_is(spark):
    # half of the clean rows are above the threshold
    rows = [(0, 0.50020), (0, 0.50080)] * 400 + [(1, 0.5009)] * 50
    out = {r["metric"]: r for r in Z.ranking_intervals(spark.createDataFrame(rows, "y INT, p DOUBLE"), 0.5005, replicates=200).collect()}
    assert 0.42 < out["fpr"]["low"] < 0.5 < out["fpr"]["high"] < 0.58 and out["recall"]["low"] == out["recall"]["high"] == 1.0


def test_equal_drift_goes_to_the_first_monitored_feature(spark):
    rows = [(1, i % 2, 0.1 + 0.8 * (i % 10) / 10, float(i % 7), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "batch INT, y INT, p DOUBLE, load DOUBLE, lighting STRING")
    for order in (["p", "load"], ["load", "p"]):
        got = D.drift_report(df.drop("batch"), df, order, 0.5, "lighting", 0.5).first()
        assert got["max_psi_feature"] == order[0] and got["psi_by_feature"].keys() == {"p", "load"} and list(got["slice_fpr"]) == ["x"]


def test_exact_ks_equals_enumeration():
    for n, m in ((1, 1), (3, 2), (4, 4), (5, 3), (2, 6)):
        stats = []
        for mine in itertools.combinations(range(n + m), n):
            i = j = 0
            most = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in mine else (i, j + 1)
                most = max(most, abs(i * m - j * n))
            stats.append(most)
        for d in sorted(set(stats)):
            want = sum(s >= d for s in stats) / len(stats)
            assert M.exact_ks_p(d / (n * m), n, m) == pytest.approx(want)
    assert M.exact_ks_p(0.05, 4000, 3000) == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 0.0025 * 12e6 / 7000) for k in range(1, 50)), rel=0.1)


def test_ks_report_orders_and_counts(spark):
    rng = random.Random(3)
    names = [f"f{i:02d}" for i in range(20)]
    side = lambda shift: spark.createDataFrame([tuple(rng.gauss(i * shift, 1) for i in range(20)) for _ in range(40)], ", ".join(f"{n} DOUBLE" for n in names))
    tested = M.ks_test(side(0.0), side(0.2), names)
    top, below = M.ks_report(tested)
    got, every = top.collect(), tested.collect()
    assert [r["feature"] for r in got] == [r["feature"] for r in sorted(every, key=lambda r: (-r["ks"], r["feature"]))[:15]]
    assert below.first()["differing"] == sum(r["p_value"] < 0.01 for r in every) > 10
    assert all(r["p_value"] == pytest.approx(M.exact_ks_p(r["ks"], 40, 40)) for r in every)
