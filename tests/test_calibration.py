import random

import numpy as np
import pytest

from reviewrank.operators import calibration as C
from reviewrank.operators import resampling as Z


def plain_isotonic(p, y):
    """Values at the sorted distinct scores: min over right ends of max over left ends of mean labels."""
    xs = np.unique(p)
    pos, n = np.array([y[p == x].sum() for x in xs], float), np.array([(p == x).sum() for x in xs], float)
    cp, cn = np.concatenate(([0], np.cumsum(pos))), np.concatenate(([0], np.cumsum(n)))
    mean = lambda i, j: (cp[j] - cp[i]) / (cn[j] - cn[i])
    return xs, np.array([max(min(mean(i, j) for j in range(k + 1, len(xs) + 1)) for i in range(k + 1)) for k in range(len(xs))])


def scored(seed, n=150, digits=3):
    rng = np.random.default_rng(seed)
    p = np.round(rng.beta(0.4, 4, n), digits)
    return p, (rng.random(n) < p ** 0.7).astype(int)


def frame(spark, sets):
    rows = [(k, int(y), float(p)) for k, (ps, ys) in sets.items() for p, y in zip(ps, ys)]
    return spark.createDataFrame(rows, "k STRING, y INT, p DOUBLE")


@pytest.mark.parametrize("fan", [2, 16])
def test_isotonic_fit_in_ranges_equals_a_plain_one(spark, tiny_tasks, fan):
    sets = {"a": scored(1), "b": scored(2, digits=1), "c": (np.array([0.5]), np.array([1])), "d": (np.linspace(0, 1, 40), np.arange(40) % 2), "e": (np.linspace(0, 1, 40), (np.arange(40) > 20).astype(int))}
    blocks = C.isotonic_blocks(C.counts_of(frame(spark, sets), ["k"]), ["k"], fan=fan)
    knots = np.linspace(0, 1, 101).tolist()
    got = {}
    for r in C.isotonic_values(blocks, ["k"], knots).collect():
        got[r["k"], r["knot"]] = r["value"]
    held = {}
    for r in blocks.collect():
        held.setdefault(r["k"], []).append((r["lo"], r["hi"], r["pos"] / r["n"]))
    for k, (p, y) in sets.items():
        xs, want = plain_isotonic(p, y)
        assert [got[k, i] for i in range(101)] == pytest.approx(np.interp(knots, xs, want).tolist())
        shares = [s for _, _, s in sorted(held[k])]
        assert shares == sorted(set(shares))


def test_logistic_maps_equal_a_fit_on_all_rows(spark, tiny_tasks):
    p, y = scored(3, 400, 4)
    maps = C.logistic_maps(C.counts_of(frame(spark, {"a": (p, y)}).drop("k")), 5)
    x, a, b = C.log_odds(p), 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-(a * x + b)))
        w = q * (1 - q)
        step = np.linalg.solve([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]], [((y - q) * x).sum(), (y - q).sum()])
        a, b = a + step[0], b + step[1]
    assert maps[C.REAL] == pytest.approx((a, b), abs=1e-4) and set(maps) == {C.REAL, 0, 1, 2, 3, 4}
    assert len({round(m[0], 6) for m in maps.values()}) == 6


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_band_holds_the_map(spark, tiny_tasks, method):
    p, y = scored(4, 600, 2)
    counts = C.counts_of(frame(spark, {"a": (p, y)}).drop("k"))
    knots = np.linspace(0.02, 0.6, 12).tolist()
    lo, hi = C.band(counts, method, knots, 60, 1)
    assert len(lo) == len(hi) == 12 and all(a <= b for a, b in zip(lo, hi))
    if method == "platt":
        a, b = C.logistic_maps(counts, 0)[C.REAL]
        own = 1 / (1 + np.exp(-(a * C.log_odds(np.array(knots)) + b)))
    else:
        own = np.interp(knots, *plain_isotonic(p, y))
    assert np.mean([low - 1e-9 <= v <= high + 1e-9 for low, v, high in zip(lo, own, hi)]) > 0.7


def test_poisson_draws_have_their_mean_and_spread():
    counts = np.array([0, 1, 3, 40, 51, 4000])
    drawn = Z.poisson(counts, np.arange(6, dtype=np.uint64), np.arange(20_000), 1)
    assert drawn[0].max() == 0
    for c, row in zip(counts[1:], drawn[1:]):
        assert abs(row.mean() - c) < 5 * np.sqrt(c / 20_000) and abs(row.var() / c - 1) < 0.06
    again = Z.poisson(counts[3:], np.arange(3, 6, dtype=np.uint64), np.arange(10, 20), 1)
    assert np.array_equal(again, drawn[3:, 10:20])


def plain_ap(pos, neg):
    tp, fp = np.cumsum(pos), np.cumsum(neg)
    return (pos * tp / np.maximum(tp + fp, 1e-12)).sum() / pos.sum()


@pytest.mark.parametrize("stratified", [False, True])
def test_intervals_equal_those_of_the_same_draws_in_one_piece(spark, tiny_tasks, stratified):
    sets = {"a": scored(5, 300, 2), "b": scored(6, 80, 4)}
    data = frame(spark, sets)
    got = {(r["k"], r["metric"]): (r["low"], r["high"]) for r in Z.ranking_intervals(data, 0.1, ["k"], 100, 3, stratified=stratified).collect()}
    keys = {(r["k"], r["p"]): r["key"] for r in data.select("k", "p").distinct().selectExpr("k", "p", "xxhash64(3, k, p) AS key").collect()}
    for k, (p, y) in sets.items():
        xs = np.unique(p)[::-1]
        pos, neg = (np.array([(y[p == x] == c).sum() for x in xs]) for c in (1, 0))
        key = np.array([keys[k, x] for x in xs.tolist()])
        (_, a, b), = Z.drawn_classes(pos, neg, key, np.arange(100))
        scale = (pos.sum() / a.sum(0), neg.sum() / b.sum(0)) if stratified else (1.0, 1.0)
        ap = [plain_ap(*(c[:, r] * np.broadcast_to(s, 100)[r] for c, s in zip((a, b), scale))) for r in range(100)]
        hit = xs >= 0.1
        want = {"pr_auc": ap, "recall": a[hit].sum(0) / a.sum(0), "fpr": b[hit].sum(0) / b.sum(0)}
        for metric, values in want.items():
            assert got[k, metric] == pytest.approx(np.percentile(values, [2.5, 97.5]).tolist())


def test_slice_intervals_cover_the_truth(spark):
    rng = random.Random(7)
    rows = [(0, float(rng.random() < 0.2), f"l{i % 60}", "one") for i in range(60 * 200)] + [(1, 1.0, "l0", "one"), (1, 1.0, "only positive", "one")]
    data = spark.createDataFrame(rows, "y INT, p DOUBLE, f STRING, g STRING")
    got = Z.slice_fpr_intervals(data, ["f", "g"], 0.5).collect()
    inside = [r["low"] <= 0.2 <= r["high"] for r in got if r["factor"] == "f"]
    assert len(inside) == 60 and sum(inside) >= 52 and not any(r["level"] == "only positive" for r in got)
    one = [r for r in got if r["factor"] == "g"]
    assert len(one) == 1 and one[0]["high"] - one[0]["low"] < 0.02
    gap = {r["factor"]: r for r in Z.disparity_intervals(data, ["f", "g"], 0.5).collect()}
    assert set(gap) == {"f"} and 1.2 < gap["f"]["low"] < gap["f"]["high"] < 6
