import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewrank.operators import boosting as B

NAMES = ["a", "b", "c", "d"]
SIGNS = {"a": 1, "b": -1, "c": 0, "d": 1}


def table(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c, d = rng.choice([0.0, rng.random()]), rng.random(), rng.gauss(0, 1), float(rng.randrange(3))
        y = int(2 * a - b + abs(c) + 0.3 * d + rng.gauss(0, 0.4) > 1.4)
        rows.append((y, ("train", "train", "validation", "holdout")[i % 4], 1.0 + i % 2, a, b, c, d))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "y INT, split STRING, half DOUBLE, " + ", ".join(f"{n} DOUBLE" for n in NAMES)).repartition(parts)


def plain_tree(x, y, w, margin, edges, v, signs):
    """One tree grown by looking at all rows for every cut."""
    tree = B.Tree.empty(v.depth)
    p = 1 / (1 + np.exp(-margin))
    g, h = w * (p - y), w * p * (1 - p)
    todo = [(0, np.ones(len(y), bool), -math.inf, math.inf, 0)]
    while todo:
        node, inside, low, high, level = todo.pop()
        if level == v.depth:
            continue
        value = lambda m: min(max(-g[m].sum() / (h[m].sum() + v.l2), low), high)  # noqa: B023, E731
        worth = lambda m: -(g[m].sum() * value(m) + 0.5 * (h[m].sum() + v.l2) * value(m) ** 2)  # noqa: B023, E731
        best = None
        for j, name in enumerate(NAMES):
            for k, cut in enumerate(edges[name]):
                left, right = inside & (x[:, j] <= cut), inside & (x[:, j] > cut)
                if left.sum() < v.least_rows or right.sum() < v.least_rows or signs[name] * (value(right) - value(left)) < 0:
                    continue
                gain = round(worth(left) + worth(right) - worth(inside), 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, j, k, cut, left, right)
        if best is None:
            continue
        _, j, k, cut, left, right = best
        tree.feature[node], tree.code[node], tree.cut[node], tree.cover[node] = j, k, cut, float(inside.sum())
        wl, wr = value(left), value(right)
        middle = (wl + wr) / 2
        sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[NAMES[j]]]
        for child, m, bound in ((2 * node + 1, left, sides[0]), (2 * node + 2, right, sides[1])):
            tree.value[child], tree.cover[child] = v.rate * value(m), float(m.sum())
            todo.append((child, m, *bound, level + 1))
    return tree


def spread(tree, x):
    return np.array([tree.value[node_of(tree, r)] for r in x])


def node_of(tree, row):
    at = 0
    while tree.feature[at] >= 0:
        at = 2 * at + 1 + (row[tree.feature[at]] > tree.cut[at])
    return at


def test_trees_equal_those_of_a_plain_search(spark, tiny_tasks):
    rows = table()
    variants = [B.Variant("all", NAMES, share=1.0, least_rows=10), B.Variant("weighed", NAMES, "half", rate=0.3, depth=2, share=1.0, least_rows=5), B.Variant("few", ["a", "c"], share=1.0)]
    got = B.fit(frame(spark, rows), NAMES, SIGNS, variants, most_trees=4)
    train = [r for r in rows if r[1] == "train"]
    x, y = np.array([r[3:] for r in train]), np.array([r[0] for r in train], float)
    edges = B.bin_edges(frame(spark, train), NAMES)
    assert all(len(e) == len(set(e)) <= B.BINS - 1 for e in edges.values()) and edges["d"] == [0.0, 1.0]
    for v, e in zip(variants, got):
        w = np.array([r[2] for r in train]) if v.weight else np.ones(len(y))
        w = w * np.where(y == 1, w[y == 0].sum() / w[y == 1].sum(), 1.0)
        own = {n: edges[n] if n in v.features else [] for n in NAMES}
        margin = np.zeros(len(y))
        assert e.trees and e.base == 0.0
        for tree in e.trees:
            want = plain_tree(x, y, w, margin, own, v, SIGNS)
            assert (tree.feature, tree.code, tree.cover) == (want.feature, want.code, want.cover)
            assert tree.value == pytest.approx(want.value, abs=1e-9) and tree.cut == want.cut
            margin += spread(tree, x)


def test_more_evidence_never_lowers_the_score(spark):
    rows = table(2, 800)
    model = B.fit(frame(spark, rows), NAMES, SIGNS, [B.Variant("m", NAMES, least_rows=5, rate=0.3, depth=4)], most_trees=20)[0]
    assert len(model.trees) >= 5 and model.average_precision > 0.7
    x = np.array([r[3:] for r in rows])
    at = lambda z: sum(spread(t, z) for t in model.trees)
    for j, name in enumerate(NAMES):
        for value in (0.0, 0.3, 0.9, 5.0):
            z = x.copy()
            z[:, j] = value
            change = SIGNS[name] * (at(z) - at(x)) * np.sign(value - x[:, j])
            assert (change >= -1e-12).all()
    column = sum(B.tree_column(t, NAMES) for t in model.trees)
    scored = frame(spark, rows).withColumn("m", column).select(*NAMES, "m").collect()
    assert np.allclose(at(np.array([r[:4] for r in scored])), [r["m"] for r in scored])
    fixed = frame(spark, rows).withColumn("m", sum((B.tree_column(t, NAMES, {"a": 0.0, "c": 1.0}) for t in model.trees), F.lit(0.0))).select(*NAMES, "m").collect()
    z = np.array([(0.0, r["b"], 1.0, r["d"]) for r in fixed])
    assert np.allclose(at(z), [r["m"] for r in fixed])


def test_contributions_equal_those_over_all_orders(spark):
    rows = table(3)
    model = B.fit(frame(spark, rows), NAMES, SIGNS, [B.Variant("m", NAMES, least_rows=10, rate=0.5)], most_trees=5)[0]
    x = np.array([r[3:] for r in rows[:40]])

    def known(tree, row, held, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in held:
            return known(tree, row, held, right if row[f] > tree.cut[node] else left)
        return sum(tree.cover[c] / tree.cover[node] * known(tree, row, held, c) for c in (left, right))

    got = B.shapley(x, model.trees)
    for row, parts in zip(x, got):
        for f in range(4):
            others = [i for i in range(4) if i != f]
            want = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += share * sum(known(t, row, {*s, f}) - known(t, row, {*s}) for t in model.trees)
            assert parts[f] == pytest.approx(want, abs=1e-9)
        total = model.base + sum(spread(t, row[None, :])[0] for t in model.trees)
        assert parts.sum() == pytest.approx(total - B.expected(model.trees, model.base), abs=1e-9)
    column, used = B.contributions_column(model.trees, NAMES)
    asked = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} DOUBLE" for n in NAMES))
    for r in asked.withColumn("parts", column).collect():
        mine = B.shapley(np.array([r[:4]]), model.trees)[0]
        assert r["parts"] == pytest.approx([mine[NAMES.index(u)] for u in used], abs=1e-9)


def test_one_class_and_constant_features_give_a_flat_model(spark):
    rows = [(0, "train", 1.0, 0.0, 0.5, 1.0, 2.0)] * 60 + [(0, "validation", 1.0, 0.0, 0.5, 1.0, 2.0)] * 5
    model = B.fit(frame(spark, rows), NAMES, SIGNS, [B.Variant("m", NAMES)], most_trees=3)[0]
    assert model.trees == [] and model.base < 0
    mixed = [(i % 2, *r[1:]) for i, r in enumerate(rows)]
    assert B.fit(frame(spark, mixed), NAMES, SIGNS, [B.Variant("m", NAMES)], most_trees=3)[0].base == 0.0
