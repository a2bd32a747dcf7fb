"""Monotone gradient-boosted trees on binned features, several variants of a model in one pass over the rows.

Values become bin codes once, one byte each, in a written table.  A level of a tree is one pass: every task adds up
gradients, second derivatives and rows per (variant, node, feature, bin), Spark brings the sums of a (variant, node,
feature) together, and the best split of each node, one row, returns to the driver.  What moves and what a task holds
depends on variants, nodes, features and bins, not on rows.

Splits obey the sign of a feature: where it may only raise the score, the left child's value must not exceed the right's,
and all below the left stays at or under their mean, all below the right at or over it.  So no set of other values can make
more evidence lower the score, in a tree or in their sum.  Scores are column expressions; contributions are exact Shapley
values of each leaf's path, summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewrank.functions.reshape import long_format
from reviewrank.operators import metrics as M
from reviewrank.session import Scratch

BINS = 64  # codes of a feature; at most 256
BLOCK = 10  # trees after which margins are written anew
CHECK = 5  # trees between two looks at the validation rows
PATIENCE = 15  # trees without a better one before a variant stops


@dataclass
class Tree:
    """Nodes in heap order: node ``i`` has the children ``2i + 1`` and ``2i + 2``; a feature of -1 marks a leaf."""

    feature: list[int]
    cut: list[float]  # values up to it go left
    code: list[int]  # the same among bins
    value: list[float]  # of a leaf, in log-odds
    cover: list[float]  # weight of the training rows that reach the node

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0.0] * n, [0] * n, [0.0] * n, [0.0] * n)


@dataclass
class Variant:
    """One way to fit: which features and row weights to use, and how strongly."""

    name: str
    features: list[str]
    weight: str | None = None
    rate: float = 0.1
    depth: int = 3
    least_rows: int = 25
    l2: float = 2.0
    share: float = 0.7  # of the features, drawn anew for each tree


@dataclass
class Ensemble:
    features: list[str]
    base: float
    trees: list[Tree] = field(default_factory=list)
    average_precision: float | None = None

    def to_dict(self) -> dict:
        return asdict(self)


# ---- bins ----
def bin_edges(train: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Upper ends of all bins but the last: approximate quantiles of all values and of those above zero.

    Many features are mostly zero; the second half keeps their rest apart.
    """
    half = max(1, bins // 2)
    probs = F.array(*[F.lit(i / half) for i in range(half)])
    value = F.col("value").cast("double")
    some = F.percentile_approx(F.when(value > 0, value), probs, 1000)
    aggs = [F.percentile_approx(value, probs, 1000).alias("all"), some.alias("some"), F.max(value).alias("top")]
    row = {r["feature"]: r for r in long_format(train, [], features).groupBy("feature").agg(*aggs).collect()}  # two short lists a feature
    out = {}
    for f in features:
        points = {float(v) for part in (row[f]["all"], row[f]["some"]) for v in part or []} if f in row else set()
        out[f] = sorted(v for v in points if v < row[f]["top"])[: bins - 1]
    return out


def coded(frame: DataFrame, features: list[str], edges: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """``keep`` and ``codes``: a byte per feature, the number of edges below its value."""
    cuts = [np.array(edges[f]) for f in features]
    schema = ", ".join(f"`{n}` {t}" for n, t in frame.select(*keep).dtypes) + ", codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.empty((b.num_rows, len(features)), np.uint8)
            for j, c in enumerate(cuts):
                m[:, j] = np.searchsorted(c, b.column(len(keep) + j).to_numpy(zero_copy_only=False))
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * len(features)
            codes = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(m.tobytes())])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], codes], names=[*keep, "codes"])

    return frame.select(*keep, *[F.col(f).cast("double") for f in features]).mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Codes of a batch, a row each."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8) if len(column) else np.empty(0, np.uint8)
    return flat.reshape(len(column), width)


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _node(codes: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """The node each row has reached after ``levels`` steps, or the leaf before."""
    at = np.zeros(len(codes), np.int64)
    feature, code = np.array(tree.feature), np.array(tree.code)
    rows = np.arange(len(codes))
    for _ in range(levels):
        f = feature[at]
        right = codes[rows, np.maximum(f, 0)] > code[at]
        at = np.where(f < 0, at, 2 * at + 1 + right)
    return at


def _depth(tree: Tree) -> int:
    return (len(tree.feature) + 1).bit_length() - 2


def _margins(codes: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(len(codes))
    for t in trees:
        out += np.array(t.value)[_node(codes, t, _depth(t))]
    return out


# ---- growing ----
_SUMS = "variant int, node int, feature int, sums binary"
_BEST = "variant int, node int, gain double, feature int, code int, g double, h double, n double, gl double, hl double, nl double"


def _histograms(rows: DataFrame, width: int, bins: list[int], open_: dict[int, dict], pending: dict[int, list[Tree]]) -> DataFrame:
    """Sums of gradients, second derivatives and rows per bin, one row per task, variant, open node and feature.

    ``open_``: variant -> its growing tree, level, nodes to split and features to try.  ``pending``: trees not yet in the margins.
    """
    most = max(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            codes, y = _matrix(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            margins, weights = (_lists(b.column(i), k) for i, k in ((2, n_variants), (3, n_variants)))
            for v, grow in open_.items():
                nodes, tried = np.array(grow["nodes"]), np.array(grow["features"])
                slot = np.full(len(grow["tree"].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                mine = slot[_node(codes, grow["tree"], grow["level"])]
                inside = np.flatnonzero((mine >= 0) & (weights[:, v] > 0))
                if not len(inside):
                    continue
                some = codes[inside]
                p = 1 / (1 + np.exp(-(margins[inside, v] + _margins(some, pending[v]))))
                w = weights[inside, v]
                g, h = w * (p - y[inside]), w * p * (1 - p)
                at = (mine[inside, None] * len(tried) + np.arange(len(tried))) * most + some[:, tried]
                size = len(nodes) * len(tried) * most
                flat, each = at.ravel(), len(tried)
                sums = np.stack([np.bincount(flat, np.repeat(x, each), size) for x in (g, h)] + [np.bincount(flat, minlength=size).astype(float)])
                held[v] = held[v] + sums if v in held else sums
        for v, sums in held.items():
            nodes, tried = open_[v]["nodes"], open_[v]["features"]
            shaped = sums.reshape(3, len(nodes), len(tried), most)
            cells = [(i, j) for i in range(len(nodes)) if shaped[2, i, 0].any() for j in range(len(tried))]
            yield pa.RecordBatch.from_pydict({
                "variant": pa.array([v] * len(cells), pa.int32()), "node": pa.array([nodes[i] for i, _ in cells], pa.int32()), "feature": pa.array([tried[j] for _, j in cells], pa.int32()),
                "sums": pa.array([np.ascontiguousarray(shaped[:, i, j, : bins[tried[j]]]).tobytes() for i, j in cells], pa.binary()),
            })

    n_variants = len(pending)
    return rows.select("codes", "y", "margins", "weights").mapInArrow(run, _SUMS)


def _split(sums: np.ndarray, sign: int, low: float, high: float, v: Variant) -> tuple | None:
    """The best cut of one node along one feature: ``(gain, code, g, h, n, gl, hl, nl)``."""
    g, h, n = sums.sum(axis=1)
    gl, hl, nl = np.cumsum(sums, axis=1)[:, :-1]
    worth = lambda g, h, w: -(g * w + 0.5 * (h + v.l2) * w * w)
    value = lambda g, h: np.clip(-g / (h + v.l2), low, high)
    left, right = value(gl, hl), value(g - gl, h - hl)
    gain = worth(gl, hl, left) + worth(g - gl, h - hl, right) - worth(g, h, value(g, h))
    allowed = (nl >= v.least_rows) & (n - nl >= v.least_rows) & (sign * (right - left) >= 0)
    gain = np.where(allowed, np.round(gain, 9), -np.inf)
    if not len(gain) or not gain.max() > 1e-9:
        return None
    at = int(np.argmax(gain))
    return float(gain[at]), at, float(g), float(h), float(n), float(gl[at]), float(hl[at]), float(nl[at])


def best_splits(partial: DataFrame, bounds: dict[tuple[int, int], tuple[float, float]], signs: list[int], variants: list[Variant]) -> list:
    """The best split of every (variant, node), as rows; nodes without one are missing.

    Every task that brings sums together returns its best of each node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for key, data in zip(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), b.column(3).to_pylist(), strict=True):
                sums = np.frombuffer(data).reshape(3, -1)
                held[key] = held[key] + sums if key in held else sums
        best: dict[tuple[int, int], tuple] = {}
        for (v, node, f), sums in sorted(held.items()):
            found = _split(sums, signs[f], *bounds[v, node], variants[v])
            if found is not None and ((v, node) not in best or found[0] > best[v, node][2]):
                best[v, node] = (v, node, found[0], f, *found[1:])
        if best:
            names = [c.split()[0] for c in _BEST.split(", ")]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(list(best.values()), columns=names).astype({c: "int32" for c in ("variant", "node", "feature", "code")}), preserve_index=False)

    best = {}
    for r in partial.repartition("variant", "node", "feature").mapInArrow(run, _BEST).collect():
        key = (r["variant"], r["node"])
        if key not in best or (r["gain"], -r["feature"]) > (best[key]["gain"], -best[key]["feature"]):
            best[key] = r
    return [best[k] for k in sorted(best)]


def _tried(v: Variant, index: dict[str, int], edges: dict[str, list[float]], number: int) -> list[int]:
    """The features a tree may use: a share of the variant's, drawn by its number."""
    own = [index[f] for f in v.features if edges[f]]
    if v.share >= 1 or not own:
        return own
    rng = np.random.default_rng([7, number])  # equal for all variants, so that they differ by their features only
    drawn = set(np.flatnonzero(rng.random(len(index)) < v.share).tolist())
    return [f for f in own if f in drawn] or own


def fit(frame: DataFrame, features: list[str], directions: dict[str, int], variants: list[Variant], most_trees: int = 200, bins: int = BINS,
        patience: int = PATIENCE) -> list[Ensemble]:
    """Ensembles for all ``variants``, grown together on ``frame(y, split, features...)`` without missing values.

    Trained on the rows of split ``train``, positives weighted up to the number of others; each variant keeps the number of
    trees with the best average precision on split ``validation``.
    """
    scratch = Scratch(frame.sparkSession)
    index = {f: i for i, f in enumerate(features)}
    signs = [directions.get(f, 0) for f in features]
    train = F.col("split") == "train"
    weights = [F.coalesce(F.col(v.weight).cast("double"), F.lit(0.0)) if v.weight else F.lit(1.0) for v in variants]
    totals = frame.where(train).agg(*[F.sum(F.when(F.col("y") == y, w)).alias(f"{i}_{y}") for i, w in enumerate(weights) for y in (0, 1)]).first()
    classes = [(float(totals[f"{i}_0"] or 0.0), float(totals[f"{i}_1"] or 0.0)) for i in range(len(variants))]
    balance = [n / p if p else 1.0 for n, p in classes]
    edges = bin_edges(frame.where(train), features, bins)
    n_bins = [len(edges[f]) + 1 for f in features]
    out = [Ensemble(v.features, 0.0 if p else math.log(0.5 / max(1.0, n))) for v, (n, p) in zip(variants, classes)]
    weighed = F.array(*[F.when(train, w * F.when(F.col("y") == 1, b).otherwise(1.0)).otherwise(0.0) for w, b in zip(weights, balance)])
    rows = frame.where(F.col("split").isin("train", "validation")).withColumns({
        "y": F.col("y").cast("int"), "weights": weighed, "margins": F.array(*[F.lit(float(e.base)) for e in out]), "validates": ~train})
    rows = scratch.cut(coded(rows, features, edges, ["y", "weights", "margins", "validates"]))
    best = [(-1.0, 0)] * len(variants)  # average precision and number of trees
    going = [v for v, (n, p) in enumerate(classes) if n and p]
    pending: dict[int, list[Tree]] = {v: [] for v in range(len(variants))}
    number = 0
    while going and number < most_trees:
        grown = _grow(rows, features, edges, n_bins, signs, variants, going, pending, index, number)
        for v, tree in grown.items():
            out[v].trees.append(tree)
            pending[v].append(tree)
        number += 1
        if number % BLOCK == 0 or number == most_trees:
            for v, trees, ap in _validated(rows, len(features), going, pending, number):
                if ap > best[v][0] + 1e-9:
                    best[v] = (ap, trees)
            going = [v for v in going if number - best[v][1] < patience and out[v].trees[-1].feature[0] >= 0]
            rows = scratch.cut(_advanced(rows, len(features), pending), rows)
            pending = {v: [] for v in pending}
    scratch.drop(rows)
    for v, e in enumerate(out):
        e.trees, e.average_precision = e.trees[: best[v][1]], best[v][0] if best[v][0] >= 0 else None
    return out


def _grow(rows, features, edges, n_bins, signs, variants, going, pending, index, number) -> dict[int, Tree]:
    """One tree more for each variant of ``going``."""
    trees = {v: Tree.empty(variants[v].depth) for v in going}
    bounds = {(v, 0): (-math.inf, math.inf) for v in going}
    tried = {v: _tried(variants[v], index, edges, number) for v in going}
    frontier = {v: [0] for v in going if tried[v]}
    for level in range(max((variants[v].depth for v in going), default=0)):
        open_ = {v: {"tree": trees[v], "level": level, "nodes": frontier[v], "features": tried[v]} for v in frontier if frontier[v] and level < variants[v].depth}
        if not open_:
            break
        found = best_splits(_histograms(rows, len(features), n_bins, open_, pending), bounds, signs, variants)
        frontier = {v: [] for v in frontier}
        for s in found:
            v, node, rate, l2 = s["variant"], s["node"], variants[s["variant"]].rate, variants[s["variant"]].l2
            low, high = bounds[v, node]
            value = lambda g, h, low=low, high=high, l2=l2: min(max(-g / (h + l2), low), high)
            left, right = value(s["gl"], s["hl"]), value(s["g"] - s["gl"], s["h"] - s["hl"])
            tree, f, middle = trees[v], s["feature"], (left + right) / 2
            tree.feature[node], tree.code[node], tree.cut[node] = f, s["code"], edges[features[f]][s["code"]]
            tree.cover[node] = s["n"]
            for child, w, n in ((2 * node + 1, left, s["nl"]), (2 * node + 2, right, s["n"] - s["nl"])):
                tree.value[child], tree.cover[child] = rate * w, n
            sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}
            bounds[v, 2 * node + 1], bounds[v, 2 * node + 2] = sides[signs[f]]
            frontier[v] += [2 * node + 1, 2 * node + 2]
    return trees


def _validated(rows: DataFrame, width: int, going: list[int], pending: dict[int, list[Tree]], number: int) -> list[tuple[int, int, float]]:
    """``(variant, number of trees, average precision)`` on the validation rows, every :data:`CHECK` trees of the last block."""
    n_variants = len(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, margins = _matrix(b.column(0), width), _lists(b.column(2), n_variants)
            for v in going:
                last = len(pending[v])
                for k in sorted({*range(CHECK, last + 1, CHECK), last}):
                    p = margins[:, v] + _margins(codes, pending[v][:k])
                    n = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, number - last + k, np.int32)), b.column(1), pa.array(p)], names=["variant", "trees", "y", "p"])

    long = rows.where("validates").select("codes", "y", "margins").mapInArrow(run, "variant int, trees int, y int, p double")
    found = M.ranking(long, ["variant", "trees"]).select("variant", "trees", "pr_auc").collect()
    return sorted((r["variant"], r["trees"], r["pr_auc"] or 0.0) for r in found)


def _advanced(rows: DataFrame, width: int, pending: dict[int, list[Tree]]) -> DataFrame:
    """``rows`` with the pending trees in their margins."""
    n_variants, names = len(pending), rows.columns
    at = names.index("margins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _matrix(b.column(names.index("codes")), width)
            margins = _lists(b.column(at), n_variants).copy()
            for v, trees in pending.items():
                margins[:, v] += _margins(codes, trees)
            offsets = np.arange(len(margins) + 1, dtype=np.int32) * n_variants
            columns = list(b.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


# ---- using ----
def scored(frame: DataFrame, features: list[str], ensembles: list[Ensemble], names: list[str], keep: list[str]) -> DataFrame:
    """``variant, keep..., p``: the scores of every row by every ensemble, from values."""
    types = ", ".join(f"`{n}` {t}" for n, t in frame.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(len(keep) + j).to_numpy(zero_copy_only=False) for j in range(len(features))])
            for name, e in zip(names, ensembles, strict=True):
                p = 1 / (1 + np.exp(-(e.base + sum((_reached(x, t) for t in e.trees), np.zeros(len(x))))))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), *[b.column(i) for i in range(len(keep))], pa.array(p)], names=["variant", *keep, "p"])

    return frame.select(*keep, *[F.col(f).cast("double") for f in features]).mapInArrow(run, f"variant string, {types}, p double")


def _reached(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The tree's value of every row of ``x``."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    feature, cut = np.array(tree.feature), np.array(tree.cut)
    for _ in range(_depth(tree)):
        f = feature[at]
        at = np.where(f < 0, at, 2 * at + 1 + ~(x[rows, np.maximum(f, 0)] <= cut[at]))
    return np.array(tree.value)[at]


def margins_column(trees: list[Tree], features: list[str], base: float, fixes: list[dict[str, float]]) -> Column:
    """An array column with the log-odds of a row for each of ``fixes``: values that stand in for the row's own.

    One vectorised pass; a tree is evaluated anew only for fixes of its own features.  As an expression, the sum of some hundred
    trees is more code than the JVM compiles.
    """
    used = used_features(trees, features)
    place = {features.index(f): i for i, f in enumerate(used)}
    own = [Tree([place[f] if f >= 0 else -1 for f in t.feature], t.cut, t.code, t.value, t.cover) for t in trees]
    uses = [{f for f in t.feature if f >= 0} for t in own]
    moved = [{used.index(f): v for f, v in fix.items() if f in used} for fix in fixes]

    def total(terms: list[np.ndarray]) -> np.ndarray:
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0]

    @pandas_udf("array<double>")
    def sums(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        x = np.stack(values.to_numpy())
        plain = [_reached(x, t) for t in own]
        out = np.empty((len(x), len(moved)))
        for k, fix in enumerate(moved):
            z = x
            if fix:
                z = x.copy()
                for i, v in fix.items():
                    z[:, i] = v
            out[:, k] = total([np.full(len(x), base), *[_reached(z, t) if uses[i] & fix.keys() else plain[i] for i, t in enumerate(own)]])
        return pd.Series(list(out))

    return sums(F.array(*[F.col(f).cast("double") for f in used]).cast("array<double>"))


def tree_column(tree: Tree, features: list[str], fixed: dict[str, float] | None = None, node: int = 0) -> Column | float:
    """A tree's value of a row, with some features fixed; a number where nothing of the row matters."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = (tree_column(tree, features, fixed, 2 * node + k) for k in (1, 2))
    if fixed and features[f] in fixed:
        return left if fixed[features[f]] <= tree.cut[node] else right
    if not isinstance(left, Column) and not isinstance(right, Column) and left == right:
        return left
    as_column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return F.when(F.col(features[f]) <= tree.cut[node], as_column(left)).otherwise(as_column(right))


def used_features(trees: list[Tree], features: list[str]) -> list[str]:
    used = {f for t in trees for f in t.feature if f >= 0}
    return [n for i, n in enumerate(features) if i in used]


@dataclass
class _Leaf:
    """A leaf with, for each feature on its path, the values that lead on and the share of training rows that do."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaves(tree: Tree) -> list[_Leaf]:
    out = []

    def walk(node: int, held: dict[int, tuple[float, float, float]]):
        f = tree.feature[node]
        if f < 0:
            out.append(_Leaf(tree.value[node], list(held), *(list(x) for x in (zip(*held.values()) if held else ((), (), ())))))
            return
        for child, side in ((2 * node + 1, 0), (2 * node + 2, 1)):
            low, high, share = held.get(f, (-math.inf, math.inf, 1.0))
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            reach = (low, min(high, tree.cut[node])) if side == 0 else (max(low, tree.cut[node]), high)
            walk(child, held | {f: (*reach, share * part)})

    walk(0, {})
    return out


def expected(trees: list[Tree], base: float) -> float:
    """The mean log-odds of the training rows, what contributions start from."""
    return base + sum(leaf.value * math.prod(leaf.share) for t in trees for leaf in leaves(t))


def shapley(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Contributions of every column of ``x`` to the sum of the trees, one row each.

    For a leaf, a feature in the set of known ones passes the leaf's value on if it leads there, any other by its share.  Over
    all orders of the features of the path the sets of each size are summed with one polynomial, so no set is enumerated.
    """
    out = np.zeros(x.shape)
    for tree in trees:
        for leaf in leaves(tree):
            n = len(leaf.features)
            on = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
            for i, f in enumerate(leaf.features):
                sizes = [np.ones(len(x))]  # coefficient s: the sum over sets of s other features
                for j in range(n):
                    if j != i:
                        sizes = [
                            (sizes[s] * leaf.share[j] if s < len(sizes) else 0.0) + (sizes[s - 1] * on[j] if s else 0.0) for s in range(len(sizes) + 1)
                        ]
                weighed = sum(c * (math.factorial(s) * math.factorial(n - 1 - s) / math.factorial(n)) for s, c in enumerate(sizes))
                out[:, f] += leaf.value * (on[i] - leaf.share[i]) * weighed
    return out


def contributions_column(trees: list[Tree], features: list[str]) -> tuple[Column, list[str]]:
    """An array column with the contributions of the features used, and their names."""
    used = used_features(trees, features)
    place = {features.index(f): i for i, f in enumerate(used)}
    own = [Tree([place[f] if f >= 0 else -1 for f in t.feature], t.cut, t.code, t.value, t.cover) for t in trees]

    @pandas_udf("array<double>")
    def parts(values: pd.Series) -> pd.Series:
        return pd.Series(list(shapley(np.stack(values.to_numpy()), own)) if len(values) else [])

    return parts(F.array(*[F.col(f).cast("double") for f in used])), used
