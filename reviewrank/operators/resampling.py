"""Bootstrap intervals over distinct scores, with all replicates of a row in one array.

Resampling rows with replacement makes the number of copies of ``n`` equal rows nearly Poisson(``n``).  So rows are counted
per distinct score and class, and each count is redrawn per replicate.  A draw follows from the seed, the row and the
replicate alone: every pass, task and rerun sees the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewrank.operators import metrics as M
from reviewrank.session import cut_lineage

CELLS = 1 << 20  # draws held at a time
_POSITIVE, _NEGATIVE, _OTHER = 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, replicates: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1), a row per key and a column per replicate."""
    drawn = _mixed(_mixed(keys[:, None] + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) + replicates[None, :].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((drawn >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def poisson(counts: np.ndarray, keys: np.ndarray, replicates: np.ndarray, salt: int) -> np.ndarray:
    """A draw with mean ``counts[i]`` for every key and replicate; large means by a normal with its skew corrected."""
    out = np.zeros((len(counts), len(replicates)))
    small, large = np.flatnonzero((counts > 0) & (counts <= 50)), np.flatnonzero(counts > 50)
    if len(small):
        u, mean = _uniform(keys[small], replicates, salt), counts[small].astype(float)[:, None]
        term = np.exp(-mean)
        upto, k, found = term.copy(), 0, np.zeros_like(u)
        while (u > upto).any() and k < 400:
            found += u > upto
            k += 1
            term = term * mean / k
            upto = upto + term
        out[small] = found
    if len(large):
        a, b = (_uniform(keys[large], replicates, s) for s in (salt, salt + 16))
        z = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        mean = counts[large].astype(float)[:, None]
        out[large] = np.maximum(0, np.round(mean + np.sqrt(mean) * z + (z * z - 1) / 6))
    return out


def row_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def drawn_classes(pos: np.ndarray, neg: np.ndarray, keys: np.ndarray, replicates: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Redrawn counts of both classes, some rows at a time."""
    step = max(1, CELLS // max(1, len(replicates)))
    keys = keys.view(np.uint64)
    for start in range(0, len(pos), step):
        some = slice(start, start + step)
        yield some, poisson(pos[some], keys[some], replicates, _POSITIVE), poisson(neg[some], keys[some], replicates, _NEGATIVE)


def _intervals(values: DataFrame, keys: list[str], level: float) -> DataFrame:
    """``keys, low, high`` of ``value`` over the replicates, undefined ones left out."""
    ends = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    q = values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(F.percentile("value", ends).alias("q"))  # at most one value a replicate
    return q.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def ranking_intervals(scored: DataFrame, threshold: float, keys: list[str] | None = None, replicates: int = 1000, seed: int = 0, level: float = 0.95,
                      stratified: bool = False) -> DataFrame:
    """``keys, metric, low, high`` for average precision, recall and FPR of ``scored(keys, y, p)``.

    Every distinct score counts.  Scores are cut into ranges; a range needs only what the replicates add up to before it, so
    no task sees a whole group.  With ``stratified`` the classes keep their sizes in every replicate.
    """
    keys, which = keys or [], np.arange(replicates)
    names = [f"k{i}" for i in range(len(keys))]
    counts = M.score_counts(scored, keys).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "p", "pos", "neg")
    ranged = counts.repartitionByRange(*names, F.col("p").desc()).withColumn("chunk", F.spark_partition_id())
    counts = cut_lineage(ranged.withColumns({"key": row_key(seed, *names, "p"), "hit": F.col("p") >= threshold}))
    group = [*names, "chunk"]
    types = ", ".join(f"{n} {t}" for n, t in counts.select(*names).dtypes)
    head = f"{types}, " if names else ""

    def totals(table: pa.Table) -> pa.Table:
        pos, neg, key, hit = (table.column(c).to_numpy() for c in ("pos", "neg", "key", "hit"))
        sums = np.zeros((4, replicates))
        for some, p, n in drawn_classes(pos, neg, key, which):
            h = hit[some].astype(float)
            sums += np.stack([p.sum(0), n.sum(0), h @ p, h @ n])
        same = {n: pa.repeat(table.column(n)[0], replicates) for n in group}
        return pa.table({**same, "replicate": pa.array(which.astype(np.int32)), **{c: s for c, s in zip(("pos", "neg", "pos_hit", "neg_hit"), sums)}})

    sums = cut_lineage(counts.groupBy(*group).applyInArrow(totals, f"{head}chunk int, replicate int, pos double, neg double, pos_hit double, neg_hit double"))
    before = Window.partitionBy(*names, "replicate").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    whole = Window.partitionBy(*names, "replicate")
    held = sums.select(*group, "replicate", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_before") for c in ("pos", "neg")], *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("pos", "neg")])
    real = counts.groupBy(*names).agg(F.sum("pos").alias("pos_real"), F.sum("neg").alias("neg_real"))
    held = held.join(real, names) if names else held.withColumns({c: F.lit(float(v or 0)) for c, v in real.first().asDict().items()})
    held = held.select(*[F.col(n).alias(f"h_{n}") for n in group], *held.columns[len(group):])

    def precision(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        order = np.argsort(-rows.column("p").to_numpy(), kind="stable")
        pos, neg, key = (rows.column(c).to_numpy()[order] for c in ("pos", "neg", "key"))
        offsets = offsets.sort_by("replicate")
        tp, fp, pos_all, neg_all, pos_real, neg_real = (offsets.column(c).to_numpy().astype(float) for c in ("pos_before", "neg_before", "pos_all", "neg_all", "pos_real", "neg_real"))
        a, b = (pos_real / np.maximum(pos_all, 1), neg_real / np.maximum(neg_all, 1)) if stratified else (np.ones(replicates), np.ones(replicates))
        out = np.zeros(replicates)
        for _, p, n in drawn_classes(pos, neg, key, which):
            tps, fps = tp + np.cumsum(p, 0), fp + np.cumsum(n, 0)
            out += (p * (a * tps) / np.maximum(a * tps + b * fps, 1e-12)).sum(0)
            tp, fp = tps[-1], fps[-1]
        same = {n: pa.repeat(rows.column(n)[0], replicates) for n in names}
        return pa.table({**same, "replicate": pa.array(which.astype(np.int32)), "part": out})

    parts = counts.groupBy(*group).cogroup(held.groupBy(*[f"h_{n}" for n in group])).applyInArrow(precision, f"{head}replicate int, part double")
    by = [*names, "replicate"]
    ap = parts.groupBy(*by).agg(F.sum("part").alias("part"))
    flat = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_hit", "neg_hit")]).join(ap, by)
    ratio = lambda a, b, name: F.struct(F.lit(name).alias("metric"), F.when(F.col(b) > 0, F.col(a) / F.col(b)).alias("value"))
    cells = F.array(ratio("part", "pos", "pr_auc"), ratio("pos_hit", "pos", "recall"), ratio("neg_hit", "neg", "fpr"))
    out = _intervals(flat.select(*names, F.explode(cells).alias("c")).select(*names, "c.*"), [*names, "metric"], level)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "metric", "low", "high")


def _slice_draws(scored: DataFrame, factors: list[str], threshold: float, replicates: int, seed: int) -> DataFrame:
    """``factor, level, replicate, fp, tn, other, n``: redrawn cells of every level; ``n`` is its real size."""
    hit, clean = M.above(threshold), F.col("y") == 0
    n = lambda c: F.count(F.when(c, 1))
    cells = M.by_factor(scored, factors).groupBy("factor", "level").agg(n(clean & hit).alias("fp"), n(clean & ~hit).alias("tn"), n(~clean).alias("other"))
    cells = cells.withColumn("key", row_key(seed, "factor", "level"))
    which = np.arange(replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [b.column(i).to_numpy() for i in (2, 3, 4)]
            keys = b.column(5).to_numpy().view(np.uint64)
            step = max(1, CELLS // replicates)
            for start in range(0, b.num_rows, step):
                some = slice(start, start + step)
                drawn = [poisson(c[some], keys[some], which, salt).ravel() for c, salt in zip(counts, (_POSITIVE, _NEGATIVE, _OTHER))]
                at = np.repeat(np.arange(b.num_rows)[some], replicates)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.tile(which, len(at) // replicates).astype(np.int32)), *map(pa.array, drawn), pa.array(sum(counts)[at])],
                    names=["factor", "level", "replicate", "fp", "tn", "other", "n"])

    return cells.mapInArrow(run, "factor string, level string, replicate int, fp double, tn double, other double, n long")


def slice_fpr_intervals(scored: DataFrame, factors: list[str], threshold: float, replicates: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``factor, level, low, high`` of the FPR of every level of every factor; a level without clean rows has none."""
    drawn = _slice_draws(scored, factors, threshold, replicates, seed)
    rate = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).alias("value")
    return _intervals(drawn.select("factor", "level", rate), ["factor", "level"], level)


def disparity_intervals(scored: DataFrame, factors: list[str], threshold: float, replicates: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``factor, low, high`` of the largest over the smallest smoothed FPR; levels keep their sizes in every replicate."""
    drawn = _slice_draws(scored, factors, threshold, replicates, seed)
    all_ = F.col("fp") + F.col("tn") + F.col("other")
    scaled = drawn.where(F.col("fp") + F.col("tn") > 0).withColumn("s", F.col("n") / all_)
    smooth = (F.col("fp") * F.col("s") + 1) / ((F.col("fp") + F.col("tn")) * F.col("s") + 2)
    each = scaled.groupBy("factor", "replicate").agg(F.when(F.count("*") > 1, F.max(smooth) / F.min(smooth)).alias("value"))
    return _intervals(each, ["factor"], level)
