"""Ranking, calibration and fairness metrics over scored rows (``y`` 0/1, ``p`` score).

Everything that needs an order first counts rows per distinct score, then runs over those counts with
:class:`Ordered`, so ties are exact and no task sees the whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewrank.functions import registry as R
from reviewrank.functions.prefix import Ordered, exact_quantiles
from reviewrank.functions.reshape import exploded, long_format
from reviewrank.functions.scalars import clip

_ALL = "_all"
EDGES = [i * (1.0 / R.CALIBRATION_BINS) for i in range(R.CALIBRATION_BINS + 1)]


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def score_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, p, pos, neg``: rows of each class per distinct score."""
    y = F.col("y").cast("bigint")
    return scored.groupBy(*keys, "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Score counts with ``tp`` and ``fp`` accepted at or above each score."""
    return run_counts(score_counts(scored, keys), keys)


def run_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    return Ordered(counts, keys, [F.col("p").desc()]).running(sums={"tp": F.col("pos"), "fp": F.col("neg")})


def ranking(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``n, positives, pr_auc`` (average precision) and ``roc_auc`` per key; NULL where undefined."""
    keys = keys or []
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    total_pos, total_neg = F.sum(pos), F.sum(neg)
    return curve(scored, keys).groupBy(*keys).agg(
        (total_pos + total_neg).alias("n"),
        total_pos.alias("positives"),
        F.when(total_pos > 0, F.sum(pos * tp / (tp + fp)) / total_pos).alias("pr_auc"),
        F.when((total_pos > 0) & (total_neg > 0), F.sum(neg * (tp - pos / 2)) / (total_pos * total_neg)).alias("roc_auc"),
    )


def score_bin(p: Column | str = "p") -> Column:
    """Calibration bin: number of inner edges at or below the score."""
    p = F.col(p) if isinstance(p, str) else p
    out = F.lit(0)
    for e in EDGES[1:-1]:
        out = out + (p >= e).cast("int")
    return out.cast("bigint")


def reliability(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    b = F.col("bin")
    lo = F.element_at(F.array(*[F.lit(e) for e in EDGES]), (b + 1).cast("int"))
    hi = F.element_at(F.array(*[F.lit(e) for e in EDGES]), (b + 2).cast("int"))
    return scored.groupBy(*keys, score_bin().alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg(F.col("y").cast("double")).alias("frac_pos")
    ).select(*keys, "bin", lo.alias("bin_lo"), hi.alias("bin_hi"), "n", "mean_pred", "frac_pos")


def calibration_error(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``ece`` and ``brier`` per key from one pass over the rows."""
    keys = keys or []
    y = F.col("y").cast("double")
    binned = scored.groupBy(*keys, score_bin().alias("bin")).agg(
        F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum(y).alias("sy"), F.sum((F.col("p") - y) ** 2).alias("sq"))
    return binned.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def above(threshold: float, strict: bool = False) -> Column:
    return (F.col("p") > threshold) if strict else (F.col("p") >= threshold)


def rates(scored: DataFrame, flagged: Column, keys: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates; empty denominators count as one."""
    pos = F.col("y") == 1
    n = lambda c: F.count(F.when(c, 1))
    counted = scored.groupBy(*(keys or [])).agg(
        n(flagged & pos).alias("tp"), n(flagged & ~pos).alias("fp"), n(~flagged & pos).alias("fn"), n(~flagged & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "*", _ratio(tp, tp + fn).alias("recall"), _ratio(fp, fp + tn).alias("fpr"), _ratio(tp, tp + fp).alias("precision"),
        ((tp + fp) / (tp + fp + fn + tn)).alias("flag_rate"))


def summary(scored: DataFrame, threshold: float) -> DataFrame:
    """One row with every headline metric."""
    one = [ranking(scored), calibration_error(scored), rates(scored, above(threshold))]
    out = one[0].withColumn(_ALL, F.lit(0))
    for part in one[1:]:
        out = out.join(part.withColumn(_ALL, F.lit(0)), _ALL)
    return out.drop(_ALL)


def fpr_thresholds(scored: DataFrame, budgets: list[float]) -> DataFrame:
    """``budget, cut, inclusive``: accept scores above ``cut`` (or at it, where inclusive) to stay in budget."""
    run = curve(scored, []).where("neg > 0").withColumn(_ALL, F.lit(0))
    totals = scored.where("y = 0").agg(F.count("*").alias("n")).withColumn(_ALL, F.lit(0))
    first = F.col("fp") - F.col("neg")
    sized = run.join(F.broadcast(totals), _ALL)  # one row
    rows = [
        F.struct(F.lit(float(b)).alias("budget"), F.least(F.floor(F.lit(float(b)) * F.col("n")), F.col("n") - 1).alias("k"),
                 (F.floor(F.lit(float(b)) * F.col("n")) >= F.col("n")).alias("inclusive"))
        for b in budgets
    ]
    wide = sized.select("p", "fp", first.alias("first"), F.explode(F.array(*rows)).alias("w")).select("p", "fp", "first", "w.*")
    hit = wide.where((F.col("first") <= F.col("k")) & (F.col("k") < F.col("fp")))
    return hit.select("budget", F.col("p").alias("cut"), "inclusive")


def cost_curve(calibration: DataFrame, validation: DataFrame, ratios: list[int] = R.COST_RATIOS) -> DataFrame:
    """Cheapest threshold per cost ratio on one set, its rates on another.

    Six numbers come back to the driver; they are parameters of the second pass.
    """
    run = curve(calibration, [])
    best = run.agg(*[
        F.min(F.struct((F.lit(r) * F.col("fp") - F.col("tp")).alias("c"), F.col("p").alias("t"))).alias(f"r{r}") for r in ratios
    ]).first()
    rows = []
    for r in ratios:
        cheapest = best[f"r{r}"]
        # flagging nothing costs 0 on this scale; on a tie the lower threshold wins
        t = 1.01 if cheapest is None or cheapest["c"] > 0 else float(cheapest["t"])
        rows.append((r, t))
    n = lambda c: F.count(F.when(c, 1))
    pos = F.col("y") == 1
    aggs = [F.count("*").alias("n"), n(pos).alias("p_all")]
    for r, t in rows:
        aggs += [n(above(t) & ~pos).alias(f"fp{r}"), n(~above(t) & pos).alias(f"fn{r}")]
    counted = validation.agg(*aggs)
    cells = [
        F.struct(F.lit(r).cast("bigint").alias("fp_to_fn_cost_ratio"), F.lit(t).alias("threshold"), F.col(f"fp{r}").alias("fp"), F.col(f"fn{r}").alias("fn"))
        for r, t in rows
    ]
    out = counted.select("n", "p_all", F.explode(F.array(*cells)).alias("x")).select("n", "p_all", "x.*")
    return out.select(
        "fp_to_fn_cost_ratio", "threshold",
        _ratio(F.col("p_all") - F.col("fn"), F.col("p_all")).alias("val_recall"),
        _ratio(F.col("fp"), F.col("n") - F.col("p_all")).alias("val_fpr"),
        (1000 * (F.col("fp_to_fn_cost_ratio") * F.col("fp") + F.col("fn")) / F.col("n")).alias("val_expected_cost_per_1000"))


def by_factor(scored: DataFrame, factors: list[str], keys: list[str] | None = None) -> DataFrame:
    """``keys, factor, level, y, p`` rows, one per factor."""
    keys = keys or []
    cells = [F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors]
    return exploded(scored, [*keys, "y", "p"], F.array(*cells), "s").select(*keys, "s.factor", "s.level", "y", "p")


def slice_metrics(scored: DataFrame, factors: list[str], threshold: float, underpowered: int = 300) -> DataFrame:
    """Metrics of every level of every factor."""
    keys = ["factor", "level"]
    long = by_factor(scored, factors)
    ranked, cal = ranking(long, keys), calibration_error(long, keys).drop("brier")
    pos, hit = F.col("y") == 1, above(threshold)
    share = lambda c: F.avg(F.when(c, hit.cast("double")))
    plain = long.groupBy(*keys).agg(share(~pos).alias("fpr"), share(pos).alias("recall"))
    return ranked.drop("roc_auc").join(cal, keys).join(plain, keys).withColumn("underpowered", F.col("n") < underpowered)


def fpr_disparity(scored: DataFrame, factors: list[str], threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Largest over smallest smoothed FPR of each factor; NULL with fewer than two levels."""
    keys = keys or []
    clean = by_factor(scored, factors, keys).where("y = 0").groupBy(*keys, "factor", "level").agg(
        F.count("*").alias("n"), F.count(F.when(above(threshold), 1)).alias("fp"))
    smooth = (F.col("fp") + 1) / (F.col("n") + 2)
    return clean.groupBy(*keys, "factor").agg(
        F.when(F.count("*") > 1, F.max(smooth) / F.min(smooth)).alias("fpr_disparity"))


def slice_weights(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Weight 1, but clean rows share the weight of their class equally between cells."""
    counts = rows.where("y = 0").groupBy(*cell).agg(F.count("*").alias("_n"))
    totals = counts.agg((F.sum("_n") / F.count("*")).alias("_target")).first()["_target"]
    joined = rows.join(counts, cell, "left")
    return joined.withColumn("weight", F.when(F.col("y") == 0, F.lit(totals) / F.col("_n")).otherwise(F.lit(1.0))).drop("_n")


def flag_rate_by(scored: DataFrame, column: str, threshold: float) -> DataFrame:
    return scored.groupBy(F.col(column).alias("profile")).agg(
        F.count("*").alias("n"), F.avg(above(threshold).cast("double")).alias("flagged_share"))


def medians(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, median`` over all rows."""
    long = long_format(wide, [], columns)
    return exact_quantiles(long, ["feature"], "value", [0.5]).select("feature", F.col("q")[0].alias("median"))


def spearman(wide: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """Rank correlation of each column with a 0/1 label, average ranks for ties; NULL where constant."""
    long = long_format(wide.withColumn("_y", F.col(label).cast("double")), ["_y"], columns).na.fill({"value": 0.0})
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("_y").alias("pos"))
    ranked = Ordered(counted, ["feature"], [F.col("value")]).running(sums={"upto": F.col("n")})
    r = F.col("upto") - (F.col("n") - 1) / 2
    s = ranked.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(r * F.col("n")).alias("sr"),
        F.sum(r * r * F.col("n")).alias("srr"), F.sum(r * F.col("pos")).alias("srp"))
    n, p = F.col("n"), F.col("p")
    cov = n * F.col("srp") - F.col("sr") * p
    var = F.sqrt(n * F.col("srr") - F.col("sr") ** 2) * F.sqrt(n * p - p * p)
    return s.select("feature", F.when(var > 0, cov / var).alias("rho"))


def exact_ks_p(ks: float, n: int, m: int) -> float:
    """The chance of a statistic of ``ks`` or more between samples of ``n`` and ``m`` from one distribution, without ties.

    An order of both samples is a path through an ``n`` by ``m`` lattice, all equally likely; the statistic stays below
    ``ks`` on the paths that keep ``|i / n - j / m|`` below it.  Those are counted row by row: a row is the running sum of
    the one before, cut to the band.  Counts are scaled as they grow.
    """
    bound = round(ks * n * m)  # in steps of 1 / (n * m)
    if bound <= 0:
        return 1.0
    j = np.arange(m + 1)
    row, scale = (j * n < bound).astype(float), 0.0
    for i in range(1, n + 1):
        inside = np.abs(i * m - j * n) < bound
        row = np.cumsum(np.where(inside, row, 0.0))
        row = np.where(inside, row, 0.0)
        top = row.max()
        if top <= 0:
            return 1.0
        row, scale = row / top, scale + math.log(top)
    paths = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    within = math.exp(math.log(row[m]) + scale - paths) if row[m] > 0 else 0.0
    return min(1.0, max(0.0, 1.0 - within))


def ks_report(tested: DataFrame, top: int = 15, level: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The ``top`` columns of :func:`ks_test` that differ most (ties by name), and how many are below ``level``."""
    below = tested.agg(F.count("*").alias("compared"), F.count(F.when(F.col("p_value") < level, 1)).alias("differing"))
    return tested.orderBy(F.col("ks").desc(), "feature").limit(top), below


def ks_test(a: DataFrame, b: DataFrame, columns: list[str], least: int = 5, exact_upto: int = 10_000) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per column with its p-value.

    The p-value is exact where both samples have at most ``exact_upto`` values, else that of the limit.
    """
    side = lambda df, n: long_format(df, [], columns).where("value IS NOT NULL").withColumn("a", F.lit(n))
    both = side(a, 1).unionByName(side(b, 0))
    counted = both.groupBy("feature", "value").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    run = Ordered(counted, ["feature"], [F.col("value")]).running(
        sums={"ca": F.col("na"), "cb": F.col("nb")})
    totals = counted.groupBy("feature").agg(
        F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.sum(F.col("value") * F.col("na")).alias("sa"), F.sum(F.col("value") * F.col("nb")).alias("sb"))
    totals = totals.where((F.col("ta") >= least) & (F.col("tb") >= least))
    d = run.join(F.broadcast(totals), "feature")  # one row per compared column
    stat = d.groupBy("feature").agg(
        F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"),
        F.first("ta").alias("ta"), F.first("tb").alias("tb"), F.first(F.col("sa") / F.col("ta")).alias("mean_a"), F.first(F.col("sb") / F.col("tb")).alias("mean_b"))
    lam2 = F.col("ks") ** 2 * F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb"))
    term = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + term(k))
    limit = F.when(lam2 < 0.04, F.lit(1.0)).otherwise(clip(series, 0.0, 1.0))

    @pandas_udf("double")
    def exact(ks: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([exact_ks_p(k, int(i), int(j)) if max(i, j) <= exact_upto else np.nan for k, i, j in zip(ks, n, m)], dtype=float)

    found = exact("ks", F.col("ta").cast("long"), F.col("tb").cast("long"))  # one row a column
    p = F.nanvl(found, limit)
    return stat.select("feature", "ks", p.alias("p_value"), "mean_a", "mean_b")


def metric_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two ``keys, value`` sets side by side with the absolute difference; a one-sided row has NULL."""
    left, right = a.withColumnRenamed("value", "left_value"), b.withColumnRenamed("value", "right_value")
    return left.join(right, keys, "full_outer").withColumn("diff", F.abs(F.col("left_value") - F.col("right_value")))
