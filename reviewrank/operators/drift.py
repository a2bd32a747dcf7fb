"""Drift: population stability, review rate and clean-session FPR of arriving batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.prefix import Ordered, exact_quantiles
from reviewrank.functions.reshape import long_format
from reviewrank.functions.scalars import wilson_low

_DECILES = [i / 10 for i in range(11)]


def long_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    return long_format(df, list(keep), features).where(F.col("value").isNotNull() & ~F.isnan("value"))


def reference_edges(reference: DataFrame) -> DataFrame:
    """``feature, inner``: inner bin edges from distinct deciles, or just above a (near-)constant value."""
    q = exact_quantiles(reference, ["feature"], "value", _DECILES)
    edges = F.array_sort(F.array_distinct("q"))
    inner = F.when(F.size(edges) >= 3, F.slice(edges, 2, F.size(edges) - 2)).otherwise(F.array(edges[0] + 1e-12))
    return q.select("feature", inner.alias("inner"))


def _shares(binned: DataFrame, keys: list[str]) -> DataFrame:
    counts = binned.groupBy(*keys, "bins", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys, "bins").agg(F.sum("n").alias("total"))
    every = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins"))))
    return every.join(counts, [*keys, "bins", "bin"], "left").select(
        *keys, "bin", F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("total"), F.lit(1e-4)).alias("share"))


def psi(reference: DataFrame, current: DataFrame, batch: list[str]) -> DataFrame:
    """``batch, feature, psi`` for long ``feature, value`` frames; edges are at most nine per feature."""
    return psi_to(reference_shares(reference), current, batch)


def reference_shares(reference: DataFrame) -> DataFrame:
    """``feature, inner, r``: bin edges and the reference's share in each bin (an array); one row per feature."""
    edges = reference_edges(reference)
    placed = reference.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    shares = _shares(placed.withColumn("bins", F.size("inner")), ["feature"])
    return shares.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("r")).join(edges, "feature")


def psi_to(shares: DataFrame, current: DataFrame, batch: list[str]) -> DataFrame:
    """:func:`psi` against :func:`reference_shares` made before (and perhaps written): at most one row per feature."""
    edges = F.broadcast(shares.select("feature", "inner"))
    at = F.size(F.filter("inner", lambda e: e <= F.col("value")))
    ref = F.broadcast(shares.select("feature", F.posexplode("r").alias("bin", "r")))
    cur = _shares(current.join(edges, "feature").withColumn("bin", at).withColumn("bins", F.size("inner")), [*batch, "feature"]).withColumnRenamed("share", "c")
    part = (F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))
    return cur.join(ref, ["feature", "bin"]).groupBy(*batch, "feature").agg(F.sum(part).alias("psi"))


def numbered_batches(df: DataFrame, order: list[str], size: int = R.DRIFT_BATCH) -> DataFrame:
    """Add ``batch`` (from 1): consecutive blocks of ``size`` rows in the given order."""
    ranked = Ordered(df, [], [F.col(c) for c in order]).running(sums={"_rn": F.lit(1)})
    return ranked.withColumn("batch", (F.floor((F.col("_rn") - 1) / size) + 1).cast("bigint")).drop("_rn")


def drift_report(
    reference: DataFrame | None, current: DataFrame, features: list[str], threshold: float, slice_by: str,
    reference_rate: float, batch: str = "batch", budget: float = R.FPR_BUDGET, shares: DataFrame | None = None,
) -> DataFrame:
    """One row per batch with its measures and alerts.

    ``current`` has ``batch, y, p``, the features and the slice column; a slice counts from 20 clean rows.  Besides the
    worst values, ``psi_by_feature`` and ``slice_fpr`` hold those of every feature and of every level that counts.
    """
    hit, clean = F.col("p") >= threshold, F.col("y") == 0
    n = lambda c: F.count(F.when(c, 1))
    base = current.groupBy(batch).agg(
        F.count("*").alias("sessions"), F.avg(hit.cast("double")).alias("review_rate"), n(clean).alias("_neg"), n(clean & hit).alias("_fp"))
    levels = current.where(clean).groupBy(batch, slice_by).agg(F.count("*").alias("_n"), n(hit).alias("_k")).where("_n >= 20")
    low = wilson_low(F.col("_k"), F.col("_n"))
    over = F.when(low > 2 * budget, F.concat(
        F.lit("FPR "), F.format_string("%.1f%%", 100 * F.col("_k") / F.col("_n")), F.lit(" in "), F.col(slice_by).cast("string"),
        F.lit(" light clearly exceeds 2x the budget")))
    # one entry per level of the slicing factor
    slices = levels.groupBy(batch).agg(
        F.max(F.col("_k") / F.col("_n")).alias("worst_slice_fpr"), F.max(low).alias("worst_slice_low"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(slice_by).cast("string").alias("level"), (F.col("_k") / F.col("_n")).alias("fpr"))))).alias("slice_fpr"),
        F.array_sort(F.array_compact(F.collect_list(over))).alias("_slice_alerts"))
    shares = reference_shares(long_features(reference, features)) if shares is None else shares
    shift = psi_to(shares, long_features(current, features, [batch]), [batch])
    # equal shifts (up to rounding) go to the feature that is monitored first
    place = F.struct(F.round("psi", 12), -F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")))
    worst = shift.groupBy(batch).agg(
        F.max("psi").alias("max_psi"), F.max_by("feature", place).alias("max_psi_feature"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("psi_by_feature"))
    df = base.join(worst, batch, "left").join(slices, batch, "left")
    fpr = F.col("_fp") / F.greatest(F.lit(1), F.col("_neg"))
    rate = F.col("review_rate")
    alerts = F.array_compact(F.array(
        F.when(F.col("max_psi") > R.PSI_ALERT, F.concat(
            F.lit("input drift: PSI "), F.format_string("%.2f", "max_psi"), F.lit(" on "), F.col("max_psi_feature"))),
        F.when((rate > R.RATE_ALERT * reference_rate) | (rate < reference_rate / R.RATE_ALERT), F.concat(
            F.lit("review rate "), F.format_string("%.1f%%", rate * 100), F.lit(f" vs reference {reference_rate:.1%}"))),
        F.when(wilson_low(F.col("_fp"), F.col("_neg")) > 1.5 * budget, F.concat(
            F.lit("clean-session FPR "), F.format_string("%.1f%%", fpr * 100), F.lit(f" clearly above the {budget:.0%} budget"))),
    ))
    return df.select(
        batch, "sessions", "max_psi", "max_psi_feature", "review_rate", fpr.alias("clean_fpr"),
        F.coalesce("worst_slice_fpr", F.lit(0.0)).alias("worst_slice_fpr"), "psi_by_feature", "slice_fpr",
        F.concat(alerts, F.coalesce("_slice_alerts", F.array().cast("array<string>"))).alias("alerts"))


def review_rate(scored: DataFrame, threshold: float) -> float:
    """Share of the reference sent to review (one number)."""
    return float(scored.agg(F.avg((F.col("p") >= threshold).cast("double"))).first()[0] or 0.0)
