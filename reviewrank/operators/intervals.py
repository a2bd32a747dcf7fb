"""Joins between time intervals, seconds and score maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.session import small_table


def best_iou(truth: DataFrame, found: DataFrame, bucket_ms: int = 300_000) -> DataFrame:
    """``session_id, type, start_ms, end_ms, n, iou``: best overlap of each true interval (0 if none).

    Equal intervals are scored once (``n`` of them).  Both sides are cut into time buckets, so a busy
    session is spread over many tasks and only intervals that share a bucket meet.
    """
    key = ["session_id", "type", "start_ms", "end_ms"]
    t = truth.groupBy(*key).agg(F.count("*").alias("n"))
    f = found.select("session_id", "type", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).distinct()

    def bucketed(df: DataFrame, a: str, b: str) -> DataFrame:
        first, last = F.floor(F.col(a) / bucket_ms), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bucket_ms)
        return df.withColumn("_b", F.explode(F.sequence(first, last)))

    pairs = bucketed(t, "start_ms", "end_ms").join(bucketed(f, "s", "e"), ["session_id", "type", "_b"], "left")
    inter = F.least("end_ms", "e") - F.greatest("start_ms", "s")
    union = F.greatest("end_ms", "e") - F.least("start_ms", "s")
    iou = F.when(F.col("e").isNotNull() & (inter > 0) & (union > 0), inter / union)
    return pairs.groupBy(*key, "n").agg(F.coalesce(F.max(iou), F.lit(0.0)).alias("iou"))


def iou_summary(best: DataFrame) -> DataFrame:
    """Per type: episodes, share with IoU of at least one half, mean best IoU."""
    n = F.col("n")
    return best.groupBy("type").agg(
        F.sum(n).alias("episodes"), (F.sum(F.when(F.col("iou") >= 0.5, n).otherwise(0)) / F.sum(n)).alias("share_iou_ge_0_5"),
        (F.sum(F.col("iou") * n) / F.sum(n)).alias("mean_best_iou"))


def truth_seconds(intervals: DataFrame, types: list[str], step_ms: int = 1000) -> DataFrame:
    """``session_id, sec, truth_<type>..., truth_any`` of every second inside an interval (end rounded up)."""
    first = F.floor(F.col("start_ms") / step_ms)
    last = F.ceil(F.col("end_ms") / step_ms) - 1
    covered = intervals.distinct().where(last >= first).select(
        "session_id", "type", F.explode(F.sequence(first, last)).alias("sec"))
    return covered.groupBy("session_id", "sec").agg(
        *[F.max((F.col("type") == t).cast("int")).alias(f"truth_{t}") for t in types], F.lit(1).alias("truth_any"))


def detector_errors(grid: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits and misses of every detector against scripted truth, over all sessions."""
    joined = grid.join(truth, ["session_id", "sec"], "left")
    per_session, cells = [], []
    for det, signal, vtype in R.DETECTORS:
        seen = F.col(signal).isNotNull()
        hit = F.coalesce(F.col(signal), F.lit(0.0)) > 0.5
        true = F.coalesce(F.col(f"truth_{vtype}"), F.lit(0)) == 1
        clean = F.col("truth_any").isNull() & seen
        n = lambda c: F.count(F.when(c, 1))
        per_session += [
            n(hit & true & seen).alias(f"tp_{det}"), n(~hit & true & seen).alias(f"fn_{det}"), n(hit & clean).alias(f"fp_{det}"),
            n(clean).alias(f"neg_{det}"), F.max(true.cast("int")).alias(f"has_{det}")]
        cells.append(F.struct(
            F.lit(det).alias("detector"), *[F.sum(f"{k}_{det}").alias(k) for k in ("tp", "fn", "fp", "neg")],
            F.sum(f"has_{det}").alias("sessions_with_truth")))
    one = joined.groupBy("session_id").agg(*per_session).agg(F.array(*cells).alias("c"))
    out = one.select(F.explode("c").alias("d")).select("d.*")
    return out.select(
        "*", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("fp", "neg").alias("fp_rate_per_second"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision_at_observed_prevalence"))


def measured_rates(errors: DataFrame, config: DataFrame, pessimism: float, sessions: int, least: int = 20) -> DataFrame:
    """Detector settings with measured recall and precision where the evidence suffices."""
    enough = F.lit(sessions >= least)
    known = errors.join(F.broadcast(config), "detector")  # seven detectors
    clip = lambda c, hi: F.greatest(F.lit(0.05), F.least(F.lit(hi), c))
    recall = F.when(
        enough & F.col("recall").isNotNull() & (F.col("sessions_with_truth") >= 3), F.bround(clip(F.col("recall"), 0.999), 3)
    ).otherwise(F.col("set_recall"))
    df = known.withColumn("new_recall", recall)
    k = F.col("fp_rate_per_second") / (pessimism * F.col("ref_prevalence") * F.greatest(F.col("new_recall"), F.lit(1e-3)))
    precision = F.when(
        enough & F.col("fp_rate_per_second").isNotNull() & (F.col("neg") >= 3600), F.bround(clip(1 / (1 + k), 1.0), 3)
    ).otherwise(F.col("set_precision"))
    return df.select("detector", "new_recall", precision.alias("new_precision"))


def interpolate(df: DataFrame, column: str, xs: list[float], tracks: dict[str, list[float]], buckets: int = 1000) -> DataFrame:
    """Add piecewise-linear lookups of ``column`` (0..1) in a monotone map, clamped at its ends.

    The map is a model parameter of a few hundred points; its segments are keyed by score bucket, so a row
    meets the one or two segments of its bucket.
    """
    rows, seen = [], set()
    pts = list(zip(xs, *tracks.values(), strict=True))
    ends = [(float("-inf"), *pts[0][1:])] + pts + [(float("inf"), *pts[-1][1:])]
    at = lambda v: min(buckets, max(0, int(v * buckets // 1))) if abs(v) != float("inf") else (0 if v < 0 else buckets)
    for (x0, *y0), (x1, *y1) in zip(ends, ends[1:], strict=False):
        for b in range(at(x0), at(x1) + 1):
            row = {"_b": b, "_x0": x0, "_x1": x1}
            for name, a, z in zip(tracks, y0, y1, strict=True):
                row[f"_y0_{name}"], row[f"_y1_{name}"] = a, z
            if x1 > x0 and (b, x0) not in seen:
                seen.add((b, x0))
                rows.append(row)
    ys = ", ".join(f"_y0_{n} DOUBLE, _y1_{n} DOUBLE" for n in tracks)
    segments = F.broadcast(small_table(df.sparkSession, rows, f"_b BIGINT, _x0 DOUBLE, _x1 DOUBLE, {ys}"))
    v = F.col(column)
    keyed = df.withColumn("_b", F.least(F.lit(buckets), F.greatest(F.lit(0), F.floor(v * buckets))).cast("bigint"))
    hit = keyed.join(segments, (keyed["_b"] == segments["_b"]) & (v >= segments["_x0"]) & (v < segments["_x1"]), "left")

    def line(name: str) -> Column:
        flat = F.col(f"_y1_{name}") == F.col(f"_y0_{name}")
        slope = (F.col(f"_y1_{name}") - F.col(f"_y0_{name}")) / (F.col("_x1") - F.col("_x0"))
        return F.when(flat, F.col(f"_y0_{name}")).otherwise(F.col(f"_y0_{name}") + slope * (v - F.col("_x0")))

    return hit.select(*[keyed[c] for c in df.columns], *[line(n).alias(n) for n in tracks])
