"""Whole evaluation and drift reports of a model, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import drift as D
from reviewrank.operators import intervals as X
from reviewrank.operators import metrics as M
from reviewrank.operators import resampling as Z
from reviewrank.operators import scoring as S
from reviewrank.operators import training as T

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def as_rows(df: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """``part, item, metric, value``: every number of a table, named by its keys (null ones as a dash)."""
    item = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]) if keys else F.lit("all")
    numbers = [c for c, t in df.dtypes if c not in keys and t in _NUMBERS]
    wide = df.select(item.alias("item"), *[F.col(c).cast("double").alias(c) for c in numbers])
    return wide.unpivot(["item"], numbers, "metric", "value").select(F.lit(part).alias("part"), "item", "metric", "value")


def evaluation(validation: DataFrame, calibration: DataFrame, threshold: float, factors: list[str], profile: str, more: dict[str, tuple[DataFrame, list[str]]] | None = None,
               replicates: int = 500) -> DataFrame:
    """The evaluation bundle of scored rows ``(y, p, factors, profile)`` at one threshold, as ``part, item, metric, value``.

    Headline metrics with intervals, reliability, slices with the intervals of their FPR, disparities with theirs, cost curve on
    calibration rows, flag rates by profile.  ``more`` adds tables of other operators (such as :func:`episodes`) with their keys.
    """
    gap = M.fpr_disparity(validation, factors, threshold)
    parts = {
        "validation": (M.summary(validation.select("y", "p"), threshold), []),
        "intervals": (Z.ranking_intervals(validation.select("y", "p"), threshold, replicates=replicates), ["metric"]),
        "reliability": (M.reliability(validation), ["bin"]),
        "slices": (M.slice_metrics(validation, factors, threshold).join(Z.slice_fpr_intervals(validation, factors, threshold, replicates), ["factor", "level"], "left"), ["factor", "level"]),
        "disparity": (gap.join(Z.disparity_intervals(validation, factors, threshold, replicates), "factor", "left"), ["factor"]),
        "cost": (M.cost_curve(calibration.select("y", "p"), validation.select("y", "p")), ["fp_to_fn_cost_ratio"]),
        "profiles": (M.flag_rate_by(validation, profile, threshold), ["profile"]),
    } | (more or {})
    out = None
    for name, (table, keys) in parts.items():
        mine = as_rows(table, name, keys)
        out = mine if out is None else out.unionByName(mine)
    return out


def episodes(truth: DataFrame, flags: DataFrame, bucket_ms: int = 60_000) -> tuple[DataFrame, list[str]]:
    """The share of true episodes that a flag of their type meets well, and their mean best overlap, for :func:`evaluation`."""
    return X.iou_summary(X.best_iou(truth, flags, bucket_ms)), ["type"]


def model_drift(reference: DataFrame, current: DataFrame, model: S.RiskModel, order: list[str], slice_by: str, size: int = R.DRIFT_BATCH, top: int = 10) -> DataFrame:
    """Drift of batches of ``size`` new rows against reference rows, watching the ``top`` features of the model.

    Features are ranked by their mean absolute contribution on the reference; their names, ``top`` of them, reach the driver.
    """
    watched = [r["feature"] for r in T.importance(reference, model, top).collect()]
    threshold = model.tiers["HUMAN_REVIEW"]
    before, after = S.score(reference, model), S.score(current, model)
    rate = D.review_rate(before, threshold)
    keep = list(dict.fromkeys([*order, "y", "p", slice_by, *watched]))
    return D.drift_report(before, D.numbered_batches(after.select(*keep), order, size), watched, threshold, slice_by, rate)
