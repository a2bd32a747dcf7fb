"""Runs of active seconds: consecutive positions merged over short gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_runs(df: DataFrame, keys: list[str], pos: str, active: Column, gap: Column | int) -> DataFrame:
    """``keys, start, end`` (end exclusive) of active rows, bridging at most ``gap`` inactive positions.

    Meant for grid rows: a key holds at most one row per second of its session.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    gap = F.lit(gap) if isinstance(gap, int) else gap
    hits = df.where(active).select(*keys, F.col(pos).alias("_pos"), gap.alias("_gap"))
    w = Window.partitionBy(*keys).orderBy("_pos")
    opened = hits.withColumn(
        "_new", F.coalesce((F.col("_pos") - F.lag("_pos").over(w) > F.col("_gap") + 1).cast("int"), F.lit(1))
    )
    numbered = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(
        F.min("_pos").alias("start"), (F.max("_pos") + 1).alias("end"), F.count("*").alias("active")
    ).drop("_run")


def fill_runs(keys: list[str], pos: str, active: Column, gap: Column) -> tuple[Column, Column]:
    """Columns ``(inside, starts)`` for rows of a dense grid.

    ``inside`` marks rows of a merged run including its bridged gaps; ``starts`` is 1 on its first row.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    here = F.when(active, F.col(pos))
    last = F.max(here).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(here).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.min(here).over(w.rowsBetween(0, Window.unboundedFollowing))
    inside = active | (last.isNotNull() & nxt.isNotNull() & (nxt - last - 1 <= gap))
    starts = active & F.coalesce(F.col(pos) - before - 1 > gap, F.lit(True))
    return inside, starts.cast("int")
