"""Wide rows to long rows without one projection per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list[str | Column], items: Column, name: str = "x") -> DataFrame:
    """``keep...`` and one row per element of ``items``.

    The array becomes a column first: it is then built by compiled code, and the generator reads a narrow
    row.  Exploding the expression itself would interpret it, and resolve its type, for every row.  The
    arrays used here are never empty; the outer form keeps the optimizer from building them twice to check.
    """
    built = df.select(*keep, items.alias("_items"))
    return built.select(*[c for c in built.columns if c != "_items"], F.explode_outer("_items").alias(name))


def long_format(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """``keep..., feature, value`` (DOUBLE), one row per column; an array keeps the generated code small."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    built = df.select(*keep, values.alias("_values"))
    spread = built.select(*keep, F.posexplode_outer("_values").alias("_i", "value"))
    return spread.select(*keep, F.element_at(names, F.col("_i") + 1).alias("feature"), "value")
