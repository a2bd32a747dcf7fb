"""Running values over an order, for groups of any size.

``Window.partitionBy(key).orderBy(...)`` puts a whole key in one task.  That is fine for the per-session
grid, whose length is bounded, but not for raw events (one session may hold a third of them) and not for
orders over a whole table.  :class:`Ordered` cuts every such order into range partitions, at any size: each
chunk is scanned by itself and receives what the chunks before it add up to.  The carried values are one
row per (key, chunk), so their window stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewrank.session import cut_lineage

_CHUNK = "_chunk"


class Ordered:
    """``df`` in the total order ``order`` inside each of ``keys``.

    ``order`` must be unique inside a key, so that every row has one place.  The number of chunks is that of
    the session's shuffle partitions, fewer where adaptive execution merges small ones.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column]):
        self.keys, self.order = keys, order
        ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
        # the chunk number is only stable once written: range bounds are sampled per execution
        self.df = cut_lineage(ranged.withColumn(_CHUNK, F.spark_partition_id()))

    def _local(self):
        return Window.partitionBy(*self.keys, _CHUNK).orderBy(*self.order)

    def _carried(self, totals: dict[str, Column], carry) -> DataFrame:
        per_chunk = self.df.groupBy(*self.keys, _CHUNK).agg(*[c.alias(n) for n, c in totals.items()])
        w = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        return per_chunk.select(*self.keys, _CHUNK, *[carry(n, w).alias(n) for n in totals])

    def _attach(self, carried: DataFrame) -> DataFrame:
        by = [*self.keys, _CHUNK]
        there = carried.toDF(*[f"_to_{c}" if c in by else c for c in carried.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in by]  # a null key is a key
        return self.df.join(there, same, "left").drop(*[f"_to_{c}" for c in by])

    def running(self, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
        """Add inclusive running sums (0 before the first value) and running maxima (null before it)."""
        sums, maxes = sums or {}, maxes or {}
        upto = self._local().rowsBetween(Window.unboundedPreceding, 0)
        totals = {f"_c_{n}": F.sum(c) for n, c in sums.items()} | {f"_c_{n}": F.max(c) for n, c in maxes.items()}
        is_sum = {f"_c_{n}" for n in sums}

        def carry(name, w):
            before = w.rowsBetween(Window.unboundedPreceding, -1)
            return (F.sum(name) if name in is_sum else F.max(name)).over(before)

        out = self._attach(self._carried(totals, carry))
        local = [F.sum(c).over(upto).alias(f"_l_{n}") for n, c in sums.items()]
        local += [F.max(c).over(upto).alias(f"_l_{n}") for n, c in maxes.items()]
        out = out.select("*", *local)
        done = [(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums]
        done += [F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes]
        return out.select(*self.df.columns, *done).drop(_CHUNK)

    def neighbours(self, prev: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
        """Add values of the row before (``prev``) and of the row after (``following``); ``order`` is ascending here."""
        prev, following = prev or {}, following or {}
        w = self._local()
        place = F.struct(*self.order)
        totals = {f"_c_{n}": F.max_by(F.struct(c.alias("v")), place) for n, c in prev.items()}
        totals |= {f"_c_{n}": F.min_by(F.struct(c.alias("v")), place) for n, c in following.items()}
        is_prev = {f"_c_{n}" for n in prev}
        out = self._attach(
            self._carried(totals, lambda n, cw: (F.lag(n) if n in is_prev else F.lead(n)).over(cw))
        )
        local = [F.lag(F.struct(c.alias("v"))).over(w).alias(f"_l_{n}") for n, c in prev.items()]
        local += [F.lead(F.struct(c.alias("v"))).over(w).alias(f"_l_{n}") for n, c in following.items()]
        out = out.select("*", *local)
        names = [*prev, *following]
        done = [F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))["v"].alias(n) for n in names]
        return out.select(*self.df.columns, *done).drop(_CHUNK)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key as ``q`` (array in the order of ``probs``).

    Equal values are counted first, then ranks come from running counts, so no task holds a whole group.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = Ordered(counted, keys, [F.col(value)]).running(sums={"_upto": F.col("_n")})
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    # positions needed: floor and ceil of p * (n - 1); one short row per key
    need = totals.select(
        *keys,
        F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"),
        "_total",
    ).withColumn("_pos", F.col("_p") * (F.col("_total") - 1))
    wanted = need.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_pos"))).alias("_want"),
    )
    # keys name features, so there is one short row for each of a few hundred; shuffling the values by them would not spread
    joined = ranked.join(F.broadcast(wanted), keys)
    first = F.col("_upto") - F.col("_n")
    inside = lambda pos: pos.between(first, F.col("_upto") - 1)
    mine = F.filter("_want", lambda w: inside(F.floor(w["_pos"])) | inside(F.ceil(w["_pos"])))
    hit = joined.select(*keys, value, first.alias("_first"), "_upto", F.explode(mine).alias("_w"))
    lo = F.max(F.when(F.floor("_w._pos").between(F.col("_first"), F.col("_upto") - 1), F.col(value)))
    hi = F.max(F.when(F.ceil("_w._pos").between(F.col("_first"), F.col("_upto") - 1), F.col(value)))
    frac = F.max(F.col("_w._pos") - F.floor("_w._pos"))
    one = hit.groupBy(*keys, F.col("_w._i").alias("_i")).agg(lo.alias("_lo"), hi.alias("_hi"), frac.alias("_f"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return one.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda s: s["q"]).alias("q")
    )
