"""Monotone maps from scores to risk, fitted on the counts of all distinct scores.

Isotonic regression pools neighbouring scores until their shares of positives grow.  Ranges of scores are pooled by
themselves, and pooled ranges are pooled again some at a time: the result is that of one pass, whatever the ranges.  The
blocks of a range are the corners of a convex chain through whole numbers up to its rows ``n``, so there are at most about
``3 * n ** (2 / 3)`` of them, however many scores.  A logistic map needs five sums per step.  Replicates for the band redraw
the counts where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.operators import metrics as M
from reviewrank.operators.resampling import drawn_classes, row_key
from reviewrank.session import Scratch, cut_lineage

FAN = 16  # ranges pooled together at a time
REAL = -1  # the replicate that stands for the counts themselves
_BLOCK = "lo double, hi double, pos double, n double"


def pool(lo, hi, pos, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks, in order, joined until their shares ``pos / n`` grow."""
    out: list[list[float]] = []
    for block in zip(lo, hi, pos, n, strict=True):
        block = list(block)
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            before = out.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        out.append(block)
    return tuple(np.array(out, float).reshape(-1, 4).T)


def isotonic_blocks(counts: DataFrame, keys: list[str], replicates: int | None = None, seed: int = 0, fan: int = FAN) -> DataFrame:
    """``keys, [replicate,] lo, hi, pos, n``: the blocks of the isotonic fit of ``counts(keys, p, pos, neg)``, one row a block.

    With ``replicates`` one fit for each set of redrawn counts.
    """
    scratch = Scratch(counts.sparkSession)
    types = ", ".join(f"{n} {t}" for n, t in counts.select(*keys).dtypes)
    head = (f"{types}, " if keys else "") + ("replicate int, " if replicates else "")
    which = np.arange(replicates or 0)
    ranged = counts.withColumn("key", row_key(seed, *keys, "p")).repartitionByRange(*keys, "p").withColumn("part", F.spark_partition_id())

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        p, pos, neg, key = (table.column(c).to_numpy() for c in ("p", "pos", "neg", "key"))
        same = lambda k: {c: pa.repeat(table.column(c)[0], k) for c in [*keys, "part"]}
        if not replicates:
            lo, hi, a, n = pool(p, p, pos, pos + neg)
            return pa.table({**same(len(lo)), "lo": lo, "hi": hi, "pos": a, "n": n})
        step, found = max(1, (1 << 20) // max(1, len(p))), []
        for start in range(0, replicates, step):
            some = which[start : start + step]
            drawn = list(drawn_classes(pos, neg, key, some))
            a, b = (np.concatenate([d[i] for d in drawn]) for i in (1, 2))
            for j, r in enumerate(some.tolist()):
                held = np.flatnonzero(a[:, j] + b[:, j])
                lo, hi, x, n = pool(p[held], p[held], a[held, j], (a + b)[held, j])
                found.append(pa.table({**same(len(lo)), "replicate": pa.repeat(pa.scalar(r, pa.int32()), len(lo)), "lo": lo, "hi": hi, "pos": x, "n": n}))
        return pa.concat_tables(found)

    by = [*keys, *(["replicate"] if replicates else [])]
    columns = [*by, "part", "lo", "hi", "pos", "n"]
    # a range partition holds one range of a key or several keys
    blocks = scratch.cut(ranged.groupBy(*keys, "part").applyInArrow(lambda t: first(t).select([*keys, *(["replicate"] if replicates else []), "part", "lo", "hi", "pos", "n"]), f"{head}part int, {_BLOCK}"))

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        lo, hi, pos, n = pool(*(table.column(c).to_numpy() for c in ("lo", "hi", "pos", "n")))
        same = {c: pa.repeat(table.column(c)[0], len(lo)) for c in [*by, "part"]}
        return pa.table({**same, "lo": lo, "hi": hi, "pos": pos, "n": n})

    most = blocks.agg(F.max("part")).first()[0] or 0
    while most > 0:
        fewer = blocks.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy(*by, "part").applyInArrow(joined, f"{head}part int, {_BLOCK}")
        blocks = scratch.cut(fewer.select(*columns), blocks)
        most //= fan
    return blocks.drop("part")


def isotonic_values(blocks: DataFrame, keys: list[str], knots: list[float]) -> DataFrame:
    """``keys, knot, value``: the fit at given scores, linear between blocks and flat beyond the ends."""
    types = "".join(f"{n} {t}, " for n, t in blocks.select(*keys).dtypes)

    def at(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        ends = np.column_stack([table.column(c).to_numpy() for c in ("lo", "hi")]).ravel()
        share = np.repeat(table.column("pos").to_numpy() / table.column("n").to_numpy(), 2)
        same = {c: pa.repeat(table.column(c)[0], len(knots)) for c in keys}
        return pa.table({**same, "knot": pa.array(range(len(knots)), pa.int32()), "value": np.interp(knots, ends, share)})

    return blocks.groupBy(*keys).applyInArrow(at, f"{types}knot int, value double")


def log_odds(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def logistic_maps(counts: DataFrame, replicates: int, seed: int = 0, steps: int = 60) -> dict[int, tuple[float, float]]:
    """``(slope, intercept)`` on the log-odds of the score, for the counts (:data:`REAL`) and for every replicate.

    Newton's method: a step is one pass that adds up five sums per map over ``counts(p, pos, neg)``.
    """
    counts = cut_lineage(counts.select("p", "pos", "neg", row_key(seed, "p").alias("key")))

    def pass_over(maps: dict[int, tuple[float, float]]) -> np.ndarray:
        which = np.array(sorted(maps))
        a, b = (np.array([maps[int(r)][i] for r in which]) for i in (0, 1))
        real = which == REAL

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((5, len(which)))
            for batch in batches:
                p, pos, neg, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                x = log_odds(p)
                for some, drawn_pos, drawn_neg in drawn_classes(pos, neg, key, which):
                    drawn_pos[:, real], drawn_neg[:, real] = pos[some][:, None], neg[some][:, None]
                    n, z = drawn_pos + drawn_neg, x[some][:, None]
                    q = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
                    w, rest = n * q * (1 - q), drawn_pos - n * q
                    sums += np.stack([(rest * z).sum(0), rest.sum(0), (w * z * z).sum(0), (w * z).sum(0), w.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "v"])

        added = counts.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # five numbers a map
        out = np.zeros(5 * len(which))
        out[added["i"].to_numpy()] = added["v"].to_numpy()
        return out.reshape(5, -1)

    def fitted(start: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
        done, open_ = {}, dict(start)
        for _ in range(steps):
            sums = pass_over(open_)
            for k, r in enumerate(sorted(open_)):
                g0, g1, h00, h01, h11 = sums[:, k]
                a, b = open_[r]
                step = np.linalg.solve(np.array([[h00 + 1e-6, h01], [h01, h11 + 1e-9]]), np.array([g0 - 1e-6 * a, g1]))
                step = np.clip(step, -2, 2)
                open_[r] = (a + float(step[0]), b + float(step[1]))
                if np.abs(step).max() < 1e-9:
                    done[r] = open_.pop(r)
            if not open_:
                break
        return done | open_

    real = fitted({REAL: (1.0, 0.0)})
    return real | (fitted(dict.fromkeys(range(replicates), real[REAL])) if replicates else {})


def band(counts: DataFrame, method: str, knots: list[float], replicates: int, seed: int, maps: dict[int, tuple[float, float]] | None = None) -> tuple[list[float], list[float]]:
    """5 % and 95 % of the map refitted on redrawn counts, at every knot; never falling."""
    if method == "platt":
        x = log_odds(np.asarray(knots))
        values = np.array([1 / (1 + np.exp(-np.clip(a * x + b, -35, 35))) for r, (a, b) in (maps or logistic_maps(counts, replicates, seed)).items() if r != REAL])
        ends = np.percentile(values, [5, 95], axis=0)  # replicates x knots
    else:
        drawn = isotonic_values(isotonic_blocks(counts, [], replicates, seed), ["replicate"], knots)
        q = drawn.groupBy("knot").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).orderBy("knot").collect()
        ends = np.array([r["q"] for r in q]).T
    return tuple(np.maximum.accumulate(e).tolist() for e in ends)


def counts_of(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of both classes per distinct score, written once for all that read them."""
    return cut_lineage(M.score_counts(scored, keys or []))
