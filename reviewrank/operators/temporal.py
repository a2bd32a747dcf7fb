"""The temporal view of a session: ten-second series and random-kernel features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.scalars import clip

CHUNK = 4096  # bins whose windows one piece of a session answers for
HALO = 8 * 32  # further bins a piece holds: no kernel of nine taps spans more

def binned(grid: DataFrame) -> DataFrame:
    """``session_id, bin, <24 signals>``: scaled means over ten seconds; the last bin counts as full."""
    def squashed(name: str, kind: str, thr: float) -> Column:
        scale = 1.0 if kind == "binary" else 2 * thr
        return clip(F.coalesce(F.col(name), F.lit(0.0)) / scale, 0.0, 3.0)

    return grid.groupBy("session_id", F.floor(F.col("sec") / R.BIN_S).alias("bin")).agg(
        *[(F.sum(squashed(n, k, t)) / R.BIN_S).alias(n) for n, _, k, t in R.SIGNALS])


def chunked_series(bins: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """``session_id, chunk, start, bin_from, series``: pieces of a series of bins, in order, one array per bin.

    A piece answers for the windows that start in its ``chunk`` bins and holds ``halo`` more, the longest window a kernel
    spans; ``start`` says where it begins and ``bin_from`` which bin comes first.  A row never holds a whole session.
    """
    own = F.floor(F.col("bin") / chunk)
    oldest = F.greatest(F.ceil((F.col("bin") - F.lit(chunk + halo - 1)) / chunk), F.lit(0))
    spread = bins.withColumn("chunk", F.explode(F.sequence(oldest.cast("long"), own.cast("long"))))
    pieces = spread.groupBy("session_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("bin", F.array(*R.SIGNAL_NAMES).alias("v")))).alias("rows"))
    return pieces.select(
        "session_id", "chunk", (F.col("chunk") * chunk).alias("start"), F.col("rows")[0]["bin"].alias("bin_from"),
        F.transform("rows", lambda x: x["v"]).alias("series")).where(F.col("bin_from") < F.col("start") + chunk)


def kernels(n_channels: int, n: int = R.N_KERNELS, length: int = R.MAX_BINS, seed: int = R.KERNEL_SEED) -> dict[int, dict]:
    """Random nine-tap kernels by dilation: centred weights spread over one to three channels, and a bias."""
    rng = np.random.default_rng(seed)
    taps = rng.standard_normal((n, 9))
    taps -= taps.mean(axis=1, keepdims=True)
    dilation = (2 ** rng.uniform(0, min(np.log2((length - 1) / 8), 5), n)).astype(int)
    picked = rng.permuted(np.tile(np.arange(n_channels), (n, 1)), axis=1)
    mask = np.zeros((n, n_channels))
    for i, count in enumerate(rng.integers(1, 4, n)):
        mask[i, picked[i, :count]] = 1.0
    bias = rng.uniform(-1, 1, n)
    out = {}
    for d in np.unique(dilation):
        at = np.flatnonzero(dilation == d)
        out[int(d)] = {"at": at, "w": mask[at][:, :, None] * taps[at][:, None, :], "b": bias[at]}
    return out


def kernel_features(bins: DataFrame, n: int = R.N_KERNELS, seed: int = R.KERNEL_SEED, chunk: int = CHUNK) -> DataFrame:
    """``session_id, features``: for each kernel its maximum and its share of positive responses.

    ``bins`` are those of :func:`binned`, without gaps.  Pieces of a session give their maxima and counts apart, and these
    are merged; a kernel that spans more bins than the session has gives zeros.
    """
    bank = kernels(len(R.SIGNAL_NAMES), n, seed=seed)
    halo = 8 * max(bank)

    def respond(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximum, positive responses and all responses of each kernel, of windows that start in the piece's own bins."""
        top, positive, total = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d, k in bank.items():
            mine = x[: chunk + 8 * d]
            if len(mine) <= 8 * d:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(mine, 8 * d + 1, axis=0)[:, :, ::d]
            conv = np.tensordot(k["w"], windows, axes=([1, 2], [1, 2])) + k["b"][:, None]
            top[k["at"]], positive[k["at"]], total[k["at"]] = conv.max(axis=1), (conv > 0).sum(axis=1), conv.shape[1]
        return top, positive, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                series = b.column("series")[k].values
                x = series.flatten().to_numpy(zero_copy_only=False).reshape(len(series), -1)
                parts = (pa.array([y.tolist()], t) for y, t in zip(respond(x), (pa.list_(pa.float64()), *[pa.list_(pa.int64())] * 2)))
                yield pa.RecordBatch.from_arrays([b.column("session_id").slice(k, 1), *parts], names=["session_id", "top", "positive", "total"])

    found = chunked_series(bins, chunk, halo).select("session_id", "series").mapInArrow(
        run, "session_id string, top array<double>, positive array<long>, total array<long>")
    each = found.select("session_id", F.posexplode(F.arrays_zip("top", "positive", "total")).alias("kernel", "r"))
    merged = each.groupBy("session_id", "kernel").agg(
        F.max("r.top").alias("top"), F.sum("r.positive").alias("positive"), F.sum("r.total").alias("total"))
    known = F.col("total") > 0
    pair = F.array(F.when(known, F.col("top")).otherwise(0.0), F.when(known, F.col("positive") / F.col("total")).otherwise(0.0))
    ordered = F.array_sort(F.collect_list(F.struct("kernel", pair.cast("array<float>").alias("v"))))
    return merged.groupBy("session_id").agg(F.flatten(F.transform(ordered, lambda x: x["v"])).alias("features"))
