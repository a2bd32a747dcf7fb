"""Session features from the grid: whole-session, windowed, baseline-normalised and cross-channel.

Rolling means come from running sums over fixed-point integers, so they are exact, cost the same for every
window length, and do not depend on the order in which partial results arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewrank.functions import registry as R

SCALE = 1_000_000_000


def _by():
    return Window.partitionBy("session_id").orderBy("sec")


def _run():
    return _by().rowsBetween(Window.unboundedPreceding, 0)


def _whole():
    return _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def need(window: int) -> Column:
    """Observed seconds a rolling mean asks for."""
    return F.greatest(F.lit(1), F.floor(F.least(F.lit(window), F.col("ticks")) / 2))


def _scale(name: str) -> int:
    """Pasted characters are whole numbers without a small bound; all other signals are small."""
    return 1 if name == "paste_chars" else SCALE


def _fixed(name: str) -> Column:
    return F.rint(F.col(name) * _scale(name)).cast("bigint")


def _running(names: list[str]) -> list[Column]:
    """Running fixed-point sums ``_s_*`` and counts ``_n_*``."""
    sums = [F.coalesce(F.sum(_fixed(n)).over(_run()), F.lit(0)).alias(f"_s_{n}") for n in names]
    return sums + [F.count(n).over(_run()).alias(f"_n_{n}") for n in names]


def _lagged(pairs: list[tuple[str, int]]) -> list[Column]:
    """The running values one window length earlier."""
    sums = [F.lag(f"_s_{n}", w, 0).over(_by()).alias(f"_ls_{n}_{w}") for n, w in pairs]
    return sums + [F.lag(f"_n_{n}", w, 0).over(_by()).alias(f"_ln_{n}_{w}") for n, w in pairs]


def _mean(n: str, w: int) -> Column:
    total, seen = F.col(f"_s_{n}") - F.col(f"_ls_{n}_{w}"), F.col(f"_n_{n}") - F.col(f"_ln_{n}_{w}")
    return F.when(seen >= need(w), total / _scale(n) / seen).alias(f"{n}__r{w}")


def with_rolling(grid: DataFrame, wanted: dict[int, list[str]]) -> DataFrame:
    """Add ``<signal>__r<window>``: NULL-aware mean of the last ``window`` seconds, for ``{window: signals}``."""
    pairs = [(n, w) for w, ns in wanted.items() for n in ns]
    df = grid.select("*", *_running(list(dict.fromkeys(n for n, _ in pairs))))
    df = df.select("*", *_lagged(pairs))
    return df.select(*grid.columns, *[_mean(n, w) for n, w in pairs])


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _run_length(n: str) -> Column:
    broken = F.when(_or_zero(n) <= R.THRESHOLD[n], F.col("sec"))
    return (F.col("sec") - F.coalesce(F.max(broken).over(_run()), F.lit(-1))).alias(f"{n}__run")


def with_runs(grid: DataFrame, names: list[str]) -> DataFrame:
    """Add ``<signal>__run``: how many seconds in a row, up to this one, the signal was above its threshold."""
    return grid.select("*", *[_run_length(n) for n in names])


def whole_aggs(names: list[str] | None = None) -> list[Column]:
    out = []
    for n in names or R.SIGNAL_NAMES:
        out += [
            F.coalesce(F.avg(n), F.lit(0.0)).alias(f"{n}__mean"),
            F.coalesce(F.max(n), F.lit(0.0)).alias(f"{n}__max"),
            F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias(f"{n}__std"),
        ]
    return out


def run_aggs(names: list[str] | None = None) -> list[Column]:
    return [F.max(f"{n}__run").cast("double").alias(f"{n}__longest_run_s") for n in names or R.SIGNAL_NAMES]


def window_aggs(windows: list[int]) -> list[Column]:
    out = []
    for w in windows:
        for n, _, kind, thr in R.SIGNALS:
            cut = thr if kind == "continuous" else 0.5 * thr
            r = F.col(f"{n}__r{w}")
            out += [
                F.coalesce(F.max(r), F.lit(0.0)).alias(f"{n}__w{w}_max"),
                _share(F.coalesce(r, F.lit(0.0)) > cut).alias(f"{n}__w{w}_over"),
            ]
    return out


def interaction_conditions() -> dict[str, Column]:
    """Seconds on which signals of several channels coincide; unknown counts as no evidence."""
    v = _or_zero
    on = lambda n: v(n) > 0.5
    return {
        "x_gaze_off_and_foreign": on("gaze_off") & on("foreign"),
        "x_phone_and_pitch_down": on("phone") & (v("pitch_down") > 15),
        "x_multi_face_and_voice": (on("multi_face") | on("extra_person")) & on("vad"),
        "x_mismatch_and_face": on("id_mismatch") & (v("no_face") < 0.5),
        "x_gaze_off_no_typing": on("gaze_off") & (v("keys_per_s") < 0.2),
        "x_paper_and_pitch_down": on("paper") & (v("pitch_down") > 12),
        "x_foreign_and_keys": on("foreign") & (v("keys_per_s") > 1),
    }


def interaction_aggs() -> list[Column]:
    return [_share(c).alias(n) for n, c in interaction_conditions().items()]


def _returned() -> Column:
    hidden = (_or_zero("tab_hidden") > 0.5).cast("int")
    back = F.lag(hidden, 1, 0).over(_by()) - hidden == 1
    pasted = F.max((_or_zero("paste_chars") > 0).cast("int")).over(_by().rowsBetween(0, 30)) == 1
    return (back & pasted).cast("int").alias("_returned")


def with_paste_after_return(grid: DataFrame) -> DataFrame:
    """Add ``_returned``: 1 on a second where the tab came back and a paste follows within 30 seconds."""
    return grid.select("*", _returned())


def unknown_aggs() -> list[Column]:
    return [(1.0 - F.avg(F.col(f"obs_{c}").cast("double"))).alias(f"unk_{c}") for c in R.CHANNELS]


def luma_aggs() -> list[Column]:
    return [F.avg("luma").alias("q_luma_mean"), F.percentile("luma", F.lit(0.1)).alias("q_luma_p10")]


def _usable_so_far() -> Column:
    return F.sum(F.col("yaw_abs").isNotNull().cast("int")).over(_run()).alias("_nth")


def _in_baseline(name: str, seconds: int) -> Column:
    return F.when(F.col("yaw_abs").isNotNull() & (F.col("_nth") <= seconds), F.col(name))


def _baseline_centre(seconds: int) -> list[Column]:
    """Usable seconds, and count and median of every signal in them."""
    out = [F.count(_in_baseline("yaw_abs", seconds)).over(_whole()).alias("_usable")]
    for n in R.BASELINE_FLOOR:
        inside = _in_baseline(n, seconds)
        out += [F.count(inside).over(_whole()).alias(f"_have_{n}"), F.percentile(inside, F.lit(0.5)).over(_whole()).alias(f"_med_{n}")]
    return out


def _baseline_spread(seconds: int) -> list[Column]:
    return [
        F.percentile(F.abs(_in_baseline(n, seconds) - F.col(f"_med_{n}")), F.lit(0.5)).over(_whole()).alias(f"_mad_{n}")
        for n in R.BASELINE_FLOOR
    ]


def _baseline_z(needed: int) -> list[Column]:
    """``_z_*`` where the baseline holds enough seconds, and whether it does."""
    out = []
    for n, floor in R.BASELINE_FLOOR.items():
        spread = F.greatest(F.lit(R.MAD_SCALE) * F.col(f"_mad_{n}"), F.lit(floor))
        enough = F.col(f"_have_{n}") >= needed
        ready = (F.col("_usable") >= needed) & enough
        out += [F.when(ready, F.abs(F.col(n) - F.col(f"_med_{n}")) / spread).alias(f"_z_{n}"), enough.alias(f"_ok_{n}")]
    return out


def with_baseline(
    grid: DataFrame, seconds: int = R.BASELINE_SECONDS, needed: int = R.BASELINE_NEEDED
) -> DataFrame:
    """Add ``_z_<signal>`` (absolute robust z against the first usable minute) and ``_usable`` seconds in it."""
    df = grid.select("*", _usable_so_far())
    df = df.select("*", *_baseline_centre(seconds))
    df = df.select("*", *_baseline_spread(seconds))
    return df.select(*grid.columns, "_usable", *_baseline_z(needed))


def baseline_aggs(needed: int = R.BASELINE_NEEDED) -> list[Column]:
    """From :func:`with_baseline` followed by rolling means of ``_z_*`` over 60 seconds."""
    ready = F.first("_usable") >= needed
    out = [ready.cast("double").alias("baseline_available")]
    for n in R.BASELINE_FLOOR:
        ok = ready & F.first(f"_ok_{n}")
        top = F.coalesce(F.max(f"_z_{n}__r60"), F.lit(0.0))
        out += [
            F.when(ok, top).alias(f"bn_{n}__w60_max"),
            F.when(ok, _share(_or_zero(f"_z_{n}") > 3)).alias(f"bn_{n}__frac_over3"),
        ]
    return out


def _known(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Values of some columns, a row each, 0 where unknown; and which are known."""
    known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    filled = np.stack([pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in columns])
    return filled, known


def _fixed_numbers(values: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Like :func:`_fixed`."""
    return np.rint(values * scale).astype(np.int64)


class _Rows:
    """Consecutive grid rows of one or more sessions; the first session may have rows before, ``lead`` of them are here again."""

    def __init__(self, starts: np.ndarray, n: int, lead: int):
        self.starts, self.n, self.lead = starts, n, lead
        self.first = np.repeat(starts, np.diff(np.append(starts, n)))  # of each row: the first row of its session
        self.fresh = np.concatenate(([lead], starts[1:]))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.fresh, axis=1)

    def sums_in_order(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sums that add row after row, the first session's from ``start`` on: rounded means do not depend on batches."""
        k, s = len(x), len(self.fresh)
        values = np.concatenate((np.zeros((k, s)), x[:, self.lead:]), axis=1)
        values[:, 0] = start
        of = np.concatenate((np.arange(s), np.repeat(np.arange(s), np.diff(np.append(self.fresh, self.n)))))
        return np.bincount((of + s * np.arange(k)[:, None]).ravel(), values.ravel(), k * s).reshape(k, s)

    def tops(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x, self.fresh, axis=1)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """A column for each new row from one for each session."""
        return np.repeat(x, np.diff(np.append(self.fresh, self.n)), axis=1)

    def rolled(self, fixed: np.ndarray, known: np.ndarray, scale: np.ndarray, window: int, ticks: np.ndarray) -> np.ndarray:
        """NULL-aware means of the last ``window`` rows, NaN where too few are known; ``fixed`` and ``known`` are running from 0."""
        before = np.maximum(self.first, np.arange(self.n) + 1 - window)
        total, seen = fixed[:, 1:] - np.take(fixed, before, axis=1), known[:, 1:] - np.take(known, before, axis=1)
        enough = seen >= np.maximum(1, np.minimum(window, ticks) // 2)
        return np.where(enough, total / scale / np.maximum(seen, 1), np.nan)


def _running_sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[0], x.shape[1] + 1), np.int64)
    np.cumsum(x, axis=1, out=out[:, 1:])
    return out


def _moments(rows: _Rows, v: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """Count, mean and squared distances of every session's known values; a session of equal values gets no distance at all."""
    n = rows.sums(known.astype(np.int64))
    at = np.where(known, np.arange(rows.n), rows.n)
    at = np.minimum.reduceat(at, rows.fresh, axis=1)
    pivot = np.where(at < rows.n, np.take_along_axis(v, np.minimum(at, rows.n - 1), axis=1), 0.0)

    def away(centre: np.ndarray) -> np.ndarray:
        out = np.zeros(v.shape)
        out[:, rows.lead:] = np.where(known[:, rows.lead:], v[:, rows.lead:] - rows.spread(centre), 0.0)
        return out

    mean = pivot + rows.sums(away(pivot)) / np.maximum(n, 1)
    return {"n": n, "mean": mean, "m2": rows.sums(away(mean) ** 2)}


_ADDED, _MOST, _MOMENTS, _ORDERED = "added", "most", "moments", "ordered"
#: those of :func:`interaction_conditions`, in its order
_COINCIDING = [n for n in R.INTERACTIONS if n != "x_paste_after_tab_return"]


def _merged(a: dict, b: dict) -> dict:
    """Statistics of rows that follow each other in one session."""
    x, y = a[_MOMENTS], b[_MOMENTS]
    n = x["n"] + y["n"]
    delta, share = y["mean"] - x["mean"], y["n"] / np.maximum(n, 1)
    mean = np.where(x["n"] == 0, y["mean"], x["mean"] + delta * share)
    return {
        _ADDED: {k: v + b[_ADDED][k] for k, v in a[_ADDED].items()},
        _MOST: {k: np.fmax(v, b[_MOST][k]) for k, v in a[_MOST].items()},
        _MOMENTS: {"n": n, "mean": mean, "m2": x["m2"] + y["m2"] + delta * delta * x["n"] * share},
        _ORDERED: b[_ORDERED],  # begun with those of ``a``
    }


def _piece(
    batch: pa.RecordBatch, rows: _Rows, held: dict | None, unbroken: np.ndarray, windows: list[int], zs: list[str]
) -> tuple[dict, np.ndarray]:
    """Statistics of the sessions in ``batch``, and for each signal the last second that was not above its threshold.

    ``held`` and ``unbroken``: statistics and that second of the first session's rows before.
    """
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    lead = rows.lead
    sec, ticks = (col[n].to_numpy(zero_copy_only=False) for n in ("sec", "ticks"))
    v, known = _known([col[n] for n in R.SIGNAL_NAMES])
    none = lambda x, there: np.where(there, x, -np.inf)

    scale = np.array([[float(_scale(n))] for n in R.SIGNAL_NAMES])
    fixed, counts = _running_sums(_fixed_numbers(v, scale) * known), _running_sums(known)
    cut = np.array([[thr if kind == "continuous" else 0.5 * thr] for _, _, kind, thr in R.SIGNALS])
    added, most = {}, {"max": rows.tops(none(v, known))}
    for w in windows:
        r = rows.rolled(fixed, counts, scale, w, ticks)
        most[f"w{w}"] = rows.tops(none(r, ~np.isnan(r)))
        added[f"w{w}"] = rows.sums((np.nan_to_num(r) > cut).astype(np.int64))

    at = np.maximum.accumulate(np.where(v <= np.array([[R.THRESHOLD[n]] for n in R.SIGNAL_NAMES]), np.arange(rows.n), -1), axis=1)
    before = np.full((len(v), rows.n), -1)
    before[:, : rows.starts[1] if len(rows.starts) > 1 else rows.n] = unbroken[:, None]
    last = np.where(at >= rows.first, sec[np.maximum(at, 0)], before)
    most["run"] = rows.tops(sec - last)

    start = {k: x[:, 0] for k, x in held[_ORDERED].items()} if held else {"sum": 0.0, "others": 0.0}
    others = [f"obs_{c}" for c in R.CHANNELS] + [*_COINCIDING, "_returned", "luma"]
    x, there = _known([col[n] for n in others])
    ordered = {"sum": rows.sums_in_order(v, start["sum"]), "others": rows.sums_in_order(x, start["others"])}
    added |= {"n": rows.sums(known.astype(np.int64)), "others_n": rows.sums(there.astype(np.int64)), "rows": rows.sums(np.ones((1, rows.n), np.int64))}
    whole = ["_p10", "ticks", "duration_s", *(["_usable"] if zs else []), *[f"_ok_{n}" for n in zs]]
    x, there = _known([col[n] for n in whole])
    most["whole"] = rows.tops(none(x, there))
    if zs:
        x, there = _known([col[f"_z_{n}"] for n in zs])
        ones = np.full((len(zs), 1), float(SCALE))
        r = rows.rolled(_running_sums(_fixed_numbers(x, ones) * there), _running_sums(there), ones, 60, ticks)
        most["z"], added["z"] = rows.tops(none(r, ~np.isnan(r))), rows.sums((x > 3).astype(np.int64))
    return {_ADDED: added, _MOST: most, _MOMENTS: _moments(rows, v, known), _ORDERED: ordered}, last[:, -1]


def _feature_columns(s: dict, windows: list[int], zs: list[str], needed: int) -> dict[str, np.ndarray]:
    """Features of finished sessions; NaN where a feature has no value."""
    added, most, moments, ordered = s[_ADDED], s[_MOST], s[_MOMENTS], s[_ORDERED]
    n_rows = added["rows"][0]
    zero = lambda x: np.where(np.isneginf(x), 0.0, x)
    unknown = lambda x: np.where(np.isneginf(x), np.nan, x)
    p10, _, duration, *baseline = most["whole"]
    with np.errstate(invalid="ignore", divide="ignore"):
        others = ordered["others"] / np.where(added["others_n"] > 0, added["others_n"], np.nan)
    f = {"duration_min": duration / 60.0}
    for i, n in enumerate(R.SIGNAL_NAMES):
        seen = np.maximum(added["n"][i], 1)
        f |= {f"{n}__mean": ordered["sum"][i] / seen, f"{n}__max": zero(most["max"][i]), f"{n}__std": np.sqrt(moments["m2"][i] / seen)}
        f[f"{n}__longest_run_s"] = most["run"][i].astype(float)
        for w in windows:
            f |= {f"{n}__w{w}_max": zero(most[f"w{w}"][i]), f"{n}__w{w}_over": added[f"w{w}"][i] / n_rows}
    ready = baseline[0] >= needed if zs else np.zeros(len(n_rows), bool)
    f["baseline_available"] = ready.astype(float)
    for i, n in enumerate(R.BASELINE_FLOOR):
        ok = ready & (baseline[1 + i] == 1) if zs else ready
        f[f"bn_{n}__w60_max"] = np.where(ok, zero(most["z"][i]) if zs else 0.0, np.nan)
        f[f"bn_{n}__frac_over3"] = np.where(ok, added["z"][i] / n_rows if zs else 0.0, np.nan)
    k = len(R.CHANNELS)
    f |= {f"unk_{c}": 1.0 - others[i] for i, c in enumerate(R.CHANNELS)}
    f |= dict(zip(_COINCIDING, others[k:-2], strict=True))
    f["x_paste_after_tab_return"] = ordered["others"][-2]
    f |= {"q_luma_mean": others[-1], "q_luma_p10": unknown(p10)}
    return f


def _picked(s: dict, where: slice) -> dict:
    return {part: {k: v[:, where] for k, v in values.items()} for part, values in s.items()}


def session_features(
    grid: DataFrame, windows: list[int] = R.WINDOWS, baseline: bool = True, needed: int = R.BASELINE_NEEDED
) -> DataFrame:
    """One row per session with the feature columns in registry order.

    Spark brings the rows of a session together in order and finds medians over sessions in windows.  What is left needs a
    row and those of one window length before it: each task adds it up over its Arrow batches as they come, so it holds a
    batch, the last rows of the one before and one session's statistics, however long a session is.
    """
    p10 = F.percentile("luma", F.lit(0.1)).over(_whole()).alias("_p10")
    df = grid.select("*", p10, _returned(), *([_usable_so_far()] if baseline else []))
    zs = list(R.BASELINE_FLOOR) if baseline else []
    if baseline:
        df = df.select("*", *_baseline_centre(R.BASELINE_SECONDS))
        df = df.select("*", *_baseline_spread(R.BASELINE_SECONDS)).select("*", *_baseline_z(needed))
    # the windows above leave the rows of a session together and in order
    df = df.select(
        "session_id", "sec", "ticks", "duration_s", *R.SIGNAL_NAMES, *[f"obs_{c}" for c in R.CHANNELS], "luma", "_p10", "_returned",
        *[c.alias(n) for n, c in interaction_conditions().items()], *(["_usable"] if baseline else []), *[f"_{k}_{n}" for k in ("z", "ok") for n in zs])
    names = [n for n in R.feature_names() if "__w" not in n or n.startswith("bn_") or int(n.rsplit("__w", 1)[1].split("_")[0]) in windows]
    most = max([*windows, 60]) - 1
    schema = pa.schema([("session_id", pa.string()), *[(n, pa.float64()) for n in names]])

    def done(ids: pa.Array, stats: dict) -> pa.RecordBatch:
        made = _feature_columns(stats, windows, zs, needed)
        return pa.RecordBatch.from_arrays([ids, *[pa.array(made[n], pa.float64(), from_pandas=True) for n in names]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ids = lead = unbroken = None  # of the last session so far: statistics, id, last rows, and where its runs began
        for b in batches:
            if not b.num_rows:
                continue
            goes_on = held is not None and b.column(0)[0].equals(ids[0])
            if held is not None and not goes_on:
                yield done(ids, held)
            whole = pa.concat_batches([lead, b]) if goes_on else b
            ends = pc.run_end_encode(whole.column(0))
            starts = np.concatenate(([0], ends.run_ends.to_numpy(zero_copy_only=False)[:-1])).astype(np.int64)
            rows = _Rows(starts, whole.num_rows, lead.num_rows if goes_on else 0)
            stats, last = _piece(whole, rows, held if goes_on else None, unbroken if goes_on else np.full(len(R.SIGNAL_NAMES), -1), windows, zs)
            n = len(starts)
            if goes_on:
                first = _merged(held, _picked(stats, slice(0, 1)))
                if n > 1:
                    yield done(ids, first)
            if n - 1 > (1 if goes_on else 0):
                some = slice(1 if goes_on else 0, n - 1)
                yield done(ends.values.slice(some.start, some.stop - some.start), _picked(stats, some))
            held = first if goes_on and n == 1 else _picked(stats, slice(n - 1, n))
            ids = ends.values.slice(n - 1, 1)
            lead = whole.slice(max(int(starts[-1]), whole.num_rows - most))
            unbroken = last
        if held is not None:
            yield done(ids, held)

    return df.mapInArrow(run, ", ".join(["session_id string", *[f"`{n}` double" for n in names]]))
