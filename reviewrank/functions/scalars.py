"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def wilson_low(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of k out of n; 0 when n is 0."""
    share = k / n
    root = F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(n == 0, F.lit(0.0)).otherwise((share + z * z / (2 * n) - z * root) / (1 + z * z / n))


def duration_text(seconds: Column) -> Column:
    """``45 s``, ``3 min 05 s``, ``2 h 07 min``; halves of a second round to even."""
    s = F.rint(seconds).cast("bigint")
    minutes, rest = F.floor(s / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min "), two(rest), F.lit(" s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), two(minutes % 60), F.lit(" min")))
    )


def clock_text(ms: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour on."""
    s = F.greatest(F.lit(0), F.rint(ms / 1000).cast("bigint"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tail = F.concat(two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), tail)).otherwise(tail)


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def browser_name(agent: Column) -> Column:
    out = F.lit("—")
    for mark, name in (("Safari/", "Safari"), ("Firefox/", "Firefox"), ("Chrome/", "Chrome"), ("Edg/", "Edge")):
        out = F.when(agent.contains(mark), F.lit(name)).otherwise(out)
    return out
