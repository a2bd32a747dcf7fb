"""Time-bounded flags: stretches of a session a reviewer should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.reshape import exploded


def flag_signals() -> dict[str, Column]:
    """Flag type -> its signal on a grid row; unknown inputs count as no evidence."""
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    both = c("multi_face").isNotNull() & c("extra_person").isNotNull()
    return {
        "PHONE_USE": zero(c("phone")),
        "SECOND_PERSON": zero(F.when(both, F.greatest("multi_face", "extra_person"))),
        "IMPERSONATION": zero(c("id_mismatch")),
        "TAB_SWITCH": zero(c("tab_hidden")),
        "REMOTE_ASSISTANCE": zero(c("foreign") * (1 - zero(c("multi_face")))),
        "NOTE_READING": zero(F.least(c("paper"), F.lit(1.0)) * (zero(c("pitch_down")) > 12).cast("double")),
    }


def flag_density(grid: DataFrame) -> DataFrame:
    """``session_id, sec, sig_*, cum_*, dens_*``: centred window means that end before the session does."""
    w = Window.partitionBy("session_id").orderBy("sec")
    sig = flag_signals()
    df = grid.select("session_id", "sec", "ticks", *[s.alias(f"sig_{t}") for t, s in sig.items()])
    dens, cum = [], []
    for ftype, width, *_ in R.FLAG_RULES:
        shift = width // 2
        mean = F.avg(f"sig_{ftype}").over(w.rowsBetween(shift - width + 1, shift))
        dens.append(F.when(F.col("sec") + shift < F.col("ticks"), mean).otherwise(F.lit(0.0)).alias(f"dens_{ftype}"))
        cum.append(F.sum(f"sig_{ftype}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"cum_{ftype}"))
    return df.select("*", *dens, *cum)


def flags(grid: DataFrame, step_ms: int = 1000, min_length: int = R.FLAG_MIN_LENGTH) -> DataFrame:
    """One row per flag.  Only dense seconds leave the grid; means come from running sums at the ends."""
    cells = [
        F.struct(
            F.lit(t).alias("type"), F.lit(i).alias("rank"), F.lit(gap).alias("gap"), F.lit(text).alias("text"),
            (F.col(f"dens_{t}") >= thr).alias("on"),
            F.col(f"cum_{t}").alias("upto"), (F.col(f"cum_{t}") - F.col(f"sig_{t}")).alias("before"),
        )
        for i, (t, _, thr, gap, text) in enumerate(R.FLAG_RULES)
    ]
    every = exploded(flag_density(grid), ["session_id", "sec"], F.array(*cells), "f")
    on = every.where("f.on").select("session_id", "sec", "f.*")
    w = Window.partitionBy("session_id", "type").orderBy("sec")
    opened = on.withColumn("_new", F.coalesce((F.col("sec") - F.lag("sec").over(w) > F.col("gap") + 1).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("session_id", "type", "rank", "text", "_run").agg(
        F.min("sec").alias("s"), (F.max("sec") + 1).alias("e"), F.min("before").alias("b"), F.max("upto").alias("u")
    ).where(F.col("e") - F.col("s") >= min_length)
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("rank", "s"))
    length = F.col("e") - F.col("s")
    confidence = F.least(F.lit(1.0), (F.col("u") - F.col("b")) / length)
    return runs.withColumn("_n", nth).select(
        "session_id",
        F.concat(F.lit("flg_"), F.lpad(F.col("_n").cast("string"), 3, "0")).alias("flag_id"),
        "type",
        (F.col("s") * step_ms).alias("t_start_ms"),
        (F.col("e") * step_ms).alias("t_end_ms"),
        F.bround(confidence, 3).alias("confidence"),
        F.concat("text", F.lit(" for "), length.cast("string"), F.lit(" seconds.")).alias("explanation"),
        F.concat(F.lit("sessions/"), "session_id", F.lit("#t="), F.col("s").cast("string"), F.lit(","), F.col("e").cast("string")).alias("evidence_ref"),
    )
