"""Operational queries: listings, queues, counts and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.session import small_table

FACTORS = [
    "lighting", "webcam_class", "room_noise", "connection_stability", "eyewear", "head_covering", "behavior_profile",
]


def sealed(source: str = "source", split: str = "split") -> Column:
    """Simulated holdout sessions: labels and scores stay hidden."""
    return F.coalesce((F.col(source) == "SIMULATED") & (F.col(split) == "holdout"), F.lit(False))


def mask_sealed(df: DataFrame, hidden: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~sealed(), F.col(c)) for c in hidden})


def session_list(
    sessions: DataFrame, participants: DataFrame, labels: DataFrame, splits: DataFrame, predictions: DataFrame, *,
    source: str | None = None, status: str | None = None, profile: str | None = None, lighting: str | None = None,
    webcam_class: str | None = None, violation: bool | None = None, recommendation: str | None = None,
    q: str | None = None, include_deleted: bool = False, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of sessions, newest first, with code, label, split and prediction.

    When no filter needs a joined table, the page is cut first and only its at most ``limit`` rows are joined.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    own = {"source": source, "behavior_profile": profile, "lighting": lighting, "webcam_class": webcam_class, "status": status}
    s = sessions
    for column, value in own.items():
        if value:
            s = s.where(F.col(column) == value)
    if not status and not include_deleted:
        s = s.where("status <> 'DELETED'")

    def paged(df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)

    code = participants.select(F.col("id").alias("participant_id"), F.col("code").alias("participant_code"))
    parts = [
        (labels.select(F.col("session_id").alias("id"), F.col("violation").alias("violation_label")), "id"),
        (splits.select(F.col("session_id").alias("id"), "split"), "id"),
        (predictions.select(F.col("session_id").alias("id"), "risk", "recommendation"), "id"),
    ]
    late = violation is None and recommendation is None and not q
    if late:
        page = paged(s)
        keys = F.broadcast(page.select("id"))  # at most `limit` ids
        parts = [(p.join(keys, k, "left_semi"), k) for p, k in parts]
        code = code.join(F.broadcast(page.select("participant_id").distinct()), "participant_id", "left_semi")
        s = page
    out = s.join(code, "participant_id", "left")
    for p, k in parts:
        out = out.join(p, k, "left")
    if violation is not None:
        out = out.where(F.col("violation_label") == violation)
    if recommendation:
        out = out.where(F.col("recommendation") == recommendation)
    if violation is not None or recommendation:
        out = out.where(F.col("split").isNull() | (F.col("split") != "holdout"))
    if q:
        like = f"%{q.strip()}%"
        out = out.where(F.col("id").ilike(like) | F.coalesce(F.col("participant_code").ilike(like), F.lit(False)))
    return paged(mask_sealed(out, ["violation_label", "risk", "recommendation"])) if not late else mask_sealed(
        out, ["violation_label", "risk", "recommendation"])


def queue_rows(
    predictions: DataFrame, sessions: DataFrame, participants: DataFrame, verdicts: DataFrame,
    tier: str = "HUMAN_REVIEW", include_reviewed: bool = False,
) -> DataFrame:
    """Every session waiting for review at ``tier`` or above."""
    order = R.RECOMMENDATIONS[1:]
    wanted = order[order.index(tier):]
    s = sessions.where("status <> 'DELETED'").select(
        F.col("id").alias("session_id"), "participant_id", "source", "status", "lighting", "webcam_class", "duration_s")
    out = predictions.where(F.col("recommendation").isin(wanted)).join(s, "session_id")
    if not include_reviewed:
        out = out.join(verdicts.select("session_id"), "session_id", "left_anti")
    code = participants.select(F.col("id").alias("participant_id"), F.col("code").alias("participant_code"))
    return out.join(code, "participant_id", "left")


def review_queue(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the queue, highest risk first."""
    return rows.orderBy(F.col("risk").desc(), "session_id").offset(offset).limit(limit)


def reviews_summary(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict counts, overturn rate and confirmations that match the label, in one row."""
    n = lambda c: F.count(F.when(c, 1))
    v = F.col("verdict")
    joined = verdicts.join(labels.where("violation").select("session_id", F.lit(True).alias("_true")), "session_id", "left")
    counted = joined.agg(
        F.count("*").alias("reviews"), *[n(v == k).alias(k.lower()) for k in ("NO_CONCERN", "CONCERN_CONFIRMED", "INCONCLUSIVE")],
        n((v == "CONCERN_CONFIRMED") & F.col("_true")).alias("confirmed_matching_ground_truth"))
    return counted.withColumn("overturn_rate", F.try_divide("no_concern", "reviews"))


def participant_sessions(sessions: DataFrame) -> DataFrame:
    """Live sessions per person, as participant or helper; a session counts once per person."""
    people = F.array_compact(F.array_distinct(F.array("participant_id", "helper_participant_id")))
    return sessions.where("status <> 'DELETED'").select(F.explode(people).alias("participant_id")).groupBy("participant_id").agg(
        F.count("*").alias("session_count"))


def eligible(sessions: DataFrame, min_duration_s: float = 1200.0) -> DataFrame:
    """Mock sessions that may enter the corpus."""
    return sessions.where(
        (F.col("source") == "MOCK") & ~F.col("is_rehearsal")
        & F.col("status").isin("UPLOADED", "PROCESSING", "ANALYZING", "COMPLETED", "REVIEWED") & (F.col("duration_s") >= min_duration_s))


def coverage_grid(rows: DataFrame, lightings: tuple = ("bright", "normal", "dim"), webcams: tuple = ("hd", "sd", "low")) -> DataFrame:
    """Sessions per lighting and webcam, with zeros, as one row per known lighting, whether it has sessions or not."""
    known = small_table(rows.sparkSession, [{"lighting": x} for x in lightings], "lighting STRING")
    counts = rows.groupBy("lighting").pivot("webcam_class", list(webcams)).count()
    return known.join(counts, "lighting", "left").na.fill(0, list(webcams)).select("lighting", *webcams)


def coverage_summary(rows: DataFrame, target: int = 60) -> DataFrame:
    """Totals of the corpus and whether its targets are met."""
    s = rows.agg(
        F.count("*").alias("eligible_sessions"), F.countDistinct("lighting").alias("lightings"),
        F.countDistinct("webcam_class").alias("webcams"), F.countDistinct("participant_id").alias("participants_recorded"))
    met = (F.col("eligible_sessions") >= target) & (F.col("lightings") >= 3) & (F.col("webcams") >= 2)
    return s.withColumn("met", met)


def factor_breakdown(sessions: DataFrame, labels: DataFrame, factors: list[str] = FACTORS) -> DataFrame:
    """``factor, value, sessions, positive_rate`` of all factors from one scan."""
    labelled = sessions.select(F.col("id").alias("session_id"), *factors).join(labels.select("session_id", "violation"), "session_id")
    sets = labelled.groupingSets([[F.col(f)] for f in factors], *[F.col(f) for f in factors]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("sessions"), F.avg(F.col("violation").cast("double")).alias("positive_rate"))
    # the one factor a row groups by has a zero bit in the grouping id
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(factors):
        mine = F.bitwise_not(F.col("_g").cast("bigint")).bitwiseAND(1 << (len(factors) - 1 - i)) != 0
        which, value = F.when(mine, F.lit(f)).otherwise(which), F.when(mine, F.col(f).cast("string")).otherwise(value)
    return sets.select(which.alias("factor"), value.alias("value"), "sessions", "positive_rate")


def status_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("source", "status").agg(F.count("*").alias("n"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n`` of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest(df: DataFrame, key: list[str], newest: list[str], columns: list[str]) -> DataFrame:
    """The newest row per key, by aggregation: rows of a key are reduced before the shuffle."""
    row = F.max_by(F.struct(*columns), F.struct(*newest)).alias("_r")
    return df.groupBy(*key).agg(row).select(*key, "_r.*")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def dataset_catalog(versions: DataFrame, manifests: DataFrame, accesses: DataFrame) -> DataFrame:
    """Dataset versions with their split manifest and the holdout accesses made (at most two are ever granted)."""
    log = accesses.groupBy("dataset_version").agg(
        F.count("*").alias("n_accesses"), F.array_sort(F.collect_list(F.struct("access_no", "purpose"))).alias("holdout_accesses"))
    return versions.join(manifests, "dataset_version", "left").join(log, "dataset_version", "left").withColumn(
        "n_accesses", F.coalesce("n_accesses", F.lit(0).cast("bigint")))
