"""Splits, the sealed holdout, scripted labels, erasure and the status audit."""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.prefix import Ordered
from reviewrank.session import small_table


class HoldoutSealed(RuntimeError):
    """The holdout may not be read this way, or not again."""


def stratified_split(sessions: DataFrame, seed: int) -> DataFrame:
    """``session_id, split``: whole units, in proportion within their stratum.

    Input: ``session_id, unit, violation, profile``.  A unit's stratum is its most violating session's.
    Order inside a stratum is by a seeded hash, so it is the same on every run and every cluster.
    """
    # one sortable text per session: violating first, then profile name
    rank = F.concat(F.when(F.col("violation"), "0").otherwise("1"), F.lit("|"), "profile")
    units = sessions.groupBy("unit").agg(F.min(rank).alias("stratum"))
    hashed = units.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("unit").cast("string"))))
    numbered = Ordered(hashed, ["stratum"], [F.col("_h"), F.col("unit")]).running(sums={"_rn": F.lit(1)})
    sizes = units.groupBy("stratum").agg(F.count("*").alias("_n"))
    placed = numbered.join(sizes, "stratum")
    raw = {s: F.col("_n") * F.lit(f) for s, f in R.SPLITS}
    base = {s: F.floor(c) for s, c in raw.items()}
    left = F.col("_n") - sum(base.values(), F.lit(0))
    names = [s for s, _ in R.SPLITS]
    upto, split = F.lit(0), F.lit(None).cast("string")
    bounds = []
    for i, s in enumerate(names):
        mine = raw[s] - base[s]
        # places before this split when remainders are ranked, ties in split order
        ahead = sum([
            ((raw[o] - base[o] >= mine) if j < i else (raw[o] - base[o] > mine)).cast("int") for j, o in enumerate(names) if j != i
        ], F.lit(0))
        upto = upto + base[s] + (ahead < left).cast("int")
        bounds.append((s, upto))
    for s, bound in reversed(bounds):
        split = F.when(F.col("_rn") <= bound, F.lit(s)).otherwise(split)
    return sessions.select("session_id", "unit").join(placed.select("unit", split.alias("split")), "unit").select("session_id", "split")


def split_manifest(splits: DataFrame) -> DataFrame:
    """Counts and positive rate per split; input ``split, violation``."""
    n = lambda c: F.count(F.when(c, 1))
    return splits.groupBy("split").agg(
        F.count("*").alias("n"), n(F.col("violation")).alias("violating"), n(~F.col("violation")).alias("clean"),
        F.avg(F.col("violation").cast("double")).alias("positive_rate"))


def write_splits(splits: DataFrame, path: str) -> None:
    """The split list, sorted, once: an existing list is never replaced."""
    splits.orderBy("session_id").write.mode("errorifexists").option("header", True).csv(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session_id STRING, split STRING").option("header", True).csv(path)


def ids_hash(ids: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """Order-free hash of a set of ids: sha256 over its hash buckets' hashes, each over sorted lines.

    Buckets are the first hex digits of sha256(id), so they are even for any ids.  ``digits=0`` is the
    plain sha256 of all sorted lines, for sets that fit in one value.
    """
    text = ids.select(F.col(column).cast("string").alias("id")).distinct()
    bucket = F.substring(F.sha2("id", 256), 1, digits) if digits else F.lit("")
    lines = text.groupBy(bucket.alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    if not digits:
        return lines.select("n", F.col("h").alias("ids_sha256"))
    # at most 16^digits rows
    return lines.agg(
        F.sum("n").alias("n"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("ids_sha256"))


def without_holdout(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows outside the sealed holdout: the default view of every table."""
    return df.join(splits.where("split = 'holdout'").select("session_id"), "session_id", "left_anti")


_LOG = "claim STRING, purpose STRING, operator STRING, accessed_at STRING"


def open_holdout(
    splits: DataFrame, expected_hash: str, log_path: str, purpose: str, operator: str, digits: int = 3
) -> DataFrame:
    """The ids of the sealed holdout, for one of the few accesses there are.

    Every caller first appends a claim to the log and only then counts the claims; with its own among more than
    the limit it is refused.  Of any callers, however they overlap, the last to append sees all claims before it, so
    no more than the limit are ever let in; two that race for the last place may both be refused.
    """
    held = splits.where("split = 'holdout'").select("session_id")
    problems = {
        "a purpose of at least ten characters is asked for": len(purpose.strip()) < 10,
        "the holdout is not the sealed one: its hash differs": ids_hash(held, "session_id", digits).first()["ids_sha256"] != expected_hash,
    }
    for what, found in problems.items():
        if found:
            raise (ValueError if "purpose" in what else HoldoutSealed)(what)
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    claim = {"claim": uuid.uuid4().hex, "purpose": purpose.strip(), "operator": operator, "accessed_at": now}
    small_table(splits.sparkSession, [claim], _LOG).write.mode("append").json(log_path)
    if (n := splits.sparkSession.read.schema(_LOG).json(log_path).count()) > R.MAX_HOLDOUT_ACCESSES:
        raise HoldoutSealed(f"all {R.MAX_HOLDOUT_ACCESSES} accesses of the holdout are claimed ({n} claims in the log)")
    return held


def accesses(spark: SparkSession, log_path: str) -> DataFrame:
    """The log of accesses in order, refused claims left out; empty where nothing was logged yet."""
    try:
        claims = spark.read.schema(_LOG).json(log_path)
    except AnalysisException:  # no log yet
        claims = spark.createDataFrame([], _LOG)
    # a handful of rows: claims end at the limit and its refusals
    numbered = claims.withColumn("access_no", F.row_number().over(Window.orderBy("accessed_at", "claim")))
    return numbered.where(F.col("access_no") <= R.MAX_HOLDOUT_ACCESSES).select("access_no", "purpose", "operator", "accessed_at")


def script_intervals(episodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cues that start before the recording ends, clipped to it; -1 means to the end."""
    end_of = F.floor(F.col("duration_s") * 1000)
    j = episodes.join(sessions.select("session_id", "duration_s"), "session_id").withColumn("_end", end_of)
    end = F.when(F.col("scheduled_end_ms") < 0, F.col("_end")).otherwise(F.least("scheduled_end_ms", "_end"))
    return j.where(F.col("scheduled_start_ms") < F.col("_end")).select(
        "session_id", F.col("scheduled_start_ms").alias("start_ms"), end.alias("end_ms"), F.col("violation_type").alias("type"))


def script_labels(episodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """One label per session from its script; certain only if every cue was shown in time."""
    end_of = F.floor(F.col("duration_s") * 1000)
    j = sessions.join(episodes, "session_id", "left")
    kept = F.coalesce(F.col("scheduled_start_ms") < end_of, F.lit(False))
    cue = F.col("scheduled_start_ms").isNotNull()
    per = j.groupBy("session_id", "script_violation").agg(
        F.count(F.when(kept, 1)).alias("_kept"), F.count(F.when(cue & (~kept | F.col("shown_at_ms").isNull()), 1)).alias("_unshown"),
        F.array_sort(F.collect_set(F.when(kept, F.col("violation_type")))).alias("_types"))
    real = F.col("script_violation") & (F.col("_kept") > 0)
    return per.select(
        "session_id", real.alias("violation"),
        F.when(real, F.col("_types")).otherwise(F.array().cast("array<string>")).alias("violation_types"),
        F.when(F.col("script_violation"), F.col("_kept")).otherwise(F.lit(0)).cast("bigint").alias("n_intervals"),
        F.when(F.col("_unshown") == 0, "certain").otherwise("uncertain").alias("confidence"))


def affected_sessions(sessions: DataFrame, people: DataFrame) -> DataFrame:
    """Sessions in which any of ``people`` took part, as participant or helper."""
    who = people.select(F.col("id").alias("_p"))
    one = sessions.join(who, sessions["participant_id"] == who["_p"], "left_semi")
    two = sessions.join(who, sessions["helper_participant_id"] == who["_p"], "left_semi")
    return one.select("id").unionByName(two.select("id")).distinct()


def erase(tables: dict[str, DataFrame], affected: DataFrame) -> dict[str, DataFrame]:
    """Session tables without the rows of the affected sessions."""
    gone = affected.select(F.col("id").alias("session_id"))
    return {name: df.join(gone, "session_id", "left_anti") for name, df in tables.items()}


def erase_session_rows(sessions: DataFrame, affected: DataFrame) -> DataFrame:
    """Session rows stay as DELETED stubs."""
    hit = sessions.join(affected.withColumn("_gone", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("_gone"), "DELETED").otherwise(F.col("status"))).drop("_gone")


def redact_consents(consents: DataFrame, people: DataFrame, now: Column, reason: str) -> DataFrame:
    """Withdraw and redact the consents of ``people``; an earlier withdrawal keeps its time and reason."""
    hit = consents.join(people.select(F.col("id").alias("participant_id"), F.lit(True).alias("_w")), "participant_id", "left")
    first = F.col("_w") & F.col("withdrawn_at").isNull()
    return hit.select(
        *[c for c in consents.columns if c not in ("signed_name", "withdrawn_at", "withdrawal_reason")],
        F.when(F.col("_w"), F.lit("[redacted on withdrawal]")).otherwise(F.col("signed_name")).alias("signed_name"),
        F.when(first, F.lit(reason)).otherwise(F.col("withdrawal_reason")).alias("withdrawal_reason"),
        F.when(first, now).otherwise(F.col("withdrawn_at")).alias("withdrawn_at"))


def illegal_transitions(history: DataFrame, order: list[str]) -> DataFrame:
    """Status changes that the lifecycle does not allow, from the ordered statuses of each session."""
    edges = small_table(
        history.sparkSession, [{"from_status": a, "status": b, "_ok": True} for a, bs in R.TRANSITIONS.items() for b in bs],
        "from_status STRING, status STRING, _ok BOOLEAN")
    steps = Ordered(history, ["session_id"], [F.col(c) for c in order]).neighbours(prev={"from_status": F.col("status")})
    return steps.where("from_status IS NOT NULL").join(F.broadcast(edges), ["from_status", "status"], "left_anti")


def content_digest(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``by, rows, content_sha256``: a digest of the rows as a set with repeats, whatever their order, files and partitions.

    Every row's SHA-256 is cut into four numbers, and each is summed: sums merge in any order, and a changed, doubled or
    missing row changes them.  A row is its values in ``columns`` (all, by name), each with its length in front and null
    apart, so that no two different rows read alike.
    """
    by, names = by or [], sorted(columns or [c for c in df.columns if c not in (by or [])])
    text = lambda c: F.col(f"`{c}`").cast("string")
    cells = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in names]
    digest = F.sha2(F.concat_ws("|", *cells), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    summed = df.select(*by, *[p.alias(f"_p{i}") for i, p in enumerate(parts)]).groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum(f"_p{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"_p{i}") for i in range(4)])
    joined = F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(4)])
    return summed.select(*by, "rows", F.sha2(joined, 256).alias("content_sha256"))
