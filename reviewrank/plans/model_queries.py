"""Scoring, training and evaluation queries over sessions of the event table."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import features as FE
from reviewrank.operators import flags as L
from reviewrank.operators import governance as H
from reviewrank.operators import metrics as M
from reviewrank.operators import reporting as O
from reviewrank.operators import scoring as S
from reviewrank.operators import temporal as P
from reviewrank.operators import training as T
from reviewrank.plans.catalog import query, r6, sql_r6
from reviewrank.plans.feature_queries import NEEDED, event_grid, valid_events
from reviewrank.plans.grid_sql import SQL_GRID, col, rolling
from reviewrank.plans.timeline_queries import _sql_flags
from reviewrank.session import cut_lineage
from reviewrank.sources import bridge as B
from reviewrank.sources import sinks

_DIRECTIONS = {"face_area__mean": -1}
_MEANS = ["phone", "id_mismatch", "tab_hidden", "gaze_off", "face_area"]
_MEAN_SQL = ", ".join(f"coalesce(avg({s}), 0) AS {s}__mean" for s in _MEANS)


def _means(spark, sf_dir):
    grid = event_grid(spark, sf_dir)
    aggs = [a for n in _MEANS for a in FE.whole_aggs([n])]
    return grid.groupBy("session_id").agg(*aggs, *FE.unknown_aggs())


# ---- feature rows ----
@query(SQL_GRID + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, CAST(count(*) FILTER (WHERE coalesce(v, 0) <> 0) AS BIGINT) AS sessions_with_evidence FROM (SELECT session_id, "
    + "greatest(" + ", ".join(f"max(coalesce({col(s)}, 0))" for s in R.SIGNAL_NAMES if R.SIGNAL_CHANNEL[s] == c) + ", 0) AS v FROM grid GROUP BY 1)"
    for c in R.CHANNELS))
def feature_channels(spark, sf_dir):
    """Sessions in which any maximum feature of a channel is above zero, by the feature-to-channel map."""
    wide = event_grid(spark, sf_dir).groupBy("session_id").agg(*[a for a in FE.whole_aggs()])
    tops = [f"{s}__max" for s in R.SIGNAL_NAMES]
    cells = F.array(*[F.struct(F.lit(R.feature_channels(f)[0]).alias("channel"), (F.col(f) != 0).alias("on")) for f in tops])
    per = wide.select("session_id", F.explode(cells).alias("x")).groupBy("session_id", "x.channel").agg(F.max(F.col("x.on").cast("int")).alias("on"))
    return per.groupBy("channel").agg(F.sum("on").alias("sessions_with_evidence"))


@query(SQL_GRID + """ SELECT session_id, CASE WHEN count(luma) > 0 THEN round(avg(luma), 9) + 0.0 ELSE 0.0 END AS q_luma_mean,
  CASE WHEN count(face_area) > 0 THEN round(avg(face_area), 9) + 0.0 ELSE 1e6 END AS face_area__mean, CASE WHEN count(vad) > 0 THEN round(avg(vad), 9) + 0.0 ELSE 1.0 END AS unk_audio_voice FROM grid GROUP BY 1""")
def prepare_features(spark, sf_dir):
    """Unknown averages replaced by the value that can only lower risk."""
    raw = event_grid(spark, sf_dir).groupBy("session_id").agg(
        F.avg("luma").alias("q_luma_mean"), F.avg("face_area").alias("face_area__mean"), F.avg("vad").alias("unk_audio_voice"))
    names = ["q_luma_mean", "face_area__mean", "unk_audio_voice"]
    return S.prepare_features(raw, names, _DIRECTIONS).select(
        "session_id", *[F.round(n, 9).alias(n) for n in names])


@query(f"{SQL_GRID} SELECT session_id, round(avg(coalesce(id_mismatch, NULL)), 6) + 0.0 AS id_mismatch__mean, 0.0::DOUBLE AS tab_hidden__mean, 1e6::DOUBLE AS face_area__mean, "
       "1.0::DOUBLE AS unk_screen, 1.0::DOUBLE AS unk_presence, round(1 - avg(CAST(obs_device AS INT)), 6) + 0.0 AS unk_device FROM grid GROUP BY 1")
def mask_channels(spark, sf_dir):
    grid = event_grid(spark, sf_dir)
    raw = grid.groupBy("session_id").agg(F.avg("id_mismatch").alias("id_mismatch__mean"), F.avg("tab_hidden").alias("tab_hidden__mean"),
                                         F.avg("face_area").alias("face_area__mean"), *FE.unknown_aggs())
    names = ["id_mismatch__mean", "tab_hidden__mean", "face_area__mean", "unk_screen", "unk_presence", "unk_device"]
    return S.mask_channels(raw, names, ["screen", "presence"], _DIRECTIONS).select("session_id", *[r6(n).alias(n) for n in names])


@query(SQL_GRID + " SELECT session_id, concat_ws(',', " + ", ".join(f"CASE WHEN 1 - avg(CAST(obs_{c} AS INT)) >= 0.95 THEN '{c}' END" for c in R.CHANNELS)
       + ") AS missing, concat_ws(',', " + ", ".join(f"CASE WHEN 1 - avg(CAST(obs_{c} AS INT)) < 0.95 THEN '{c}' END" for c in R.CHANNELS) + ") AS available FROM grid GROUP BY 1")
def channels_missing(spark, sf_dir):
    wide = event_grid(spark, sf_dir).groupBy("session_id").agg(*FE.unknown_aggs())
    available, missing = S.missing_channels()
    return wide.select("session_id", F.array_join(missing, ",").alias("missing"), F.array_join(available, ",").alias("available"))


_TIERS = {"ROUTINE_REVIEW": 0.2, "HUMAN_REVIEW": 0.5, "PRIORITY_REVIEW": 0.7}


@query(f"WITH {B.SQL_OPS} SELECT session_id, CASE WHEN risk >= 0.7 THEN 'PRIORITY_REVIEW' WHEN risk >= 0.5 THEN 'HUMAN_REVIEW' WHEN risk >= 0.2 THEN 'ROUTINE_REVIEW' ELSE 'NO_ACTION' END AS recommendation FROM predictions")
def tiering(spark, sf_dir):
    return B.predictions(spark, sf_dir).select("session_id", S.recommendation(F.col("risk"), _TIERS).alias("recommendation"))


_PHRASE = {s: R.PHRASES[s].replace("'", "''") for s in _MEANS}


@query(SQL_GRID + f", m AS (SELECT session_id, {_MEAN_SQL} FROM grid GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT session_id, '{s}__mean' AS feature, CASE WHEN {s}__mean > 0 THEN 'Raised the score: {_PHRASE[s]}.' ELSE 'Lowered the score: little evidence that {_PHRASE[s]}.' END AS explanation FROM m" for s in _MEANS))
def reasons(spark, sf_dir):
    rows = _means(spark, sf_dir)
    cells = F.array(*[F.struct(
        F.lit(f"{s}__mean").alias("feature"),
        S.reason(f"{s}__mean", F.col(f"{s}__mean") > 0).alias("explanation")) for s in _MEANS])
    return rows.select("session_id", F.explode(cells).alias("x")).select("session_id", "x.*")


_RULE_SIGNALS = ["phone", "multi_face", "extra_person", "id_mismatch", "tab_hidden", "foreign", "paper", "gaze_off"]


def _rule_frame(spark, sf_dir):
    """Only the features the baseline reads."""
    grid = FE.with_paste_after_return(event_grid(spark, sf_dir))
    names = {10: ["phone", "multi_face", "extra_person"], 60: ["foreign", "paper"]}
    rolled = FE.with_rolling(grid, names)
    tops = [F.coalesce(F.max(f"{n}__r{w}"), F.lit(0.0)).alias(f"{n}__w{w}_max") for w, ns in names.items() for n in ns]
    means = [F.coalesce(F.avg(n), F.lit(0.0)).alias(f"{n}__mean") for n in ("id_mismatch", "tab_hidden", "gaze_off")]
    return rolled.groupBy("session_id").agg(*tops, *means, F.sum("_returned").cast("double").alias("x_paste_after_tab_return"))


_RULE_SQL = SQL_GRID + ", rl AS (SELECT *, " + ", ".join(
    f"{rolling(col(n), w)} AS {n}_r{w}" for w, ns in {10: ["phone", "multi_face", "extra_person"], 60: ["foreign", "paper"]}.items() for n in ns) + """,
  lag(coalesce(tab_hidden, 0) > 0.5, 1, false) OVER (PARTITION BY session_id ORDER BY sec) AND NOT coalesce(tab_hidden, 0) > 0.5 AS back,
  max(CAST(coalesce(paste_chars, 0) > 0 AS INT)) OVER (PARTITION BY session_id ORDER BY sec ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING) AS soon FROM grid),
rf AS (SELECT session_id, """ + ", ".join(
    f"coalesce(max({n}_r{w}), 0) AS {n}__w{w}_max" for w, ns in {10: ["phone", "multi_face", "extra_person"], 60: ["foreign", "paper"]}.items() for n in ns) + """,
  coalesce(avg(id_mismatch), 0) AS id_mismatch__mean, coalesce(avg(tab_hidden), 0) AS tab_hidden__mean, coalesce(avg(gaze_off), 0) AS gaze_off__mean,
  CAST(count(*) FILTER (WHERE back AND soon = 1) AS DOUBLE) AS x_paste_after_tab_return FROM rl GROUP BY session_id)"""
_RULE_SUM = " + ".join(f"{w} * {f}" for f, w in R.RULE_WEIGHTS.items())


@query(f"{_RULE_SQL} SELECT session_id, {sql_r6(f'1 / (1 + exp(-({R.RULE_BIAS} + {_RULE_SUM})))', 'score')} FROM rf")
def rule_score(spark, sf_dir):
    return _rule_frame(spark, sf_dir).select("session_id", r6(S.rule_score()).alias("score"))


_SAID = {f: R.PHRASES[f if f in R.PHRASES else f.split("__")[0]].replace("'", "''") for f in R.RULE_WEIGHTS}
_RULE_LONG = " UNION ALL ".join(
    f"SELECT session_id, {i} AS i, '{f}' AS feature, {w} * {f} AS v, CASE WHEN {w} * {f} > 0 THEN 'Raised the score: {_SAID[f]}.' "
    f"ELSE 'Lowered the score: little evidence that {_SAID[f]}.' END AS explanation FROM rf" for i, (f, w) in enumerate(R.RULE_WEIGHTS.items()))


@query(f"""{_RULE_SQL}, lg AS ({_RULE_LONG}), d AS (SELECT *, row_number() OVER (PARTITION BY session_id, explanation ORDER BY abs(v) DESC, i) AS dup FROM lg),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY abs(v) DESC, i) AS rank FROM d WHERE dup = 1)
SELECT session_id, CAST(rank AS BIGINT) AS rank, feature, CASE WHEN v > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction, explanation FROM t WHERE rank <= 5""")
def top_reasons(spark, sf_dir):
    """The five strongest parts of the baseline score with distinct sentences."""
    parts = {f: F.col(f) * w for f, w in R.RULE_WEIGHTS.items()}
    rows = _rule_frame(spark, sf_dir).select("session_id", F.posexplode(S.top_reasons(parts)).alias("i", "x"))
    return rows.select("session_id", (F.col("i") + 1).cast("bigint").alias("rank"), "x.feature", "x.direction", "x.explanation")


def _broken_assessments(spark, sf_dir):
    m = F.col("o_orderkey") % 11
    p = B.table(spark, sf_dir, "orders")
    risk = F.col("o_totalprice") / 600000.0
    flag = F.struct(
        F.when(m == 6, F.lit(None)).otherwise(F.lit("flg_001")).alias("flag_id"), F.lit("PHONE_USE").alias("type"), F.lit(5000).cast("bigint").alias("t_start_ms"),
        F.when(m == 7, 1000).otherwise(9000).cast("bigint").alias("t_end_ms"), F.lit(0.5).alias("confidence"), F.lit("x").alias("explanation"))
    return p.select(
        "o_orderkey", F.when(m == 1, "v0").otherwise(R.RISK_SCHEMA).alias("schema"), F.concat(F.lit("ses"), F.col("o_orderkey").cast("string")).alias("session_id"),
        F.when(m == 2, 1.5).otherwise(risk).alias("overall_risk"), F.when(m == 3, "VIOLATION").otherwise("HUMAN_REVIEW").alias("recommendation"),
        F.when(m == 4, F.array(F.lit(0.9), F.lit(0.1))).when(m == 5, F.array(F.lit(0.9))).otherwise(F.array(F.lit(0.1), F.lit(0.9))).alias("confidence_band"),
        F.array(flag).alias("flags"), F.when(m == 8, F.array(F.lit("gps"))).otherwise(F.array(F.lit("screen"))).alias("channels_available"),
        F.array(F.lit("pose")).alias("channels_missing"), F.when(m == 9, "").otherwise("m1").alias("model_version"), F.lit(R.FEATURE_VERSION).alias("feature_version"))


@query("""SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN 'schema must be ''risk_assessment.v1''' WHEN 2 THEN 'overall_risk must be in [0, 1]'
  WHEN 3 THEN 'recommendation must be one of [''NO_ACTION'', ''ROUTINE_REVIEW'', ''HUMAN_REVIEW'', ''PRIORITY_REVIEW'']' WHEN 4 THEN 'confidence_band must satisfy 0 <= low <= high <= 1'
  WHEN 5 THEN 'confidence_band must be [low, high]' WHEN 6 THEN 'flags[0].flag_id missing' WHEN 7 THEN 'flags[0] ends before it starts'
  WHEN 8 THEN 'channels_available must list known channels' WHEN 9 THEN 'model_version must be a non-empty string' ELSE '' END AS errors FROM orders""")
def validate_assessment(spark, sf_dir):
    return _broken_assessments(spark, sf_dir).select("o_orderkey", F.array_join(S.assessment_errors(), "; ").alias("errors"))


@query(f"WITH {B.SQL_OPS} SELECT recommendation, CAST(count(*) AS BIGINT) AS scored FROM predictions GROUP BY 1")
def batch_summary(spark, sf_dir):
    """Write scored sessions as JSON lines and summarise the file."""
    path = sinks.new_folder(spark, "assessments")
    sinks.write_assessments(B.predictions(spark, sf_dir), path)
    return S.summary(spark.read.schema("session_id STRING, recommendation STRING").json(path))


# ---- the learned model ----
_MEMO: dict = {}


def _once(spark, sf_dir, what, make):
    """Training inputs are materialised once per application and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def training_rows(spark, sf_dir):
    """Feature rows with a label from outside the features (the user's account is overdrawn) and a stratified split."""

    def make():
        feats = FE.session_features(event_grid(spark, sf_dir), needed=NEEDED)
        accounts = B.table(spark, sf_dir, "customer").select(
            F.concat(F.lit("usr"), F.col("c_custkey").cast("string")).alias("session_id"), (F.col("c_acctbal") < 0).cast("int").alias("y"))
        rows = cut_lineage(feats.join(accounts, "session_id", "left").withColumn("y", F.coalesce("y", F.lit(0))))
        units = rows.select("session_id", F.col("session_id").alias("unit"), (F.col("y") == 1).alias("violation"), F.lit("all").alias("profile"))
        return cut_lineage(rows.join(H.stratified_split(units, 11), "session_id"))

    return _once(spark, sf_dir, "rows", make)


def trained(spark, sf_dir) -> S.RiskModel:
    return _once(spark, sf_dir, "model", lambda: T.train(training_rows(spark, sf_dir), R.model_features()))


@query()
def risk_model(spark, sf_dir):
    """Validation metrics of the trained model at its operating point."""
    model = trained(spark, sf_dir)
    rows = S.score(training_rows(spark, sf_dir).where("split = 'validation'"), model)
    return M.summary(rows.select("y", "p"), model.tiers["HUMAN_REVIEW"])


@query()
def contributions(spark, sf_dir):
    model = trained(spark, sf_dir)
    ready, parts = S.with_contributions(S.ready(training_rows(spark, sf_dir), model), model)
    return ready.select("session_id", F.explode(S.top_reasons(parts)).alias("x")).select("session_id", "x.*")


@query()
def calibration_fit(spark, sf_dir):
    """The calibrated scores of the calibration split next to the raw ones."""
    model = trained(spark, sf_dir)
    rows = training_rows(spark, sf_dir).where("split = 'calibration'")
    return S.score(rows, model).select("session_id", "y", "raw", "p")


@query()
def confidence_band(spark, sf_dir):
    from reviewrank.operators.intervals import interpolate

    model = trained(spark, sf_dir)
    scored = S.score(training_rows(spark, sf_dir), model).select("session_id", "p")
    return interpolate(scored, "p", model.calibration_x, {"low": model.band_lo, "high": model.band_hi})


@query()
def assessment(spark, sf_dir):
    """Full assessments with flags, reasons and channels of every session."""
    grid = event_grid(spark, sf_dir)
    return S.assessments(training_rows(spark, sf_dir), L.flags(grid, B.STEP_MS), trained(spark, sf_dir))


@query()
def score_store(spark, sf_dir):
    """Score a written feature store without its holdout and upsert the predictions."""
    from reviewrank.operators.tables import upsert

    path = sinks.new_folder(spark, "features")
    rows = training_rows(spark, sf_dir)
    sinks.write_store_table(rows.drop("split"), path)
    model = trained(spark, sf_dir)
    scored = S.score(H.without_holdout(spark.read.parquet(path), rows.select("session_id", "split")), model)
    fresh = scored.select("session_id", F.lit(model.model_version).alias("model_version"), F.col("p").alias("risk"),
                          S.recommendation(F.col("p"), model.tiers).alias("recommendation"), F.lit(2).alias("at"))
    old = fresh.withColumn("risk", F.lit(0.0)).withColumn("at", F.lit(1))
    return upsert(old, fresh, ["session_id", "model_version"], ["at"])


@query()
def missing_channel(spark, sf_dir):
    return T.missing_channel_test(training_rows(spark, sf_dir), trained(spark, sf_dir))


@query()
def interpretation(spark, sf_dir):
    """Most important features, and the partial dependence of the ten most important."""
    model, rows = trained(spark, sf_dir), training_rows(spark, sf_dir)
    imp = T.importance(rows, model)
    out = imp.select(F.lit("importance").alias("part"), "feature", F.lit(None).cast("double").alias("at"), F.col("mean_abs").alias("value"))
    for r in imp.select("feature").limit(10).collect():
        swept = T.partial_dependence(rows, model, r["feature"])
        out = out.unionByName(swept.select(F.lit("partial_dependence").alias("part"), "feature", F.col("value").alias("at"), F.col("mean_risk").alias("value")))
    return out


@query()
def ablations(spark, sf_dir):
    """Every channel, normalisation and the window sets."""
    return T.ablations(training_rows(spark, sf_dir), R.model_features(), windows=True)


@query()
def mitigation(spark, sf_dir):
    rows = _sliced(spark, sf_dir)
    return T.mitigation(rows, R.model_features(), ["lighting", "webcam_class"], ["lighting", "webcam_class"])


def _bins(spark, sf_dir):
    return P.binned(event_grid(spark, sf_dir))


def _sql_bins() -> str:
    cells = []
    for s, _, kind, thr in R.SIGNALS:
        scale = 1.0 if kind == "binary" else 2 * thr
        cells.append(sql_r6(f"sum(greatest(0, least(3, coalesce({col(s)}, 0) / {scale}::DOUBLE))) / 10", s))
    return f"{SQL_GRID} SELECT session_id, CAST(sec // 10 AS BIGINT) AS bin, {', '.join(cells)} FROM grid GROUP BY 1, 2"


@query(_sql_bins())
def bin_series(spark, sf_dir):
    out = P.binned(event_grid(spark, sf_dir))
    return out.select("session_id", "bin", *[r6(s).alias(s) for s in R.SIGNAL_NAMES])


@query()
def kernel_features(spark, sf_dir):
    return P.kernel_features(_bins(spark, sf_dir))


@query()
def temporal_model(spark, sf_dir):
    """Scored sessions of the temporal model, with the run logged."""
    t0 = time.time()
    rows = training_rows(spark, sf_dir).select("session_id", "y", "split")
    made = cut_lineage(P.kernel_features(_bins(spark, sf_dir)))
    scored, trials = T.fit_temporal(made.join(rows, "session_id"))
    T.log_run(spark, sinks.new_folder(spark, "runs"), "temporal", {"kernels": R.N_KERNELS}, {"trials": trials}, t0)
    return scored


@query()
def run_log(spark, sf_dir):
    """Train the baseline's threshold and log it."""
    t0 = time.time()
    # the metrics read these rows three times, and each would make the grid and its windows anew
    scored = cut_lineage(_rule_frame(spark, sf_dir).select("session_id", S.rule_score().alias("p")).join(
        training_rows(spark, sf_dir).select("session_id", "y"), "session_id"))
    head = M.summary(scored, 0.05).first().asDict()
    path = sinks.new_folder(spark, "runs")
    T.log_run(spark, path, "rule-baseline", {"bias": R.RULE_BIAS, "weights": R.RULE_WEIGHTS}, head, t0)
    return spark.read.schema("run_id STRING, name STRING, params STRING, metrics STRING, seconds DOUBLE").json(path)


def _sliced(spark, sf_dir):
    return training_rows(spark, sf_dir).withColumn("lighting", F.when(F.col("q_luma_mean") > 90, "bright").otherwise("dim")).withColumn(
        "webcam_class", F.when(F.col("face_area__mean") > 0.03, "hd").otherwise("sd"))


@query()
def evaluation_report(spark, sf_dir):
    """The whole evaluation bundle of the model on the validation split, as rows."""
    model, rows = trained(spark, sf_dir), _sliced(spark, sf_dir)
    part = lambda name: cut_lineage(S.score(rows.where(F.col("split") == name), model).select("session_id", "y", "p", "lighting", "webcam_class"))
    more = {"missing channel": (T.missing_channel_test(rows.where("split = 'validation'"), model), ["channel"]), "importance": (T.importance(rows, model), ["feature"])}
    return O.evaluation(part("validation"), part("calibration"), model.tiers["HUMAN_REVIEW"], ["lighting", "webcam_class"], "lighting", more)


@query()
def model_drift(spark, sf_dir):
    """Batches of all sessions against those of the validation split, by the ten features that matter most."""
    rows = _sliced(spark, sf_dir)
    out = O.model_drift(rows.where("split = 'validation'"), rows, trained(spark, sf_dir), ["session_id"], "lighting", 50)
    return out.drop("psi_by_feature", "slice_fpr", "alerts")


@query(f"""WITH {B.SQL_EVENTS} SELECT sha256('{R.FEATURE_VERSION}|' || '{'|'.join(R.feature_names())}') AS schema_hash, CAST({len(R.feature_names())} AS BIGINT) AS n_features,
  CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions FROM valid""")
def feature_schema_hash(spark, sf_dir):
    """Store manifest: the hash that pins the ordered feature columns, and the sessions covered."""
    columns = [c for c in FE.session_features(event_grid(spark, sf_dir), needed=NEEDED).columns if c != "session_id"]
    text = F.concat_ws("|", F.lit(R.FEATURE_VERSION), *[F.lit(c) for c in columns])
    return valid_events(spark, sf_dir).agg(
        F.sha2(F.first(text), 256).alias("schema_hash"), F.lit(len(columns)).cast("bigint").alias("n_features"), F.countDistinct("session_id").alias("n_sessions"))


@query(f"""SELECT 'features' AS "table", CAST(count(*) AS BIGINT) AS n FROM ({SQL_GRID} SELECT session_id FROM sess)
UNION ALL SELECT 'flags', CAST(count(*) AS BIGINT) FROM ({_sql_flags()})""")
def feature_store_write(spark, sf_dir):
    """Features and flags as zstd Parquet, read back and counted."""
    base = sinks.new_folder(spark, "store")
    grid = event_grid(spark, sf_dir)
    sinks.write_store_table(FE.session_features(grid, needed=NEEDED), f"{base}/features")
    sinks.write_store_table(L.flags(grid, B.STEP_MS), f"{base}/flags")
    from reviewrank.operators.listing import row_counts

    return row_counts({n: spark.read.parquet(f"{base}/{n}") for n in ("features", "flags")})
