"""Operational and governance queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.operators import governance as H
from reviewrank.operators import intervals as X
from reviewrank.operators import listing as O
from reviewrank.operators import tables as U
from reviewrank.plans.catalog import query, r6, sql_r6
from reviewrank.plans.feature_queries import event_grid, valid_events
from reviewrank.plans.grid_sql import SQL_GRID, col
from reviewrank.sources import bridge as B
from reviewrank.sources import sinks

_O = f"WITH {B.SQL_OPS}"
STEP = B.STEP_MS


def _all(spark, sf_dir):
    return (B.sessions(spark, sf_dir), B.participants(spark, sf_dir), B.session_labels(spark, sf_dir),
            B.session_splits(spark, sf_dir), B.predictions(spark, sf_dir))


_LISTED = f"""{_O}, j AS (SELECT s.*, c.c_name AS participant_code, l.violation, sp.split, p.risk, p.recommendation,
  coalesce(s.source = 'SIMULATED' AND sp.split = 'holdout', false) AS seal FROM sessions s LEFT JOIN customer c ON c.c_custkey = s.participant_id
  LEFT JOIN labels_ l ON l.session_id = s.id LEFT JOIN splits sp ON sp.session_id = s.id LEFT JOIN predictions p ON p.session_id = s.id)"""
_SHOWN = ["id", "status", "participant_code", "split", "violation_label", "risk", "recommendation"]
_MASKED = """SELECT id, status, participant_code, split, CASE WHEN NOT seal THEN violation END AS violation_label, CASE WHEN NOT seal THEN risk END AS risk,
  CASE WHEN NOT seal THEN recommendation END AS recommendation FROM j"""


@query(f"{_LISTED} {_MASKED} WHERE source = 'SIMULATED' AND status <> 'DELETED' ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def session_list(spark, sf_dir):
    return O.session_list(*_all(spark, sf_dir), source="SIMULATED", limit=50, offset=20).select(*_SHOWN)


@query(f"{_LISTED} {_MASKED} WHERE status <> 'DELETED' AND violation AND split <> 'holdout' AND recommendation = 'HUMAN_REVIEW' AND (id ILIKE '%7%' OR participant_code ILIKE '%7%') ORDER BY created_at DESC, id LIMIT 100")
def session_search(spark, sf_dir):
    return O.session_list(*_all(spark, sf_dir), violation=True, recommendation="HUMAN_REVIEW", q=" 7 ", limit=100).select(*_SHOWN)


@query(f"{_LISTED} SELECT id, split, CASE WHEN NOT seal THEN violation END AS violation, CASE WHEN NOT seal THEN risk END AS risk FROM j")
def sealed_mask(spark, sf_dir):
    s, _, labels, splits, preds = _all(spark, sf_dir)
    j = s.join(labels.withColumnRenamed("session_id", "id"), "id", "left").join(splits.withColumnRenamed("session_id", "id"), "id", "left")
    j = j.join(preds.withColumnRenamed("session_id", "id"), "id", "left")
    return O.mask_sealed(j, ["violation", "risk"]).select("id", "split", "violation", "risk")


_QUEUE = f"""{_O}, q AS (SELECT p.session_id, p.risk, p.recommendation, s.source, s.status, c.c_name AS participant_code FROM predictions p
  JOIN sessions s ON s.id = p.session_id LEFT JOIN customer c ON c.c_custkey = s.participant_id
  WHERE p.recommendation IN ('HUMAN_REVIEW', 'PRIORITY_REVIEW') AND s.status <> 'DELETED' AND p.session_id NOT IN (SELECT session_id FROM verdicts))"""


@query(f"{_QUEUE} SELECT session_id, risk, recommendation, source, status, participant_code FROM q ORDER BY risk DESC, session_id LIMIT 50 OFFSET 5")
def review_queue(spark, sf_dir):
    s, people, _, _, preds = _all(spark, sf_dir)
    rows = O.queue_rows(preds, s, people, B.verdicts(spark, sf_dir))
    return O.review_queue(rows, 50, 5).select("session_id", "risk", "recommendation", "source", "status", "participant_code")


@query(f"{_QUEUE} SELECT recommendation, CAST(count(*) AS BIGINT) AS waiting FROM q GROUP BY 1")
def review_queue_counts(spark, sf_dir):
    s, people, _, _, preds = _all(spark, sf_dir)
    rows = O.queue_rows(preds, s, people, B.verdicts(spark, sf_dir))
    return rows.groupBy("recommendation").agg(F.count("*").alias("waiting"))


@query(f"""{_O} SELECT CAST(count(*) AS BIGINT) AS reviews, CAST(count(*) FILTER (WHERE verdict = 'NO_CONCERN') AS BIGINT) AS no_concern,
  CAST(count(*) FILTER (WHERE verdict = 'CONCERN_CONFIRMED') AS BIGINT) AS concern_confirmed, CAST(count(*) FILTER (WHERE verdict = 'INCONCLUSIVE') AS BIGINT) AS inconclusive,
  CAST(count(*) FILTER (WHERE verdict = 'CONCERN_CONFIRMED' AND coalesce(l.violation, false)) AS BIGINT) AS confirmed_matching_ground_truth,
  {sql_r6("count(*) FILTER (WHERE verdict = 'NO_CONCERN') / count(*)", "overturn_rate")} FROM verdicts v LEFT JOIN labels_ l ON l.session_id = v.session_id""")
def reviews_summary(spark, sf_dir):
    return O.reviews_summary(B.verdicts(spark, sf_dir), B.session_labels(spark, sf_dir)).withColumn("overturn_rate", r6("overturn_rate"))


@query(f"""{_O} SELECT s.id, {sql_r6('s.duration_s', 'duration_s')}, l.violation FROM sessions s JOIN labels_ l ON l.session_id = s.id
  WHERE source = 'MOCK' AND NOT is_rehearsal AND status IN ('COMPLETED', 'REVIEWED')""")
def mock_corpus(spark, sf_dir):
    s = B.sessions(spark, sf_dir).where("source = 'MOCK' AND NOT is_rehearsal AND status IN ('COMPLETED', 'REVIEWED')")
    return s.join(B.session_labels(spark, sf_dir).withColumnRenamed("session_id", "id"), "id").select("id", r6("duration_s").alias("duration_s"), "violation")


_ELIGIBLE = f"{_O}, el AS (SELECT * FROM sessions WHERE source = 'MOCK' AND NOT is_rehearsal AND status IN ('UPLOADED', 'PROCESSING', 'ANALYZING', 'COMPLETED', 'REVIEWED') AND duration_s >= 1200)"


@query(f"{_ELIGIBLE} SELECT id, lighting, webcam_class FROM el")
def eligible_sessions(spark, sf_dir):
    return O.eligible(B.sessions(spark, sf_dir)).select("id", "lighting", "webcam_class")


@query(f"{_ELIGIBLE} SELECT k.lighting, " + ", ".join(f"CAST(count(*) FILTER (WHERE webcam_class = '{w}') AS BIGINT) AS {w}" for w in ("hd", "sd", "low"))
       + " FROM (SELECT unnest(['bright', 'normal', 'dim']) AS lighting) k LEFT JOIN el ON el.lighting = k.lighting GROUP BY k.lighting")
def coverage_grid(spark, sf_dir):
    return O.coverage_grid(O.eligible(B.sessions(spark, sf_dir)))


@query(f"""{_ELIGIBLE} SELECT CAST(count(*) AS BIGINT) AS eligible_sessions, CAST(count(DISTINCT lighting) AS BIGINT) AS lightings, CAST(count(DISTINCT webcam_class) AS BIGINT) AS webcams,
  CAST(count(DISTINCT participant_id) AS BIGINT) AS participants_recorded, count(*) >= 60 AND count(DISTINCT lighting) >= 3 AND count(DISTINCT webcam_class) >= 2 AS met FROM el""")
def coverage_summary(spark, sf_dir):
    return O.coverage_summary(O.eligible(B.sessions(spark, sf_dir)))


@query(f"""{_O} SELECT c.c_custkey AS participant_id, CAST((SELECT count(*) FROM sessions s WHERE s.participant_id = c.c_custkey AND s.status <> 'DELETED')
  + (SELECT count(*) FROM sessions s WHERE s.helper_participant_id = c.c_custkey AND s.status <> 'DELETED' AND s.participant_id <> c.c_custkey) AS BIGINT) AS session_count FROM customer c""")
def participant_sessions(spark, sf_dir):
    counts = O.participant_sessions(B.sessions(spark, sf_dir))
    people = B.participants(spark, sf_dir).select(F.col("id").alias("participant_id"))
    return people.join(counts, "participant_id", "left").withColumn("session_count", F.coalesce("session_count", F.lit(0).cast("bigint")))


@query(f"""{_O}, f AS (SELECT 'ses' || l_orderkey AS session_id, count(*) AS n_items, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY 1)
SELECT f.session_id, CAST(n_items AS BIGINT) AS n_items, {sql_r6('mean_price', 'mean_price')}, sp.split, l.violation FROM f JOIN labels_ l USING (session_id) JOIN splits sp USING (session_id) WHERE sp.split <> 'holdout'""")
def training_frame(spark, sf_dir):
    """Features with label and split, never the holdout."""
    feats = B.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("ses"), F.col("l_orderkey").cast("string")).alias("session_id")).agg(
        F.count("*").alias("n_items"), r6(F.avg("l_extendedprice")).alias("mean_price"))
    splits = B.session_splits(spark, sf_dir).where("split <> 'holdout'")
    return feats.join(B.session_labels(spark, sf_dir), "session_id").join(splits, "session_id")


@query(f"{_O} SELECT p.session_id, p.risk FROM predictions p WHERE p.session_id NOT IN (SELECT session_id FROM splits WHERE split = 'holdout')")
def score_non_holdout(spark, sf_dir):
    return H.without_holdout(B.predictions(spark, sf_dir), B.session_splits(spark, sf_dir)).select("session_id", "risk")


@query(f"{_O} SELECT source, status, CAST(count(*) AS BIGINT) AS n FROM sessions GROUP BY ALL UNION ALL SELECT 'table', t, n FROM "
       "(SELECT 'sessions' AS t, count(*) AS n FROM sessions UNION ALL SELECT 'labels', count(*) FROM labels_ UNION ALL SELECT 'verdicts', count(*) FROM verdicts)")
def overview_counts(spark, sf_dir):
    s = B.sessions(spark, sf_dir)
    tables = {"sessions": s, "labels": B.session_labels(spark, sf_dir), "verdicts": B.verdicts(spark, sf_dir)}
    counted = O.row_counts(tables).select(F.lit("table").alias("source"), F.col("table").alias("status"), "n")
    return O.status_counts(s).unionByName(counted)


@query(f"""{_O}, lb AS (SELECT * FROM sessions s JOIN labels_ l ON l.session_id = s.id) """ + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {f} AS value, CAST(count(*) AS BIGINT) AS sessions, {sql_r6('avg(CAST(violation AS INT))', 'positive_rate')} FROM lb GROUP BY {f}" for f in O.FACTORS))
def factor_breakdown(spark, sf_dir):
    return O.factor_breakdown(B.sessions(spark, sf_dir), B.session_labels(spark, sf_dir)).withColumn("positive_rate", r6("positive_rate"))


@query(f"""{_O} SELECT sp.split, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE violation) AS BIGINT) AS violating, CAST(count(*) FILTER (WHERE NOT violation) AS BIGINT) AS clean,
  {sql_r6('avg(CAST(violation AS INT))', 'positive_rate')} FROM splits sp JOIN labels_ l USING (session_id) GROUP BY 1""")
def split_manifest(spark, sf_dir):
    both = B.session_splits(spark, sf_dir).join(B.session_labels(spark, sf_dir), "session_id")
    return H.split_manifest(both).withColumn("positive_rate", r6("positive_rate"))


@query(f"(SELECT 'session' AS what, concat('ses', o_orderkey) AS id FROM orders WHERE o_orderkey % 4 = 0 ORDER BY o_orderdate DESC, id LIMIT 6) UNION ALL "
       "(SELECT 'audit', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 8)")
def recent_activity(spark, sf_dir):
    """The newest mock sessions and audit rows."""
    mock = B.sessions(spark, sf_dir).where("source = 'MOCK'")
    newest = O.page(mock, [F.col("created_at").desc(), F.col("id")], 6).select(F.lit("session").alias("what"), "id")
    audit = B.table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = O.page(audit, [F.col("event_id").desc()], 8).select(F.lit("audit").alias("what"), F.col("event_id").cast("string").alias("id"))
    return newest.unionByName(rows)


@query("SELECT o_custkey AS participant_id, o_orderkey AS latest_order, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("participant_id"), "o_orderdate", F.col("o_orderkey").alias("latest_order"), F.col("o_totalprice").alias("price"))
    return O.latest(orders, ["participant_id"], ["o_orderdate", "latest_order"], ["latest_order", "price"])


@query(f"WITH {B.SQL_EVENTS} SELECT event_seq, ts_ms, event_type FROM valid WHERE session_id = 'usr3' AND channel = 'screen' ORDER BY ts_ms, event_seq LIMIT 20")
def events_page(spark, sf_dir):
    rows = valid_events(spark, sf_dir).where("session_id = 'usr3' AND channel = 'screen'")
    return O.page(rows, [F.col("ts_ms"), F.col("event_seq")], 20).select("event_seq", "ts_ms", "event_type")


@query("""WITH m AS (SELECT n.n_nationkey, count(c.c_custkey) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_nationkey % 2 = 0 GROUP BY 1),
a AS (SELECT s_nationkey, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1),
l AS (SELECT s_nationkey, CASE WHEN a = b THEN 1 ELSE 2 END AS n, CASE WHEN a = b THEN '1:' || a ELSE '1:' || a || ',2:' || b END AS t FROM a)
SELECT n_name AS dataset_version, CAST(m.n AS BIGINT) AS n_sessions, CAST(coalesce(l.n, 0) AS BIGINT) AS n_accesses, l.t AS log FROM nation LEFT JOIN m USING (n_nationkey) LEFT JOIN l ON l.s_nationkey = nation.n_nationkey""")
def dataset_catalog(spark, sf_dir):
    """Nations as dataset versions: a manifest for some of them, the first and last supplier as accesses."""
    nation = B.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("dataset_version"))
    names = F.broadcast(nation)  # 25 rows
    manifests = B.table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("n_sessions")).join(names, "n_nationkey").select("dataset_version", "n_sessions")
    ends = B.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"))
    log = ends.join(names, "n_nationkey").select("dataset_version", F.posexplode(F.array_distinct(F.array("a", "b"))).alias("i", "who")).select(
        "dataset_version", (F.col("i") + 1).alias("access_no"), F.col("who").cast("string").alias("purpose"))
    out = O.dataset_catalog(nation.select("dataset_version"), manifests, log)
    text = F.array_join(F.transform("holdout_accesses", lambda x: F.concat(x["access_no"].cast("string"), F.lit(":"), x["purpose"])), ",")
    return out.select("dataset_version", "n_sessions", "n_accesses", text.alias("log"))


@query("SELECT 'ses' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def register_dataset(spark, sf_dir):
    """Registering all sessions again adds only the unknown ones."""
    s = B.sessions(spark, sf_dir)
    known = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("ses"), F.col("o_orderkey").cast("string")).alias("id"))
    return U.insert_new(known, s.unionByName(s), ["id"]).select("id")


@query(f"""{_O}, u AS (SELECT session_id, model_version, risk, 0 AS at_ FROM predictions UNION ALL SELECT 'ses' || l_orderkey, 'm1', round(l_discount, 4), l_partkey * 1000 + l_linenumber AS at_ FROM lineitem)
SELECT session_id, model_version, arg_max(risk, {{'a': at_, 'r': risk}}) AS risk FROM u GROUP BY ALL""")
def upsert_predictions(spark, sf_dir):
    """Stored predictions updated by a stream of newer ones."""
    stored = B.predictions(spark, sf_dir).select("session_id", "model_version", "risk", F.lit(0).cast("bigint").alias("at"))
    new = B.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("ses"), F.col("l_orderkey").cast("string")).alias("session_id"), F.lit("m1").alias("model_version"),
        F.round("l_discount", 4).alias("risk"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("at"))
    return U.upsert(stored, new, ["session_id", "model_version"], ["at", "risk"]).select("session_id", "model_version", "risk")


@query(f"""WITH {B.SQL_EVENTS}, st AS (SELECT session_id, event_seq, CASE WHEN channel IN ('screen', 'device', 'behavioral') THEN 'telemetry' ELSE 'detector' END AS origin FROM valid),
inc AS (SELECT session_id, event_seq, 'detector' AS origin FROM valid WHERE event_type = 'FACE_OBSERVATION')
SELECT origin, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_seq) AS BIGINT) AS checksum FROM (
  SELECT * FROM st WHERE NOT (origin = 'detector' AND session_id IN (SELECT session_id FROM inc)) UNION ALL SELECT * FROM inc) GROUP BY origin""")
def replace_by_origin(spark, sf_dir):
    ev = valid_events(spark, sf_dir)
    origin = F.when(F.col("channel").isin(R.TELEMETRY_CHANNELS), "telemetry").otherwise("detector")
    stored = ev.select("session_id", "event_seq", origin.alias("origin"))
    new = ev.where("event_type = 'FACE_OBSERVATION'").select("session_id", "event_seq", F.lit("detector").alias("origin"))
    return U.replace_by_origin(stored, new, "detector").groupBy("origin").agg(F.count("*").alias("n"), F.sum("event_seq").alias("checksum"))


_STATUS = "['" + "', '".join(R.TRANSITIONS) + "']"
_EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in R.TRANSITIONS.items() for b in bs)


@query(f"""WITH h AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, ({_STATUS})[(l_linenumber * 5 + CAST(l_quantity AS BIGINT)) % 12 + 1] AS status FROM lineitem),
s AS (SELECT *, lag(status) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS from_status FROM h)
SELECT from_status, status, CAST(count(*) AS BIGINT) AS n FROM s WHERE from_status IS NOT NULL AND (from_status, status) NOT IN (VALUES {_EDGES}) GROUP BY ALL""")
def illegal_transitions(spark, sf_dir):
    """Line items as status changes of their order."""
    names = F.array(*[F.lit(s) for s in R.TRANSITIONS])
    at = (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("bigint")) % 12
    hist = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), "l_shipdate", "l_linenumber", "l_partkey", F.element_at(names, (at + 1).cast("int")).alias("status"))
    bad = H.illegal_transitions(hist, ["l_shipdate", "l_linenumber", "l_partkey"])
    return bad.groupBy("from_status", "status").agg(F.count("*").alias("n"))


def _sql_split() -> str:
    raw = ", ".join(f"n * {f}::DOUBLE AS r_{s}, floor(n * {f}::DOUBLE) AS b_{s}" for s, f in R.SPLITS)
    names = [s for s, _ in R.SPLITS]
    rank = ", ".join(
        "(" + " + ".join(
            f"CAST(r_{o} - b_{o} {'>=' if j < i else '>'} r_{s} - b_{s} AS INT)" for j, o in enumerate(names) if j != i) + f") AS k_{s}"
        for i, s in enumerate(names))
    quota = ", ".join(f"b_{s} + CAST(k_{s} < n - {' - '.join('b_' + o for o in names)} AS INT) AS q_{s}" for s in names)
    return f"""WITH u AS (SELECT o_custkey AS unit, min(CASE WHEN o_orderstatus = 'F' THEN '0' ELSE '1' END || '|' || o_orderpriority) AS stratum FROM orders GROUP BY 1),
nu AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || unit), unit) AS rn FROM u),
st AS (SELECT stratum, count(*) AS n FROM u GROUP BY 1), ra AS (SELECT *, {raw} FROM st), rk AS (SELECT *, {rank} FROM ra), qt AS (SELECT *, {quota} FROM rk),
asg AS (SELECT unit, CASE WHEN rn <= q_train THEN 'train' WHEN rn <= q_train + q_validation THEN 'validation'
  WHEN rn <= q_train + q_validation + q_calibration THEN 'calibration' ELSE 'holdout' END AS split FROM nu JOIN qt USING (stratum))"""


def _split_input(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("unit"), (F.col("o_orderstatus") == "F").alias("violation"),
        F.col("o_orderpriority").alias("profile"))


@query(_sql_split() + " SELECT o_orderkey AS session_id, split FROM orders JOIN asg ON asg.unit = orders.o_custkey")
def stratified_split(spark, sf_dir):
    return H.stratified_split(_split_input(spark, sf_dir), 7)


@query(f"""WITH b AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders), c AS (SELECT substr(sha256(id), 1, 3) AS k, sha256(string_agg(id, chr(10) ORDER BY id)) AS h, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY k)) AS ids_sha256 FROM c""")
def ids_hash(spark, sf_dir):
    return H.ids_hash(B.table(spark, sf_dir, "orders"), "o_orderkey")


_PURPOSES = ["first headline evaluation", "final sealed evaluation"]


@query(_sql_split() + f""" SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders JOIN asg ON asg.unit = orders.o_custkey WHERE split = 'holdout') AS n_ids,
  CAST(n AS INT) AS access_no, (['{_PURPOSES[0]}', '{_PURPOSES[1]}'])[n] AS purpose FROM range(1, 3) AS r(n)""")
def holdout_guard(spark, sf_dir):
    """Two logged openings of the holdout; a third is refused (see the tests)."""
    splits = H.stratified_split(_split_input(spark, sf_dir), 7).withColumn("session_id", F.col("session_id").cast("string"))
    sealed = H.ids_hash(splits.where("split = 'holdout'"), "session_id").first()["ids_sha256"]
    log = sinks.new_folder(spark, "holdout-log")
    H.open_holdout(splits, sealed, log, _PURPOSES[0], "checker")
    ids = H.open_holdout(splits, sealed, log, _PURPOSES[1], "checker")
    counted = ids.agg(F.count("*").alias("n_ids")).withColumn("k", F.lit(0))
    return counted.join(H.accesses(spark, log).withColumn("k", F.lit(0)), "k").select("n_ids", "access_no", "purpose")


_EPISODES = """ep AS (SELECT 'ses' || l_orderkey AS session_id, CAST(l_linenumber * 300000 AS BIGINT) AS s, CASE WHEN l_linenumber % 4 = 0 THEN -1 ELSE CAST(l_linenumber * 300000 + l_quantity * 10000 AS BIGINT) END AS e,
  CASE l_returnflag WHEN 'A' THEN 'PHONE_USE' WHEN 'R' THEN 'TAB_SWITCH' ELSE 'NOTE_READING' END AS type, l_discount > 0.02 AS shown FROM lineitem),
se AS (SELECT 'ses' || o_orderkey AS session_id, o_totalprice / 100.0 AS dur, o_orderstatus <> 'P' AS sv FROM orders)"""


def _script(spark, sf_dir):
    n = F.col("l_linenumber")
    start = (n * 300000).cast("bigint")
    kind = F.when(F.col("l_returnflag") == "A", "PHONE_USE").when(F.col("l_returnflag") == "R", "TAB_SWITCH").otherwise("NOTE_READING")
    eps = B.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("ses"), F.col("l_orderkey").cast("string")).alias("session_id"), start.alias("scheduled_start_ms"),
        F.when(n % 4 == 0, F.lit(-1)).otherwise((start + F.col("l_quantity") * 10000).cast("bigint")).alias("scheduled_end_ms"),
        kind.alias("violation_type"), F.when(F.col("l_discount") > 0.02, start).alias("shown_at_ms"))
    ses = B.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ses"), F.col("o_orderkey").cast("string")).alias("session_id"), (F.col("o_totalprice") / 100.0).alias("duration_s"),
        (F.col("o_orderstatus") != "P").alias("script_violation"))
    return eps, ses


@query(f"""WITH {_EPISODES}, j AS (SELECT se.session_id, sv, s, s < floor(dur * 1000) AS kept, type, shown FROM se LEFT JOIN ep USING (session_id))
SELECT session_id, sv AND count(*) FILTER (WHERE kept) > 0 AS violation, CASE WHEN sv THEN coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (WHERE kept), '') ELSE '' END AS violation_types,
  CAST(CASE WHEN sv THEN count(*) FILTER (WHERE kept) ELSE 0 END AS BIGINT) AS n_intervals, CASE WHEN count(*) FILTER (WHERE s IS NOT NULL AND NOT (kept AND shown)) = 0 THEN 'certain' ELSE 'uncertain' END AS confidence FROM j GROUP BY session_id, sv""")
def script_labels(spark, sf_dir):
    eps, ses = _script(spark, sf_dir)
    return H.script_labels(eps, ses).withColumn("violation_types", F.array_join("violation_types", ","))


@query(f"""WITH {_EPISODES} SELECT session_id, s AS start_ms, CAST(CASE WHEN e < 0 THEN floor(dur * 1000) ELSE least(e, floor(dur * 1000)) END AS BIGINT) AS end_ms, type FROM ep JOIN se USING (session_id) WHERE s < floor(dur * 1000)""")
def script_intervals(spark, sf_dir):
    return H.script_intervals(*_script(spark, sf_dir))


@query(f"""{_O}, gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < -500), aff AS (SELECT id FROM sessions WHERE participant_id IN (FROM gone) OR helper_participant_id IN (FROM gone))
SELECT 'labels' AS name, CAST(count(*) AS BIGINT) AS n FROM labels_ WHERE session_id NOT IN (FROM aff) UNION ALL SELECT 'splits', count(*) FROM splits WHERE session_id NOT IN (FROM aff)
UNION ALL SELECT 'verdicts', count(*) FROM verdicts WHERE session_id NOT IN (FROM aff) UNION ALL SELECT 'deleted_stubs', count(*) FROM sessions WHERE status = 'DELETED' OR id IN (FROM aff)
UNION ALL SELECT 'redacted', count(*) FROM gone""")
def erase_participant(spark, sf_dir):
    """Withdrawal of everyone with a deep overdraft: what stays in each table."""
    people = B.participants(spark, sf_dir)
    gone = people.where("c_acctbal < -500")
    s = B.sessions(spark, sf_dir)
    hit = H.affected_sessions(s, gone)
    kept = H.erase({"labels": B.session_labels(spark, sf_dir), "splits": B.session_splits(spark, sf_dir), "verdicts": B.verdicts(spark, sf_dir)}, hit)
    stubs = H.erase_session_rows(s, hit).where("status = 'DELETED'")
    consents = people.select(
        F.col("id").alias("participant_id"), F.col("code").alias("signed_name"), F.lit(None).cast("timestamp").alias("withdrawn_at"), F.lit(None).cast("string").alias("withdrawal_reason"))
    redacted = H.redact_consents(consents, gone, F.current_timestamp(), "asked").where("withdrawn_at IS NOT NULL AND signed_name LIKE '[redacted%'")
    return O.row_counts({**kept, "deleted_stubs": stubs, "redacted": redacted}).withColumnRenamed("table", "name")


# ---- intervals ----
_IV = """iv AS (SELECT l_orderkey AS session_id, l_returnflag AS type, l_linestatus, epoch_us(l_shipdate) // 1000 AS s, epoch_us(l_shipdate) // 1000 + CAST(l_quantity AS BIGINT) * 86400000 AS e FROM lineitem)"""


def _item_intervals(spark, sf_dir):
    start = B.millis_since("l_shipdate", "1970-01-01 00:00:00")
    return B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("type"), "l_linestatus", start.alias("start_ms"),
        (start + F.col("l_quantity").cast("bigint") * 86400000).alias("end_ms"))


@query(f"""WITH {_IV}, t AS (SELECT row_number() OVER () AS i, * FROM iv WHERE l_linestatus = 'F'), f AS (SELECT * FROM iv WHERE l_linestatus = 'O'),
p AS (SELECT t.i, t.type, max(CASE WHEN f.e IS NULL THEN 0 ELSE greatest(0, least(t.e, f.e) - greatest(t.s, f.s)) / (greatest(t.e, f.e) - least(t.s, f.s)) END) AS iou FROM t LEFT JOIN f ON f.session_id = t.session_id AND f.type = t.type GROUP BY ALL)
SELECT type, CAST(count(*) AS BIGINT) AS episodes, {sql_r6('avg(CAST(coalesce(iou, 0) >= 0.5 AS INT))', 'share_iou_ge_0_5')}, {sql_r6('avg(coalesce(iou, 0))', 'mean_best_iou')} FROM p GROUP BY type""")
def flag_iou(spark, sf_dir):
    """Open lines as flags for finished lines of the same order; buckets of thirty days."""
    iv = _item_intervals(spark, sf_dir)
    best = X.best_iou(iv.where("l_linestatus = 'F'"), iv.where("l_linestatus = 'O'"), 30 * 86_400_000)
    return X.iou_summary(best).select("type", "episodes", r6("share_iou_ge_0_5").alias("share_iou_ge_0_5"), r6("mean_best_iou").alias("mean_best_iou"))


_TYPES = [t for t, *_ in R.FLAG_RULES]
_TRUTH = f"""tiv AS (SELECT session_id, (['{"', '".join(_TYPES)}'])[k % 6 + 1] AS type, ts_ms AS s, ts_ms + (1 + k % 10) * {STEP} AS e FROM valid WHERE event_type = 'IDENTITY_CHECK'),
tsec AS (SELECT DISTINCT session_id, type, unnest(range(s // {STEP}, CAST(ceil(e / {STEP}.0) AS BIGINT))) AS sec FROM tiv)"""


def _truth(spark, sf_dir):
    ev = valid_events(spark, sf_dir).where("event_type = 'IDENTITY_CHECK'")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("k") % 6 + 1).cast("int"))
    iv = ev.select("session_id", kind.alias("type"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + (1 + F.col("k") % 10) * STEP).alias("end_ms"))
    return X.truth_seconds(iv, _TYPES, STEP)


@query(f"WITH {B.SQL_EVENTS}, {_TRUTH} SELECT session_id, CAST(sec AS BIGINT) AS sec, " + ", ".join(f"bool_or(type = '{t}') AS truth_{t}" for t in _TYPES) + " FROM tsec GROUP BY 1, 2")
def truth_mask(spark, sf_dir):
    return _truth(spark, sf_dir).select("session_id", "sec", *[(F.col(f"truth_{t}") == 1).alias(f"truth_{t}") for t in _TYPES])


def _sql_errors() -> str:
    parts = []
    for det, sig, vtype in R.DETECTORS:
        c = col(sig)
        parts.append(
            f"SELECT '{det}' AS detector, count(*) FILTER (WHERE {c} > 0.5 AND tr) AS tp, count(*) FILTER (WHERE {c} <= 0.5 AND tr) AS fn, count(*) FILTER (WHERE {c} > 0.5 AND NOT anyt) AS fp, "
            f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT anyt) AS neg, count(DISTINCT session_id) FILTER (WHERE tr) AS sessions_with_truth FROM (SELECT g.*, "
            f"EXISTS (SELECT 1 FROM tsec t WHERE t.session_id = g.session_id AND t.sec = g.sec AND t.type = '{vtype}') AS tr, "
            "EXISTS (SELECT 1 FROM tsec t WHERE t.session_id = g.session_id AND t.sec = g.sec) AS anyt FROM grid g)")
    return f"{SQL_GRID}, {_TRUTH}, de AS ({' UNION ALL '.join(parts)})"


@query(_sql_errors() + f""" SELECT detector, tp, fn, fp, neg, sessions_with_truth, {sql_r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END', 'recall')},
  {sql_r6('CASE WHEN neg > 0 THEN fp / neg END', 'fp_rate_per_second')}, {sql_r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END', 'precision_at_observed_prevalence')} FROM de""")
def detector_errors(spark, sf_dir):
    out = X.detector_errors(event_grid(spark, sf_dir), _truth(spark, sf_dir))
    return out.select("detector", "tp", "fn", "fp", "neg", "sessions_with_truth", *[r6(c).alias(c) for c in ("recall", "fp_rate_per_second", "precision_at_observed_prevalence")])


_CONFIG = [("phone", 0.70, 0.75), ("face_count_gt1", 0.90, 0.95), ("person_count_gt1", 0.88, 0.93), ("identity_mismatch", 0.93, 0.97),
           ("tab_hidden", 1.0, 1.0), ("second_voice", 0.88, 0.92), ("book_paper", 0.65, 0.70)]
_CFG = "cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', {r}, {p})" for d, r, p in _CONFIG) + ") c(detector, set_recall, set_precision))"


@query(_sql_errors() + f""", {_CFG}, m AS (SELECT de.*, cfg.set_precision, CAST(CASE WHEN tp + fn > 0 AND sessions_with_truth >= 3 THEN round_even(greatest(0.05, least(0.999, tp / (tp + fn))), 3) ELSE set_recall END AS DOUBLE) AS new_recall FROM de JOIN cfg USING (detector))
SELECT detector, new_recall, CAST(CASE WHEN neg >= 3600 THEN round_even(greatest(0.05, least(1.0, 1 / (1 + (fp / neg) / (1.25::DOUBLE * 0.01::DOUBLE * greatest(new_recall, 0.001))))), 3) ELSE set_precision END AS DOUBLE) AS new_precision FROM m""")
def measured_rates(spark, sf_dir):
    from reviewrank.session import small_table

    config = small_table(spark, [{"detector": d, "set_recall": r, "set_precision": p, "ref_prevalence": 0.01} for d, r, p in _CONFIG],
                         "detector STRING, set_recall DOUBLE, set_precision DOUBLE, ref_prevalence DOUBLE")
    errors = X.detector_errors(event_grid(spark, sf_dir), _truth(spark, sf_dir))
    n = B.session_events(spark, sf_dir).select("session_id").distinct().count()
    return X.measured_rates(errors, config, 1.25, n)


_MAP_X = [0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
_MAP_Y = [0.0, 0.0, 0.04, 0.3, 0.35, 0.9, 0.97]
_MAP = "mp AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM (VALUES " + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in zip(_MAP_X, _MAP_Y, strict=True)) + ") v(x, y))"


@query(f"WITH {B.SQL_SCORED}, {_MAP} SELECT id, {sql_r6('CASE WHEN p >= 1 THEN 0.97 ELSE y + (y1 - y) * (p - x) / (x1 - x) END', 'risk')} "
       "FROM (SELECT id, p FROM scored) s JOIN mp ON (p >= x AND p < x1) OR (p >= 1 AND x = 0.5)")
def calibrate_lookup(spark, sf_dir):
    rows = B.scored_rows(spark, sf_dir).select("id", "p")
    return X.interpolate(rows, "p", _MAP_X, {"risk": _MAP_Y}).select("id", r6("risk").alias("risk"))


# ---- scalars ----
@query("SELECT event_id, " + ", ".join([
    sql_r6("sqrt(value * value + 4)", "hyp"), sql_r6("greatest(0, least(3, value / 40))", "clipped"),
    sql_r6("1 / (1 + exp(-value / 100))", "sig"), sql_r6("ln(greatest(1e-6, least(1 - 1e-6, value / 600)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 600))))", "lg"),
    "round_even(event_id / 8.0::DOUBLE, 2) AS even"]) + " FROM events")
def scalar_math(spark, sf_dir):
    from reviewrank.functions.scalars import clip, logit, sigmoid

    v = F.col("value")
    return B.table(spark, sf_dir, "events").select(
        "event_id", r6(F.hypot(v, F.lit(2.0))).alias("hyp"), r6(clip(v / 40, 0.0, 3.0)).alias("clipped"), r6(sigmoid(v / 100)).alias("sig"),
        r6(logit(v / 600)).alias("lg"), F.bround(F.col("event_id") / 8, 2).alias("even"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 180 DAY, '%Y-%m-%d') AS due, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS stamp FROM orders")
def retention_due(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(F.date_add("o_orderdate", 180), "yyyy-MM-dd").alias("due"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm 'UTC'").alias("stamp"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    """A number out of a JSON column by path."""
    return B.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
