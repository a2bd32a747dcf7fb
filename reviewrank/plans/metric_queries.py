"""Metrics and drift over scored documents and shipped items."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.functions.scalars import wilson_low as wilson
from reviewrank.operators import drift as D
from reviewrank.operators import metrics as M
from reviewrank.operators import resampling as Z
from reviewrank.plans.catalog import query, r6, sql_r6
from reviewrank.sources import bridge as B

THR = 0.1
_S = f"WITH {B.SQL_SCORED}"
_FACTORS = ["lang", "source"]
_CURVE = """sc AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
cv AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM sc)"""


@query(f"""{_S}, {_CURVE}, steps AS (SELECT tp / (tp + fp) AS prec, pos / (SELECT sum(y) FROM scored) AS gain FROM cv)
SELECT CAST((SELECT count(*) FROM scored) AS BIGINT) AS n, CAST((SELECT sum(y) FROM scored) AS BIGINT) AS positives, {sql_r6('sum(prec * gain)', 'pr_auc')} FROM steps""")
def avg_precision(spark, sf_dir):
    return M.ranking(B.scored_rows(spark, sf_dir)).select("n", "positives", r6("pr_auc").alias("pr_auc"))


@query(f"""{_S}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scored)
SELECT {sql_r6("(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))", "roc_auc")} FROM r""")
def roc_auc(spark, sf_dir):
    return M.ranking(B.scored_rows(spark, sf_dir)).select(r6("roc_auc").alias("roc_auc"))


_BIN = " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INT)" for e in M.EDGES[1:-1])


@query(f"""{_S}, b AS (SELECT *, {_BIN} AS bin FROM scored)
SELECT CAST(bin AS BIGINT) AS bin, round(bin / 15.0, 6) + 0.0 AS bin_lo, round((bin + 1) / 15.0, 6) + 0.0 AS bin_hi, CAST(count(*) AS BIGINT) AS n,
  {sql_r6('avg(p)', 'mean_pred')}, {sql_r6('avg(y)', 'frac_pos')} FROM b GROUP BY bin""")
def ece_reliability(spark, sf_dir):
    out = M.reliability(B.scored_rows(spark, sf_dir))
    return out.select("bin", "n", *[r6(c).alias(c) for c in ("bin_lo", "bin_hi", "mean_pred", "frac_pos")])


@query(f"""{_S}, b AS (SELECT *, {_BIN} AS bin FROM scored), g AS (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY bin)
SELECT {sql_r6("sum(n * abs(mp - my)) / sum(n)", "ece")}, {sql_r6("(SELECT avg((p - y) * (p - y)) FROM scored)", "brier")} FROM g""")
def calibration_error(spark, sf_dir):
    return M.calibration_error(B.scored_rows(spark, sf_dir)).select(r6("ece").alias("ece"), r6("brier").alias("brier"))


_CONF = f"""count(*) FILTER (WHERE p >= {THR} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {THR} AND y = 0) AS fp,
  count(*) FILTER (WHERE p < {THR} AND y = 1) AS fn, count(*) FILTER (WHERE p < {THR} AND y = 0) AS tn"""


@query(f"""{_S}, c AS (SELECT {_CONF} FROM scored) SELECT tp, fp, fn, tn, {sql_r6('tp / greatest(1, tp + fn)', 'recall')},
  {sql_r6('fp / greatest(1, fp + tn)', 'fpr')}, {sql_r6('tp / greatest(1, tp + fp)', 'precision')}, {sql_r6('(tp + fp) / (tp + fp + fn + tn)', 'flag_rate')} FROM c""")
def confusion(spark, sf_dir):
    out = M.rates(B.scored_rows(spark, sf_dir), M.above(THR))
    return out.select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("recall", "fpr", "precision", "flag_rate")])


_BUDGETS = [0.10, 0.03, 0.005, 1.0]


@query(f"""{_S}, neg AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS n FROM scored WHERE y = 0),
bd AS (SELECT unnest([0.10, 0.03, 0.005, 1.0]::DOUBLE[]) AS budget)
SELECT budget, p AS cut, floor(budget * n) >= n AS inclusive FROM bd, neg WHERE rn = least(floor(budget * n), n - 1) + 1""")
def fpr_threshold(spark, sf_dir):
    return M.fpr_thresholds(B.scored_rows(spark, sf_dir), _BUDGETS)


@query(f"""{_S}, neg AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS n FROM scored WHERE y = 0),
t AS (SELECT max(p) FILTER (WHERE rn = least(floor(0.10 * n), n - 1) + 1) AS r, max(p) FILTER (WHERE rn = least(floor(0.03 * n), n - 1) + 1) AS h,
  max(p) FILTER (WHERE rn = least(floor(0.005 * n), n - 1) + 1) AS x FROM neg)
SELECT round(least(greatest(r, 0.005), h), 6) + 0.0 AS routine_review, round(h, 6) + 0.0 AS human_review, round(greatest(x, h), 6) + 0.0 AS priority_review FROM t""")
def tiers(spark, sf_dir):
    """Review tiers from clean-row budgets; a tier starts just above its cut."""
    cuts = M.fpr_thresholds(B.scored_rows(spark, sf_dir), list(R.TIER_FPR.values()))
    at = {k: F.max(F.when(F.col("budget") == b, F.col("cut"))) for k, b in R.TIER_FPR.items()}
    human = at["HUMAN_REVIEW"]
    return cuts.agg(
        r6(F.least(F.greatest(at["ROUTINE_REVIEW"], F.lit(R.ROUTINE_FLOOR)), human)).alias("routine_review"),
        r6(human).alias("human_review"), r6(F.greatest(at["PRIORITY_REVIEW"], human)).alias("priority_review"))


@query(f"""{_S}, {_CURVE}, cand AS (SELECT p AS t, tp, fp FROM cv UNION ALL SELECT 1.01, 0, 0), ra AS (SELECT unnest([1, 2, 5, 10, 20, 50]) AS ratio),
cost AS (SELECT ratio, t, ratio * fp + (SELECT sum(y) FROM scored) - tp AS c FROM cand, ra),
best AS (SELECT ratio, t FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY c, t) AS rn FROM cost) WHERE rn = 1),
v AS (SELECT ratio, t, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, sum(y) AS pos, count(*) AS n FROM best, scored GROUP BY 1, 2)
SELECT CAST(ratio AS BIGINT) AS fp_to_fn_cost_ratio, round(t, 6) + 0.0 AS threshold, {sql_r6('(pos - fn) / greatest(1, pos)', 'val_recall')},
  {sql_r6('fp / greatest(1, n - pos)', 'val_fpr')}, {sql_r6('1000 * (ratio * fp + fn) / n', 'val_expected_cost_per_1000')} FROM v""")
def cost_curve(spark, sf_dir):
    rows = B.scored_rows(spark, sf_dir)
    out = M.cost_curve(rows, rows)
    return out.select("fp_to_fn_cost_ratio", *[r6(c).alias(c) for c in out.columns[1:]])


_LONG = f"""{_S}, lg AS (SELECT 'lang' AS factor, lang AS level, y, p FROM scored UNION ALL SELECT 'source', source, y, p FROM scored)"""


@query(f"""{_LONG}, sc AS (SELECT factor, level, p, sum(y) AS pos, sum(1 - y) AS neg FROM lg GROUP BY ALL),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM sc WINDOW w AS (PARTITION BY factor, level ORDER BY p DESC)),
ap AS (SELECT factor, level, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS pr_auc FROM cv GROUP BY ALL),
bn AS (SELECT factor, level, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM lg GROUP BY ALL),
ec AS (SELECT factor, level, sum(n * abs(mp - my)) / sum(n) AS ece FROM bn GROUP BY ALL),
pl AS (SELECT factor, level, count(*) AS n, sum(y) AS positives, avg(CAST(p >= {THR} AS INT)) FILTER (WHERE y = 0) AS fpr, avg(CAST(p >= {THR} AS INT)) FILTER (WHERE y = 1) AS recall FROM lg GROUP BY ALL)
SELECT pl.factor, pl.level, CAST(pl.n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives, pl.n < 300 AS underpowered, {sql_r6('fpr', 'fpr')}, {sql_r6('recall', 'recall')},
  {sql_r6('pr_auc', 'pr_auc')}, {sql_r6('ece', 'ece')} FROM pl JOIN ap USING (factor, level) JOIN ec USING (factor, level)""")
def slice_metrics(spark, sf_dir):
    out = M.slice_metrics(B.scored_rows(spark, sf_dir), _FACTORS, THR)
    return out.select("factor", "level", "n", "positives", "underpowered", *[r6(c).alias(c) for c in ("fpr", "recall", "pr_auc", "ece")])


@query(f"""{_LONG}, g AS (SELECT factor, level, (count(*) FILTER (WHERE p >= {THR}) + 1) / (count(*) + 2) AS f FROM lg WHERE y = 0 GROUP BY ALL)
SELECT factor, CASE WHEN count(*) > 1 THEN round(max(f) / min(f), 6) + 0.0 END AS fpr_disparity FROM g GROUP BY factor""")
def fpr_disparity(spark, sf_dir):
    return M.fpr_disparity(B.scored_rows(spark, sf_dir), _FACTORS, THR).select("factor", r6("fpr_disparity").alias("fpr_disparity"))


@query(f"""{_S}, c AS (SELECT lang, source, count(*) AS n FROM scored WHERE y = 0 GROUP BY ALL)
SELECT id, {sql_r6("CASE WHEN y = 0 THEN (SELECT sum(n) / count(*) FROM c) / c.n ELSE 1.0 END", "weight")} FROM scored LEFT JOIN c USING (lang, source)""")
def slice_weights(spark, sf_dir):
    return M.slice_weights(B.scored_rows(spark, sf_dir), ["lang", "source"]).select("id", r6("weight").alias("weight"))


@query(f"{_S} SELECT source AS profile, CAST(count(*) AS BIGINT) AS n, {sql_r6(f'avg(CAST(p >= {THR} AS INT))', 'flagged_share')} FROM scored GROUP BY source")
def by_profile(spark, sf_dir):
    return M.flag_rate_by(B.scored_rows(spark, sf_dir), "source", THR).withColumn("flagged_share", r6("flagged_share"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) + 0.0 AS median FROM lineitem" for c in _MEASURES))
def clean_reference(spark, sf_dir):
    return M.medians(B.table(spark, sf_dir, "lineitem"), _MEASURES).select("feature", r6("median").alias("median"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr(rx, CAST(y AS DOUBLE)), 6) + 0.0 AS rho FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx, "
    "l_returnflag = 'R' AS y FROM lineitem)" for c in _MEASURES))
def spearman(spark, sf_dir):
    """Rank correlation of item measures with being returned."""
    items = B.table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return M.spearman(items, _MEASURES).select("feature", r6("rho").alias("rho"))


def _sql_ks() -> str:
    parts = []
    for c in _MEASURES:
        parts.append(
            f"SELECT '{c}' AS feature, round(max(abs(ca / ta - cb / tb)), 6) + 0.0 AS ks, round(any_value(ma), 6) + 0.0 AS mean_a, round(any_value(mb), 6) + 0.0 AS mean_b FROM ("
            f"SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS ta, "
            f"(SELECT count(*) FROM lineitem WHERE l_linestatus <> 'F') AS tb, (SELECT avg({c}) FROM lineitem WHERE l_linestatus = 'F') AS ma, "
            f"(SELECT avg({c}) FROM lineitem WHERE l_linestatus <> 'F') AS mb FROM (SELECT {c} AS v, count(*) FILTER (WHERE l_linestatus = 'F') AS a, "
            f"count(*) FILTER (WHERE l_linestatus <> 'F') AS b FROM lineitem GROUP BY 1))")
    return " UNION ALL ".join(parts)


@query(_sql_ks())
def ks_test(spark, sf_dir):
    """Item measures of finished against open lines."""
    items = B.table(spark, sf_dir, "lineitem")
    done = F.col("l_linestatus") == "F"
    out = M.ks_test(items.where(done), items.where(~done), _MEASURES)
    return out.select("feature", *[r6(c).alias(c) for c in ("ks", "mean_a", "mean_b")])


@query("SELECT l_shipmode_month AS month, CAST(sum(fl) AS BIGINT) AS flagged, CAST(count(*) AS BIGINT) AS n, "
       "round(CASE WHEN count(*) = 0 THEN 0 ELSE (sum(fl) / count(*) + 1.96 * 1.96 / (2 * count(*)) - 1.96 * sqrt(sum(fl) / count(*) * (1 - sum(fl) / count(*)) / count(*) "
       "+ 1.96 * 1.96 / (4.0 * count(*) * count(*)))) / (1 + 1.96 * 1.96 / count(*)) END, 6) + 0.0 AS low "
       "FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmode_month, CAST(l_discount >= 0.09 AS INT) AS fl FROM lineitem) GROUP BY 1")
def wilson_low(spark, sf_dir):
    """Wilson lower bound of the share of deeply discounted lines per month."""
    items = B.table(spark, sf_dir, "lineitem")
    months = items.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.count(F.when(F.col("l_discount") >= 0.09, 1)).alias("flagged"), F.count("*").alias("n"))
    return months.withColumn("low", r6(wilson(F.col("flagged"), F.col("n"))))


_DRIFTING = ["l_extendedprice", "l_quantity", "l_tax"]


def sql_psi(reference: str, current: str, batch: str, features: list[str]) -> str:
    """CTEs ending in ``psi(batch, feature, psi)``."""
    long = lambda src, keep: " UNION ALL ".join(f"SELECT {keep}'{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {src}" for f in features)
    return f"""rl AS ({long(reference, '')}), cl AS ({long(current, batch + ' AS batch, ')}),
eg AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM rl GROUP BY feature),
ed AS (SELECT feature, CASE WHEN len(e) >= 3 THEN e[2:len(e) - 1] ELSE [e[1] + 1e-12] END AS inn FROM eg),
bins AS (SELECT feature, inn, unnest(range(len(inn) + 1)) AS bin FROM ed),
rb AS (SELECT feature, len(list_filter(inn, lambda x: x <= v)) AS bin, count(*) AS n FROM rl JOIN ed USING (feature) GROUP BY ALL),
cb AS (SELECT batch, feature, len(list_filter(inn, lambda x: x <= v)) AS bin, count(*) AS n FROM cl JOIN ed USING (feature) GROUP BY ALL),
rt AS (SELECT feature, sum(n) AS n FROM rb GROUP BY ALL), ct AS (SELECT batch, feature, sum(n) AS n FROM cb GROUP BY ALL),
sh AS (SELECT ct.batch, bins.feature, greatest(coalesce(rb.n, 0) / rt.n, 1e-4) AS r, greatest(coalesce(cb.n, 0) / ct.n, 1e-4) AS c FROM bins JOIN rt USING (feature)
  JOIN ct ON ct.feature = bins.feature LEFT JOIN rb ON rb.feature = bins.feature AND rb.bin = bins.bin LEFT JOIN cb ON cb.batch = ct.batch AND cb.feature = bins.feature AND cb.bin = bins.bin),
psi AS (SELECT batch, feature, sum((c - r) * ln(c / r)) AS psi FROM sh GROUP BY ALL)"""


@query(f"""WITH ref AS (SELECT * FROM lineitem WHERE year(l_shipdate) = 1995), cur AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS ym FROM lineitem),
{sql_psi('ref', 'cur', 'ym', _DRIFTING)} SELECT batch AS month, feature, {sql_r6('psi', 'psi')} FROM psi""")
def psi(spark, sf_dir):
    """Shipped items of every month against the first year."""
    items = B.table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    ref = D.long_features(items.where(F.year("l_shipdate") == 1995), _DRIFTING)
    return D.psi(ref, D.long_features(items, _DRIFTING, ["month"]), ["month"]).withColumn("psi", r6("psi"))


_BATCHED = f"{_S}, nb AS (SELECT *, CAST((row_number() OVER (ORDER BY id) - 1) // 200 + 1 AS BIGINT) AS batch FROM scored)"


@query(f"{_BATCHED} SELECT batch, CAST(count(*) AS BIGINT) AS n, CAST(min(id) AS BIGINT) AS first_id, CAST(max(id) AS BIGINT) AS last_id FROM nb GROUP BY batch")
def drift_batches(spark, sf_dir):
    out = D.numbered_batches(B.scored_rows(spark, sf_dir), ["id"])
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _sql_wilson(k: str, n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN 0 ELSE ({k} / {n} + 3.8416 / (2 * {n}) - 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) "
            f"/ (1 + 3.8416 / {n}) END")


@query(f"""{_BATCHED}, {sql_psi('scored', 'nb', 'batch', ['p', 'y'])},
mx AS (SELECT batch, max(psi) AS max_psi, (list(feature ORDER BY round(psi, 12) DESC, feature))[1] AS max_psi_feature FROM psi GROUP BY batch),
ref AS (SELECT avg(CAST(p >= {THR} AS INT)) AS rate FROM scored),
bs AS (SELECT batch, count(*) AS sessions, avg(CAST(p >= {THR} AS INT)) AS review_rate, count(*) FILTER (WHERE y = 0) AS neg, count(*) FILTER (WHERE y = 0 AND p >= {THR}) AS fp FROM nb GROUP BY batch),
sl AS (SELECT batch, lang, count(*) AS n, count(*) FILTER (WHERE p >= {THR}) AS k FROM nb WHERE y = 0 GROUP BY ALL HAVING count(*) >= 20),
ws AS (SELECT batch, max(k / n) AS f, count(*) FILTER (WHERE {_sql_wilson('k', 'n')} > 0.06) AS na FROM sl GROUP BY batch)
SELECT batch, CAST(sessions AS BIGINT) AS sessions, {sql_r6('max_psi', 'max_psi')}, max_psi_feature, {sql_r6('review_rate', 'review_rate')}, {sql_r6('fp / greatest(1, neg)', 'clean_fpr')},
  {sql_r6('coalesce(ws.f, 0)', 'worst_slice_fpr')}, CAST(CAST(max_psi > 0.2 AS INT) + CAST(review_rate > 2 * ref.rate OR review_rate < ref.rate / 2 AS INT)
  + CAST({_sql_wilson('fp', 'neg')} > 0.045 AS INT) + coalesce(ws.na, 0) AS BIGINT) AS n_alerts FROM bs JOIN mx USING (batch) LEFT JOIN ws USING (batch), ref""")
def drift_report(spark, sf_dir):
    rows = B.scored_rows(spark, sf_dir)
    rate = D.review_rate(rows, THR)
    out = D.drift_report(rows, D.numbered_batches(rows, ["id"]), ["p", "y"], THR, "lang", rate)
    return out.select(
        "batch", "sessions", "max_psi_feature", *[r6(c).alias(c) for c in ("max_psi", "review_rate", "clean_fpr", "worst_slice_fpr")],
        F.size("alerts").cast("bigint").alias("n_alerts"))


def _sql_side(p: str) -> str:
    return (f"SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY q DESC) AS tp, sum(neg) OVER (ORDER BY q DESC) AS fp FROM "
            f"(SELECT {p} AS q, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1))")


_NOISY = "round(p * p * (1 + id % 7) / 7, 3)"


@query(f"""{_S}, a AS ({_sql_side('p')}), b AS ({_sql_side(_NOISY)}),
r AS (SELECT avg(CAST(p >= {THR} AS INT)) FILTER (WHERE y = 0) AS fa, avg(CAST({_NOISY} >= {THR} AS INT)) FILTER (WHERE y = 0) AS fb,
  avg(CAST(p >= {THR} AS INT)) FILTER (WHERE y = 1) AS ra, avg(CAST({_NOISY} >= {THR} AS INT)) FILTER (WHERE y = 1) AS rb FROM scored)
SELECT {sql_r6('b.ap - a.ap', 'pr_auc')}, {sql_r6('fb - fa', 'fpr')}, {sql_r6('rb - ra', 'recall')} FROM a, b, r""")
def metric_deltas(spark, sf_dir):
    """Change of the headline metrics between two scorings of one set."""
    rows = B.scored_rows(spark, sf_dir)
    noisy = rows.withColumn("p", F.expr(_NOISY))
    a, b = M.summary(rows, THR), M.summary(noisy, THR)
    names = ["pr_auc", "fpr", "recall"]
    left = a.select(F.lit(0).alias("_k"), *[F.col(n).alias(f"a_{n}") for n in names])
    right = b.select(F.lit(0).alias("_k"), *[F.col(n).alias(f"b_{n}") for n in names])
    return left.join(right, "_k").select(*[r6(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(n) for n in names])


@query(f"""{_S}, a AS (SELECT 'lang' AS factor, lang AS level, avg(p) AS v FROM scored GROUP BY lang), b AS (SELECT 'lang' AS factor, lang AS level, avg({_NOISY}) AS v FROM scored WHERE lang <> 'en' GROUP BY lang)
SELECT coalesce(a.factor, b.factor) AS factor, coalesce(a.level, b.level) AS level, {sql_r6('a.v', 'left_value')}, {sql_r6('b.v', 'right_value')}, {sql_r6('abs(a.v - b.v)', 'diff')}
FROM a FULL JOIN b ON a.factor = b.factor AND a.level = b.level""")
def metric_diff(spark, sf_dir):
    rows = B.scored_rows(spark, sf_dir)
    mean = lambda df: df.groupBy(F.lit("lang").alias("factor"), F.col("lang").alias("level")).agg(F.avg("p").alias("value"))
    out = M.metric_diff(mean(rows), mean(rows.where("lang <> 'en'").withColumn("p", F.expr(_NOISY))), ["factor", "level"])
    return out.select("factor", "level", *[r6(c).alias(c) for c in ("left_value", "right_value", "diff")])


@query()
def bootstrap_ci(spark, sf_dir):
    """95 % intervals of the headline metrics over all distinct scores."""
    return Z.ranking_intervals(B.scored_rows(spark, sf_dir), THR)


@query()
def slice_intervals(spark, sf_dir):
    """95 % intervals of the FPR of every slice level, and of the disparity of each factor (no level)."""
    rows = B.scored_rows(spark, sf_dir)
    gap = Z.disparity_intervals(rows, ["lang", "source"], THR).withColumn("level", F.lit(None).cast("string"))
    return Z.slice_fpr_intervals(rows, ["lang", "source"], THR).unionByName(gap)
