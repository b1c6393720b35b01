"""Queries for reference profiles, drift, window signals and policy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.operators import drift, monitor, policy
from lineguard.plans import fixtures as X
from lineguard.plans.registry import register
from lineguard.plans.views_sql import drift_sql, r

KEYS = ("ts_us", "id")
BY = ["scenario"]
FEATURES = list(X.PRED_FEATURES)

_DRIFT = drift_sql("cur_long", "scenario")
_VIEWS = "cur_long ref_share edges"


def _q(p):
    return r(f"quantile_cont(value, {p})")


_MOMENTS = f"count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS min"


@register(
    "agg10_summarise",
    "cur_long",
    f"SELECT scenario, feature, {_MOMENTS}, {_q(0.25)} AS p25, {_q(0.5)} AS p50, {_q(0.75)} AS p75, {r('max(value)')} AS max FROM cur_long GROUP BY 1, 2",
)
def agg10(spark, sf):
    return drift.summarise(X.current(spark, sf), BY, FEATURES)


@register(
    "agg11_reference_stats",
    "ref_long",
    f"""SELECT feature, {_MOMENTS}, {r('max(value)')} AS max, {_q(0.01)} AS p01, {_q(0.05)} AS p05, {_q(0.25)} AS p25, {_q(0.5)} AS p50,
    {_q(0.75)} AS p75, {_q(0.95)} AS p95, {_q(0.99)} AS p99 FROM ref_long GROUP BY 1""",
)
def agg11(spark, sf):
    stats, _ = drift.reference_stats(X.ref_rows(spark, sf), FEATURES)
    return stats.drop("bin_edges", "bin_shares")


@register(
    "agg12_quantile_bin_edges",
    "edges",
    f"""SELECT feature, i AS edge, CASE WHEN i = 0 THEN '-inf'::double WHEN i = len(q) - 1 THEN 'inf'::double ELSE {r('q[i + 1]')} END AS value
    FROM (SELECT feature, q, unnest(range(len(q))) AS i FROM edges)""",
)
def agg12(spark, sf):
    long = drift.unpivot_features(X.ref_rows(spark, sf), [], FEATURES)
    return drift.quantile_bin_edges(long).select("feature", F.posexplode("bin_edges").alias("edge", "value"))


@register(
    "src6_reference_round_trip",
    "bins ref_share",
    f"""SELECT feature, n_ref AS n, {r('ref_mean')} AS mean, bin, CASE WHEN bin = 0 THEN '-inf'::double ELSE {r('inner_edges[bin]')} END AS low_edge, {r('share')} AS share FROM ref_share""",
)
def src6(spark, sf):
    """Parquet store, JSON export with finite sentinels and import of the latter."""
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "reference")
    tables.write_reference(X.reference(spark, sf), spark, path)
    stored = tables.load_reference(spark, path)
    tables.export_reference_json(stored, f"{path}/json")
    stats = tables.import_reference_json(spark, f"{path}/json")
    return stats.select(
        "feature", "n", "mean", F.posexplode(F.arrays_zip("bin_edges", "bin_shares")).alias("bin", "e")
    ).where(F.col("e.bin_shares").isNotNull()).select(
        "feature", "n", "mean", "bin", F.col("e.bin_edges").alias("low_edge"), F.col("e.bin_shares").alias("share")
    )


@register(
    "mon1_build_reference",
    "ref_share ref_rows",
    f"""SELECT feature, n_ref AS n, {r('ref_mean')} AS mean, max(bin)::bigint + 1 AS n_bins, {r('min(share)')} AS least_share,
    (SELECT count(*) FROM ref_rows WHERE class_name = 'defect') AS n_defect, (SELECT count(*) FROM ref_rows WHERE class_name = 'ok') AS n_ok
    FROM ref_share GROUP BY feature, n_ref, ref_mean""",
)
def mon1(spark, sf):
    ref = X.reference(spark, sf)
    mix = ref.class_mix()
    return ref.stats.select(
        "feature",
        "n",
        "mean",
        F.size("bin_shares").alias("n_bins"),
        F.array_min("bin_shares").alias("least_share"),
        F.lit(mix["defect"]).alias("n_defect"),
        F.lit(mix["ok"]).alias("n_ok"),
    )


@register(
    "jn7_value_to_bin",
    "cur_long edges",
    """SELECT scenario, feature, bin, count(*) AS n FROM (
      SELECT scenario, l.feature, len(list_filter(e.q[2:len(e.q) - 1], lambda x: x <= l.value)) AS bin FROM cur_long l JOIN edges e USING (feature)) GROUP BY 1, 2, 3""",
)
def jn7(spark, sf):
    """The lookup with edges as a column: the table of edges has one row per feature."""
    ref = X.reference(spark, sf)
    long = drift.unpivot_features(X.current(spark, sf), BY, FEATURES)
    edges = F.broadcast(ref.stats.select("feature", "bin_edges"))
    binned = long.join(edges, "feature").select("scenario", "feature", drift.bin_of(F.col("value"), F.col("bin_edges")).alias("bin"))
    return binned.groupBy("scenario", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


@register(
    "agg13_bin_shares",
    _VIEWS,
    f"WITH {_DRIFT} SELECT scenario, feature, bin, n, {r('share')} AS share, {r('ref_share')} AS ref_share FROM shares",
)
def agg13(spark, sf):
    out = drift.bin_shares(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES)
    return out.select("scenario", "feature", "bin", "n", "share", "ref_share")


@register("agg14_psi", _VIEWS, f"WITH {_DRIFT} SELECT scenario, feature, {r('psi')} AS psi FROM drift")
def agg14(spark, sf):
    return drift.psi(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES).select("scenario", "feature", "psi")


_SEV = "CASE WHEN psi >= 0.25::double THEN 'significant' WHEN psi >= 0.1::double THEN 'moderate' ELSE 'none' END"


@register("prj10_severity", _VIEWS, f"WITH {_DRIFT} SELECT scenario, feature, {_SEV} AS severity FROM drift")
def prj10(spark, sf):
    return drift.psi(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES).select("scenario", "feature", "severity")


@register(
    "jn5_reference_by_feature",
    _VIEWS,
    f"""WITH {_DRIFT} SELECT scenario, feature, {r('current_mean - reference_mean')} AS mean_shift, n_current FROM drift WHERE feature IN ('f1', 'f3')""",
)
def jn5(spark, sf):
    """Features unknown to the reference, or without finite values, are skipped."""
    cur = X.current(spark, sf).withColumns({"f9": F.lit(1.0), "f5": F.lit(float("nan"))})
    out = drift.psi(cur, BY, X.reference(spark, sf), ["f1", "f3", "f5", "f9"])
    return out.select("scenario", "feature", "mean_shift", "n_current")


_KS = """
rc AS (SELECT feature, value, count(*) AS n FROM ref_long GROUP BY 1, 2),
cc AS (SELECT scenario, feature, value, count(*) AS n FROM cur_long GROUP BY 1, 2, 3),
pts AS (SELECT scenario, feature, value, sum(a) AS a, sum(b) AS b FROM (
    SELECT scenario, feature, value, 0 AS a, n AS b FROM cc
    UNION ALL SELECT s.scenario, rc.feature, rc.value, rc.n, 0 FROM rc CROSS JOIN (SELECT DISTINCT scenario FROM cur_long) s) GROUP BY 1, 2, 3),
run AS (SELECT scenario, feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS ta, sum(b) OVER p AS tb
  FROM pts WINDOW w AS (PARTITION BY scenario, feature ORDER BY value), p AS (PARTITION BY scenario, feature)),
ks AS (SELECT scenario, feature, max(abs(ca / ta::double - cb / tb::double)) AS ks_statistic, max(ta)::bigint AS n_reference, max(tb)::bigint AS n_current
  FROM run GROUP BY 1, 2)"""


@register(
    "agg15_ks_two_sample",
    "ref_long cur_long",
    f"WITH {_KS} SELECT scenario, feature, n_current, n_reference, {r('ks_statistic')} AS ks_statistic FROM ks",
)
def agg15(spark, sf):
    return drift.ks_two_sample(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES).drop("ks_pvalue")


@register("agg15_ks_pvalue")
def agg15_p(spark, sf):
    return drift.ks_two_sample(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES)


_CHI = """
mix AS (SELECT scenario, c.category, count(*) FILTER (predicted_class = c.category) AS b
  FROM cur CROSS JOIN (SELECT unnest(['ok', 'defect']) AS category) c GROUP BY 1, 2),
refmix AS (SELECT class_name AS category, count(*) AS a FROM ref_rows GROUP BY 1),
ct AS (SELECT scenario, category, coalesce(a, 0) AS a, b FROM mix LEFT JOIN refmix USING (category)),
tt AS (SELECT scenario, sum(a)::double AS ra, sum(b)::double AS rb FROM ct GROUP BY 1),
ex AS (SELECT scenario, a, b, (a + b) * ra / (ra + rb) AS ea, (a + b) * rb / (ra + rb) AS eb FROM ct JOIN tt USING (scenario)),
chi AS (SELECT scenario, sum(power(greatest(abs(a - ea) - 0.5, 0), 2) / ea + power(greatest(abs(b - eb) - 0.5, 0), 2) / eb) AS chi2, count(*) - 1 AS dof, sum(b)::bigint AS n_current FROM ex GROUP BY 1)"""


def _class_mix(spark, sf):
    return X.current(spark, sf).groupBy("scenario", F.col("predicted_class").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("agg16_chi_square_mix", "cur ref_rows", f"WITH {_CHI} SELECT scenario, n_current, {r('chi2')} AS chi2, dof FROM chi")
def agg16(spark, sf):
    return drift.chi_square_mix(_class_mix(spark, sf), BY, X.reference(spark, sf).classes).drop("pvalue")


@register(
    "agg16_chi_square_users",
    "base_preds cur",
    f"""WITH a AS (SELECT user_id, count(*) AS a FROM base_preds WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1), b AS (SELECT scenario, user_id, count(*) AS b FROM cur GROUP BY 1, 2),
      ct AS (SELECT s.scenario, u.user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT scenario FROM b) s
        CROSS JOIN (SELECT user_id FROM a UNION SELECT user_id FROM b) u LEFT JOIN a USING (user_id) LEFT JOIN b ON b.scenario = s.scenario AND b.user_id = u.user_id WHERE coalesce(a, 0) + coalesce(b, 0) > 0),
      tt AS (SELECT scenario, sum(a)::double AS ra, sum(b)::double AS rb FROM ct GROUP BY 1),
      ex AS (SELECT scenario, a, b, (a + b) * ra / (ra + rb) AS ea, (a + b) * rb / (ra + rb) AS eb FROM ct JOIN tt USING (scenario))
      SELECT scenario, sum(b)::bigint AS n_current, {r('sum(power(a - ea, 2) / ea + power(b - eb, 2) / eb)', 4)} AS chi2, count(*) - 1 AS dof FROM ex GROUP BY 1""",
)
def agg16_users(spark, sf):
    """A mix of as many categories as there are users."""
    old = X.table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    count = F.count(F.lit(1)).alias("n")
    current = X.current(spark, sf).groupBy("scenario", F.col("user_id").alias("category")).agg(count)
    found = drift.chi_square_mix(current, BY, old.groupBy(F.col("user_id").alias("category")).agg(count)).drop("pvalue")
    return found.withColumn("chi2", F.round("chi2", 4))


@register(
    "agg16_chi_square_hours",
    "cur ref_rows",
    f"""WITH ct AS (SELECT scenario, f4 AS category, coalesce(a, 0) AS a, b FROM
        (SELECT scenario, h AS f4, count(*) FILTER (f4 = h) AS b FROM cur CROSS JOIN (SELECT unnest(range(24))::double AS h) GROUP BY 1, 2)
        LEFT JOIN (SELECT f4, count(*) AS a FROM ref_rows GROUP BY 1) USING (f4) WHERE coalesce(a, 0) + b > 0),
      tt AS (SELECT scenario, sum(a)::double AS ra, sum(b)::double AS rb FROM ct GROUP BY 1),
      ex AS (SELECT scenario, a, b, (a + b) * ra / (ra + rb) AS ea, (a + b) * rb / (ra + rb) AS eb FROM ct JOIN tt USING (scenario))
      SELECT scenario, sum(b)::bigint AS n_current, {r('sum(power(a - ea, 2) / ea + power(b - eb, 2) / eb)')} AS chi2, count(*) - 1 AS dof FROM ex GROUP BY 1""",
)
def agg16_hours(spark, sf):
    """More than two categories: the hour-of-day mix."""
    hour = F.col("f4").cast("int").cast("string")
    mix = X.ref_rows(spark, sf).groupBy(hour.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    counts = X.current(spark, sf).groupBy("scenario", hour.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return drift.chi_square_mix(counts, BY, mix).drop("pvalue")


@register(
    "jn6_category_alignment",
    "cur ref_rows",
    """SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_cur
    FROM (SELECT f5::bigint::varchar AS category, count(*) AS n FROM ref_rows WHERE f5 < 60 GROUP BY 1) a
    FULL JOIN (SELECT f5::bigint::varchar AS category, count(*) AS n FROM cur WHERE f5 > 30 GROUP BY 1) b ON a.category = b.category""",
)
def jn6(spark, sf):
    def mix(df):
        return df.groupBy(F.col("f5").cast("bigint").cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))

    return drift.align_categories(
        mix(X.current(spark, sf).where("f5 > 30")), mix(X.ref_rows(spark, sf).where("f5 < 60"))
    )


@register(
    "agg17_feature_drift",
    _VIEWS,
    f"""WITH {_DRIFT}, {_KS} SELECT d.scenario, d.feature, {r('psi')} AS psi, {r('ks_statistic')} AS ks_statistic, {r('reference_mean')} AS reference_mean,
    {r('current_mean')} AS current_mean, {r('current_mean - reference_mean')} AS mean_shift, {_SEV} AS severity, d.n_reference, d.n_current
    FROM drift d JOIN ks k ON k.scenario = d.scenario AND k.feature = d.feature""",
)
def agg17(spark, sf):
    return drift.feature_drift(X.current(spark, sf), BY, X.reference(spark, sf)).drop("feature_pos", "ks_pvalue")


@register(
    "prj14_report_rounding",
    _VIEWS,
    f"WITH {_DRIFT} SELECT scenario, feature, (round(psi, 4) + 0.0::double) AS psi, (round(current_mean, 2) + 0.0::double) AS current_mean FROM drift",
)
def prj14(spark, sf):
    out = drift.psi(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES)
    return out.select("scenario", "feature", F.bround("psi", 4).alias("psi"), F.bround("current_mean", 2).alias("current_mean"))


ROLLUP = f"""
rollup_rows AS (SELECT scenario, max(psi) AS psi_max, avg(psi) AS psi_mean, count(*) AS n_features,
  count(*) FILTER (psi >= 0.1) AS n_drifted, count(*) FILTER (psi >= 0.25) AS n_significant,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.1), '') AS drifted_features,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.25), '') AS significant_features,
  first(feature ORDER BY round(psi, 9) DESC, pos) AS worst_feature FROM drift GROUP BY 1)"""


@register(
    "agg18_drift_rollup",
    _VIEWS,
    f"""WITH {_DRIFT}, {ROLLUP} SELECT scenario, {r('psi_max')} AS psi_max, {r('psi_mean')} AS psi_mean, n_features, n_drifted, n_significant,
    drifted_features, significant_features, worst_feature FROM rollup_rows""",
)
def agg18(spark, sf):
    return drift.drift_rollup(drift.psi(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES), BY)


@register(
    "agg35_psi_matrix",
    _VIEWS,
    f"WITH {_DRIFT} SELECT scenario, "
    + ", ".join(f"{r(f'max(psi) FILTER (feature = {chr(39)}{f}{chr(39)})')} AS {f}" for f in FEATURES)
    + " FROM drift GROUP BY 1",
)
def agg35(spark, sf):
    return drift.psi_matrix(drift.psi(X.current(spark, sf), BY, X.reference(spark, sf), FEATURES), BY, FEATURES)


# -- window signals -----------------------------------------------------------------

_WIN = """
w AS (SELECT *, i // 200 AS window_index FROM (SELECT *, row_number() OVER (ORDER BY ts_us, id) - 1 AS i FROM preds)),
wk AS (SELECT * FROM w WHERE window_index IN (SELECT window_index FROM w GROUP BY 1 HAVING count(*) >= 100)),
wl AS (""" + " UNION ALL ".join(
    f"SELECT window_index, '{f}' AS feature, {i} AS pos, {f} AS value FROM wk" for i, f in enumerate(FEATURES)
) + ")"

_SCN = """
wk AS (SELECT *, scenario AS g FROM preds),
wl AS (""" + " UNION ALL ".join(f"SELECT g, '{f}' AS feature, {i} AS pos, {f} AS value FROM wk" for i, f in enumerate(FEATURES)) + ")"


def _signals(key: str) -> str:
    """All signals per group of ``wk``/``wl``, as chained clauses ending in ``sig``."""
    return f"""
{drift_sql('wl', key)},
roll AS (SELECT {key}, max(psi) AS psi_max, avg(psi) AS psi_mean, count(*) FILTER (psi >= 0.1) AS n_drifted, count(*) FILTER (psi >= 0.25) AS n_significant,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.1), '') AS drifted_features, first(feature ORDER BY round(psi, 9) DESC, pos) AS worst_feature FROM drift GROUP BY 1),
beh AS (SELECT {key}, count(*) AS n_samples, avg(greatest(probability, 1.0::double - probability)) AS mean_confidence, avg(probability) AS mean_probability,
  avg(predicted_label::double) AS predicted_defect_rate, avg((decision = 'human_review')::int::double) AS review_rate, count(ground_truth) AS n_labeled,
  count(*) FILTER (predicted_label = 0)::double AS n_ok, count(*) FILTER (predicted_label = 1)::double AS n_defect,
  count(*) FILTER (ground_truth = 1 AND probability >= 0.5) AS tp, count(*) FILTER (ground_truth = 0 AND probability >= 0.5) AS fp,
  count(*) FILTER (ground_truth = 1 AND probability < 0.5) AS fn, count(*) FILTER (ground_truth = 0 AND probability < 0.5) AS tn FROM wk GROUP BY 1),
sc AS (SELECT {key}, probability AS s, sum(ground_truth) AS pos, sum(1 - ground_truth) AS neg FROM wk WHERE ground_truth IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, sum(neg) OVER (PARTITION BY {key} ORDER BY s) - neg / 2.0::double AS below, sum(pos) OVER (PARTITION BY {key}) AS np, sum(neg) OVER (PARTITION BY {key}) AS nn FROM sc),
auc AS (SELECT {key}, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * below) / (max(np) * max(nn))::double END AS roc_auc FROM rk GROUP BY 1),
rm AS (SELECT count(*) FILTER (class_name = 'ok')::double AS r_ok, count(*) FILTER (class_name = 'defect')::double AS r_defect FROM ref_rows),
perf AS (SELECT b.*, (tp + tn) / n_labeled::double AS acc, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS prec,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::double ELSE 0 END AS rec, roc_auc FROM beh b LEFT JOIN auc USING ({key})),
sig AS (SELECT p.{key}, n_samples, psi_max, psi_mean, n_drifted, n_significant, drifted_features, worst_feature, mean_confidence,
  0.8::double - mean_confidence AS mean_confidence_drop, mean_probability, predicted_defect_rate, review_rate, CASE WHEN n_labeled >= 20 THEN n_labeled ELSE 0 END AS n_labeled,
  CASE WHEN n_labeled >= 20 THEN acc END AS accuracy, CASE WHEN n_labeled >= 20 THEN prec END AS precision, CASE WHEN n_labeled >= 20 THEN rec END AS recall,
  CASE WHEN n_labeled >= 20 THEN CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END END AS f1,
  CASE WHEN n_labeled >= 20 THEN roc_auc END AS roc_auc, CASE WHEN n_labeled >= 20 THEN 0.8::double - acc END AS accuracy_drop,
  CASE WHEN n_labeled >= 20 THEN 0.75::double - rec END AS recall_drop,
  (r_ok + r_defect + n_ok + n_defect) * power(greatest(abs(r_ok * n_defect - r_defect * n_ok) - (r_ok + r_defect + n_ok + n_defect) / 2, 0), 2)
    / ((r_ok + r_defect) * (n_ok + n_defect) * (r_ok + n_ok) * (r_defect + n_defect)) AS class_mix_chi2
  FROM perf p JOIN roll USING ({key}) CROSS JOIN rm),
final AS (SELECT *, concat_ws(',',
  CASE WHEN psi_max >= 0.25 THEN 'data_drift:high' WHEN psi_max >= 0.1 THEN 'data_drift:warning' END,
  CASE WHEN mean_confidence_drop >= 0.08 THEN 'confidence_collapse:medium' END,
  CASE WHEN review_rate >= 0.2 THEN 'review_queue_overflow:medium' END,
  CASE WHEN accuracy_drop >= 0.05 THEN 'accuracy_degradation:high' END) AS alert_names FROM sig)"""


_SIG_DOUBLES = (
    "psi_max psi_mean mean_confidence mean_confidence_drop mean_probability predicted_defect_rate review_rate "
    "accuracy precision recall f1 roc_auc accuracy_drop recall_drop class_mix_chi2"
).split()
_SIG_OTHER = ["n_samples", "n_drifted", "n_significant", "drifted_features", "worst_feature", "n_labeled"]
_SIG_SELECT = ", ".join([*(f"{r(c)} AS {c}" for c in _SIG_DOUBLES), *_SIG_OTHER, "alert_names"])
_SIG_VIEWS = "preds ref_share edges ref_rows"


def _signal_columns(report, key):
    names = F.transform("alerts", lambda a: F.concat(a["signal"], F.lit(":"), a["severity"]))
    return report.select(key, *_SIG_DOUBLES, *_SIG_OTHER, F.array_join(names, ",").alias("alert_names"))


def scenario_report(spark, sf, **options):
    return monitor.scenario_report(X.preds(spark, sf), X.reference(spark, sf), keys=KEYS, **options)


def window_report(spark, sf, **options):
    return monitor.window_report(X.preds(spark, sf), X.reference(spark, sf), keys=KEYS, **options)


@register("mon4_scenario_report", _SIG_VIEWS, f"WITH {_SCN}, {_signals('g')} SELECT g AS scenario, {_SIG_SELECT} FROM final")
def mon4(spark, sf):
    return _signal_columns(scenario_report(spark, sf, with_ks=False), "scenario")


@register("mon5_window_report", _SIG_VIEWS, f"WITH {_WIN}, {_signals('window_index')} SELECT window_index, {_SIG_SELECT} FROM final")
def mon5(spark, sf):
    return _signal_columns(window_report(spark, sf, with_ks=False), "window_index")


@register("mon2_window_signals")
def mon2(spark, sf):
    """Per-feature detail of every window, KS included."""
    out = window_report(spark, sf).select("window_index", F.explode("features").alias("e"))
    return out.select("window_index", "e.feature", "e.psi", "e.severity", "e.ks_statistic", "e.ks_pvalue", "e.ks_flag", "e.n_current")


@register(
    "mon2_window_ks",
    "preds ref_long",
    f"""WITH {_WIN}, rc AS (SELECT feature, value, count(*) AS n FROM ref_long GROUP BY 1, 2),
    pts AS (SELECT window_index, feature, value, sum(a) AS a, sum(b) AS b FROM (
      SELECT window_index, feature, value, 0 AS a, count(*) AS b FROM wl GROUP BY 1, 2, 3
      UNION ALL SELECT s.window_index, rc.feature, rc.value, rc.n, 0 FROM rc CROSS JOIN (SELECT DISTINCT window_index FROM wl) s) GROUP BY 1, 2, 3),
    run AS (SELECT window_index, feature, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER p AS ta, sum(b) OVER p AS tb
      FROM pts WINDOW o AS (PARTITION BY window_index, feature ORDER BY value), p AS (PARTITION BY window_index, feature))
    SELECT window_index, feature, {r('max(abs(ca / ta::double - cb / tb::double))')} AS ks_statistic FROM run GROUP BY 1, 2""",
)
def mon2_ks(spark, sf):
    from lineguard.operators.logs import count_windows

    windows = count_windows(X.preds(spark, sf), keys=KEYS)
    ks = drift.ks_two_sample(windows, ["window_index"], X.reference(spark, sf), FEATURES, bounded=True)
    return ks.select("window_index", "feature", "ks_statistic")


@register("mon3_alerts", _SIG_VIEWS, f"WITH {_WIN}, {_signals('window_index')} SELECT window_index, alert_names FROM final WHERE alert_names <> ''")
def mon3(spark, sf):
    out = _signal_columns(window_report(spark, sf, with_ks=False), "window_index")
    return out.select("window_index", "alert_names").where("alert_names <> ''")


@register("jn11_model_reference", _SIG_VIEWS, f"WITH {_WIN}, {_signals('window_index')} SELECT window_index, {r('accuracy_drop')} AS accuracy_drop, {r('recall_drop')} AS recall_drop FROM final")
def jn11(spark, sf):
    return window_report(spark, sf, with_ks=False).select("window_index", "accuracy_drop", "recall_drop")


@register(
    "mon4_report_summary",
    _SIG_VIEWS,
    f"""WITH {_SCN}, {_signals('g')} SELECT g AS scenario, (round(psi_max, 4) + 0.0::double) AS psi_max, drifted_features, (round(accuracy, 4) + 0.0::double) AS accuracy,
    (round(mean_confidence, 4) + 0.0::double) AS mean_confidence, regexp_replace(alert_names, ':[a-z]+', '', 'g') AS alerts FROM final""",
)
def mon4_summary(spark, sf):
    out = monitor.report_summary(scenario_report(spark, sf, with_ks=False), BY)
    return out.drop("accuracy_drop", "review_rate")


@register(
    "agg36_detector_coverage",
    _SIG_VIEWS,
    f"""WITH {_SCN}, {_signals('g')} SELECT count(*) AS n_scenarios, count(*) FILTER (contains(alert_names, 'confidence_collapse')) AS by_confidence,
    count(*) FILTER (contains(alert_names, 'data_drift')) AS by_data_drift FROM final WHERE g <> 'view'""",
)
def agg36(spark, sf):
    return monitor.detector_coverage(scenario_report(spark, sf, with_ks=False), "view")


# -- policy ------------------------------------------------------------------------

#: A missing metric is part of the test: it must read as unavailable.
RULES = (*params.RULES, ("custom_gap", "not_logged", ">", 0.1, "medium"), ("low_review", "review_rate", "<", 0.5, "medium"))


def _rule_sql(name, metric, op, threshold):
    value = metric if metric != "not_logged" else "NULL::double"
    return (
        f"SELECT window_index, '{name}' AS rule, {r(value)} AS value, coalesce({value} {op} {threshold}::double, false) AS breached, "
        f"coalesce('{metric}=' || printf('%.4f', {value}) || ' {op} {threshold:.4f}: ' || CASE WHEN {value} {op} {threshold}::double THEN 'BREACH' ELSE 'ok' END, "
        f"'{metric} is unavailable') AS detail FROM final"
    )


_RULES_SQL = " UNION ALL ".join(_rule_sql(n, m, o, t) for n, m, o, t, _ in RULES)


@register("pol1_evaluate_rules", _SIG_VIEWS, f"WITH {_WIN}, {_signals('window_index')} {_RULES_SQL}")
def pol1(spark, sf):
    evals = policy.evaluate_rules(window_report(spark, sf, with_ks=False), RULES)
    return evals.select("window_index", "rule", "value", "breached", "detail")


@register(
    "jn9_rules_by_windows",
    _SIG_VIEWS,
    f"WITH {_WIN}, {_signals('window_index')}, ev AS ({_RULES_SQL}) SELECT rule, count(*) AS n_windows, count(*) FILTER (breached) AS n_breached FROM ev GROUP BY 1",
)
def jn9(spark, sf):
    evals = policy.evaluate_rules(window_report(spark, sf, with_ks=False), RULES)
    return evals.groupBy("rule").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("breached").alias("n_breached"))


_FIRED = f"""ev AS ({_RULES_SQL}), recent AS (SELECT * FROM ev WHERE window_index > (SELECT max(window_index) FROM ev) - 2),
fired AS (SELECT rule, last(value ORDER BY window_index) AS value FROM recent GROUP BY 1 HAVING count(*) = 2 AND bool_and(breached))"""


@register("win4_persistent_breach", _SIG_VIEWS, f"WITH {_WIN}, {_signals('window_index')}, {_FIRED} SELECT rule, value, 2::bigint AS consecutive_windows FROM fired")
def win4(spark, sf):
    out = policy.persistent_breach(window_report(spark, sf, with_ks=False), RULES)
    return out.select("rule", "value", "consecutive_windows")


_ACTION = """CASE WHEN list_contains(f, 'accuracy_degradation') THEN 'retrain'
  WHEN list_contains(f, 'data_drift_psi') AND n_labeled >= 20 AND accuracy_drop < 0.02 THEN 'monitor'
  WHEN list_contains(f, 'data_drift_psi') AND psi_max >= 0.5 THEN 'investigate_capture'
  WHEN list_contains(f, 'data_drift_psi') THEN 'retrain'
  WHEN list_contains(f, 'confidence_collapse') OR list_contains(f, 'review_queue_overflow') THEN 'recalibrate_or_retrain' ELSE 'none' END"""


@register(
    "pol2_recommend_action",
    _SIG_VIEWS,
    f"""WITH {_WIN}, {_signals('window_index')}, ev AS ({_RULES_SQL}), byw AS (SELECT window_index, list(rule) FILTER (breached) AS f FROM ev GROUP BY 1)
    SELECT window_index, {_ACTION} AS action FROM (SELECT window_index, coalesce(f, []) AS f, n_labeled, accuracy_drop, psi_max FROM final JOIN byw USING (window_index))""",
)
def pol2(spark, sf):
    """The action each window's own breaches would call for."""
    report = window_report(spark, sf, with_ks=False)
    results = F.array(*[policy.rule_result(x, report.columns) for x in RULES])
    fired = F.transform(F.filter(results, lambda e: e["breached"]), lambda e: e["rule"])
    action = policy.recommended_action(F.col("_f"), F.col("psi_max"), F.col("accuracy_drop"), F.col("n_labeled"))
    return report.withColumn("_f", fired).select("window_index", action.alias("action"))


#: Fixed evaluation time: 2024-02-01 00:00 UTC, last retrain ten hours before.
NOW = 1_706_745_600.0


def _decision_sql(hours: float | None, need: int) -> str:
    """The decision row; *hours* since the last retrain (None: never), *need* labels at least."""
    waits = "false" if hours is None else f"{hours} < {float(params.RETRAINING['cooldown_hours'])}"
    since = "NULL::double" if hours is None else f"{hours}::double"
    return f"""WITH {_WIN}, {_signals('window_index')}, {_FIRED}, one AS (SELECT list_sort(list(rule)) AS f FROM fired),
    latest AS (SELECT * FROM final ORDER BY window_index DESC LIMIT 1), seen AS (SELECT count(*) AS n_windows, sum(n_labeled)::bigint AS labels FROM final),
    act AS (SELECT {_ACTION} AS action, f, psi_max, accuracy_drop FROM (SELECT coalesce(f, []) AS f, n_labeled, accuracy_drop, psi_max FROM one CROSS JOIN latest)),
    gate AS (SELECT *, CASE WHEN action = 'retrain' THEN ({waits})::int + (labels < {need})::int ELSE 0 END AS n FROM act CROSS JOIN seen)
    SELECT action = 'retrain' AND n = 0 AS should_retrain, action, array_to_string(f, ',') AS fired_rules, n_windows AS windows_evaluated, labels AS labeled_available,
    n::bigint AS n_blockers, {since} AS hours_since_last_retrain, {r('psi_max')} AS latest_psi_max, {r('accuracy_drop')} AS latest_accuracy_drop
    FROM gate"""


def _decision(spark, sf, last_retrain: float | None, need: int):
    out = policy.decide(window_report(spark, sf, with_ks=False), now=NOW, last_retrain=last_retrain, rules=RULES,
                        policy={**params.RETRAINING, "min_new_labeled_samples": need})
    return out.select(
        "should_retrain", "action", "fired_rules", "windows_evaluated", "labeled_available",
        F.size("blockers").alias("n_blockers"), "hours_since_last_retrain", "latest_psi_max", "latest_accuracy_drop",
    )


@register("pol3_gate_decision", _SIG_VIEWS, _decision_sql(10.0, 50))
def pol3(spark, sf):
    """A retrain ten hours ago holds the next one back."""
    return _decision(spark, sf, NOW - 36_000.0, 50)


@register("pol3_open_gate", _SIG_VIEWS, _decision_sql(None, 50))
def pol3_open(spark, sf):
    """Nothing was retrained yet, so labels alone decide."""
    return _decision(spark, sf, None, 50)


@register(
    "prj17_next_steps",
    _SIG_VIEWS,
    f"""WITH decided AS ({_decision_sql(None, 50)}),
    steps(action, ids) AS (VALUES {", ".join(f"('{a}', {ids!r})" for a, ids in policy.FOLLOW_UP.items())})
    SELECT action, (unnest(range(len(ids))))::bigint AS step, unnest(ids) AS text FROM decided JOIN steps USING (action)""",
)
def prj17(spark, sf):
    out = policy.decide(window_report(spark, sf, with_ks=False), now=NOW, rules=RULES)
    return out.select("action", F.posexplode("next_steps").alias("step", "text"))


@register("src10_report_json")
def src10(spark, sf):
    """The nested scenario report as one JSON document per scenario."""
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "report")
    tables.write_report_json(scenario_report(spark, sf), path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$.scenario").alias("scenario"),
        F.get_json_object("value", "$.psi_max").cast("double").alias("psi_max"),
        F.get_json_object("value", "$.features[0].feature").alias("first_feature"),
    )


@register("pol4_record_retrain", "", "SELECT count(*) AS n_rows, 1706745600.0::double AS last_ts FROM (SELECT DISTINCT event_type FROM events)")
def pol4(spark, sf):
    """One history row per scenario that fired, then the read of the latest time."""
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "history")
    seen = X.preds(spark, sf).select("scenario").distinct()
    nth = F.row_number().over(Window.orderBy("scenario")) - 1  # a handful of configured scenarios
    events = seen.select((F.lit(NOW) - 3600.0 * nth).alias("ts"), F.concat(F.lit("drift in "), "scenario").alias("reason"))
    tables.record_retrains(events, path)
    return tables.retrain_history(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("last_ts"))
