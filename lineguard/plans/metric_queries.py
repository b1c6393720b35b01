"""Queries for metrics, curves, thresholds and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineguard.operators import bootstrap, metrics, monitor
from lineguard.operators.ordered import running_sums
from lineguard.plans import fixtures as X
from lineguard.plans.registry import register
from lineguard.plans.views_sql import r

P, Y, BY = "probability", "ground_truth", ["scenario"]


def _labelled(spark, sf):
    return X.preds(spark, sf).where(F.col(Y).isNotNull())


_CELLS = """
cells4 AS (SELECT scenario, count(*) FILTER (ground_truth = 1 AND probability >= 0.5::double) AS tp,
  count(*) FILTER (ground_truth = 0 AND probability >= 0.5::double) AS fp,
  count(*) FILTER (ground_truth = 1 AND probability < 0.5::double) AS fn,
  count(*) FILTER (ground_truth = 0 AND probability < 0.5::double) AS tn,
  avg((probability - ground_truth) * (probability - ground_truth)) AS brier
  FROM preds WHERE ground_truth IS NOT NULL GROUP BY 1)"""


@register("agg21_confusion_counts", "preds", f"WITH {_CELLS} SELECT scenario, tp, fp, fn, tn FROM cells4")
def agg21(spark, sf):
    return metrics.confusion_counts(_labelled(spark, sf), BY, P, Y, 0.5)


RANK_SQL = """
rank_metrics AS (SELECT scenario,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(pos * (neg_below + neg / 2.0::double)) / (max(n_pos) * max(n_neg)::double) END AS roc_auc,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(pos * (tp / (tp + fp)::double)) / max(n_pos)::double END AS average_precision
  FROM ranked GROUP BY 1)"""


def _or0(num, den):
    return f"CASE WHEN {den} <> 0 THEN {num} / ({den})::double ELSE 0.0::double END"


_PREC, _REC, _SPEC = _or0("tp", "tp + fp"), _or0("tp", "tp + fn"), _or0("tn", "tn + fp")
_N = "(tp + fp + fn + tn)"

METRICS_SQL = f"""
m AS (SELECT c.*, k.roc_auc, k.average_precision, {_PREC} AS precision, {_REC} AS recall, {_SPEC} AS specificity,
  sqrt((tp + fp)::double * (tp + fn)::double * (tn + fp)::double * (tn + fn)::double) AS mcc_den
  FROM cells4 c JOIN rank_metrics k USING (scenario)),
full_metrics AS (SELECT scenario, 0.5::double AS threshold, (tp + tn) / {_N}::double AS accuracy, (recall + specificity) / 2 AS balanced_accuracy,
  precision, recall, specificity, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::double END AS f1,
  CASE WHEN mcc_den > 0 THEN (tp::double * tn - fp::double * fn) / mcc_den ELSE 0.0::double END AS mcc,
  {_or0('fn', 'tp + fn')} AS false_negative_rate, {_or0('fp', 'tn + fp')} AS false_positive_rate, roc_auc, average_precision, brier,
  tp, fp, fn, tn, {_N} AS n_samples, (tp + fn) / {_N}::double AS positive_rate, (tp + fp) / {_N}::double AS predicted_positive_rate FROM m)"""

_ROUNDED = ", ".join(
    f"{r(c)} AS {c}"
    for c in (
        "threshold accuracy balanced_accuracy precision recall specificity f1 mcc false_negative_rate "
        "false_positive_rate roc_auc average_precision brier positive_rate predicted_positive_rate"
    ).split()
)


@register(
    "agg22_classification_metrics",
    "preds ranked",
    f"WITH {_CELLS}, {RANK_SQL}, {METRICS_SQL} SELECT scenario, {_ROUNDED}, tp, fp, fn, tn, n_samples FROM full_metrics",
)
def agg22(spark, sf):
    return metrics.classification_metrics(_labelled(spark, sf), BY, P, Y, 0.5)


@register("agg23_roc_auc", "ranked", f"WITH {RANK_SQL} SELECT scenario, {r('roc_auc')} AS roc_auc FROM rank_metrics")
def agg23(spark, sf):
    return metrics.rank_metrics(X.preds(spark, sf), BY, P, Y).select("scenario", "roc_auc")


@register(
    "agg24_average_precision", "ranked", f"WITH {RANK_SQL} SELECT scenario, {r('average_precision')} AS average_precision FROM rank_metrics"
)
def agg24(spark, sf):
    return metrics.rank_metrics(X.preds(spark, sf), BY, P, Y).select("scenario", "average_precision")


@register(
    "cur1_pr_curve",
    "ranked",
    f"SELECT scenario, {r('s')} AS threshold, {r('tp / (tp + fp)::double')} AS precision, {r('tp / greatest(n_pos, 1)::double')} AS recall FROM ranked",
)
def cur1(spark, sf):
    return metrics.pr_curve(X.preds(spark, sf), BY, P, Y)


@register(
    "cur2_roc_curve",
    "ranked",
    f"""SELECT scenario, {r('s')} AS threshold, {r('fp / greatest(n_neg, 1)::double')} AS fpr, {r('tp / greatest(n_pos, 1)::double')} AS tpr FROM ranked
    UNION ALL SELECT DISTINCT scenario, 'inf'::double, 0.0::double, 0.0::double FROM ranked""",
)
def cur2(spark, sf):
    return metrics.roc_curve(X.preds(spark, sf), BY, P, Y)


_GRID = f"""
grid AS (SELECT i AS idx, CASE WHEN i = 500 THEN 1.0::double ELSE i * 0.002::double END AS t FROM range(501) g(i)),
gc AS (SELECT scenario, idx, t, sum(CASE WHEN s >= t THEN pos ELSE 0 END)::bigint AS tp, sum(CASE WHEN s >= t THEN neg ELSE 0 END)::bigint AS fp,
  sum(CASE WHEN s < t THEN pos ELSE 0 END)::bigint AS fn, sum(CASE WHEN s < t THEN neg ELSE 0 END)::bigint AS tn FROM scored CROSS JOIN grid GROUP BY 1, 2, 3),
gp AS (SELECT *, {_PREC} AS precision, {_REC} AS recall FROM gc),
gf AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::double END AS f1 FROM gp)"""
_CHOICE = f"SELECT scenario, {r('t')} AS threshold, tp, fp, fn, tn, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1"
_CHOICE_COLUMNS = ["scenario", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1"]


@register(
    "agg25_threshold_max_f1",
    "scored",
    f"WITH {_GRID} {_CHOICE} FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY f1 DESC, idx) AS rn FROM gf) WHERE rn = 1",
)
def agg25(spark, sf):
    return metrics.choose_threshold(X.preds(spark, sf), BY, P, Y, "max_f1").select(*_CHOICE_COLUMNS)


@register(
    "agg25_threshold_target_recall",
    "scored",
    f"""WITH {_GRID} {_CHOICE}, reachable FROM (SELECT *, recall >= 0.98::double AS reachable, row_number() OVER (PARTITION BY scenario
    ORDER BY recall >= 0.98::double DESC, CASE WHEN recall >= 0.98::double THEN precision ELSE recall END DESC, idx) AS rn FROM gf) WHERE rn = 1""",
)
def agg25_recall(spark, sf):
    out = metrics.choose_threshold(X.preds(spark, sf), BY, P, Y, "target_recall")
    return out.select(*_CHOICE_COLUMNS, "reachable")


@register("agg25_threshold_grid", "scored", f"WITH {_GRID} SELECT scenario, idx, {r('t')} AS threshold, tp, fp, fn, tn, {r('f1')} AS f1 FROM gf")
def agg25_grid(spark, sf):
    out = metrics.threshold_grid(X.preds(spark, sf), BY, P, Y)
    return out.select("scenario", "idx", "threshold", "tp", "fp", "fn", "tn", "f1")


@register("agg26_bootstrap_ci")
def agg26(spark, sf):
    return bootstrap.bootstrap_cells(X.preds(spark, sf), BY, P, Y, 0.5, "f1")


@register("agg26_bootstrap_auc")
def agg26_auc(spark, sf):
    return bootstrap.bootstrap_ranked(X.preds(spark, sf), BY, P, Y, "roc_auc")


@register(
    "agg26_bootstrap_properties",
    "ranked",
    f"""SELECT scenario, {r("sum(pos * (neg_below + neg / 2.0::double)) / (max(n_pos)::double * max(n_neg))")} AS roc_auc,
    {r("sum(pos * (tp / (tp + fp)::double)) / max(n_pos)::double")} AS average_precision, 500::bigint AS n_auc, 500::bigint AS n_ap, true AS inside, true AS narrow
    FROM ranked GROUP BY 1 HAVING max(n_pos) > 0 AND max(n_neg) > 0""",
)
def agg26_properties(spark, sf):
    """Intervals of both rank metrics: around the point, 500 draws each, and of a width that the counts explain."""
    auc, ap = (bootstrap.bootstrap_ranked(X.preds(spark, sf), BY, P, Y, m).where("point IS NOT NULL") for m in ("roc_auc", "average_precision"))
    both = auc.alias("a").join(ap.alias("b"), "scenario")
    return both.select(
        "scenario", F.col("a.point").alias("roc_auc"), F.col("b.point").alias("average_precision"), F.col("a.n_bootstrap").alias("n_auc"),
        F.col("b.n_bootstrap").alias("n_ap"), F.expr("a.lo <= a.point AND a.point <= a.hi AND b.lo <= b.point AND b.point <= b.hi").alias("inside"),
        F.expr("a.lo < a.hi AND a.hi - a.lo < 0.5 AND b.lo < b.hi AND b.hi - b.lo < 0.6").alias("narrow"),
    )


@register(
    "win6_running_sums",
    "scored",
    """SELECT scenario, round(s, 6) + 0.0::double AS score, pos, neg, sum(pos) OVER (PARTITION BY scenario ORDER BY s)::bigint AS cum_pos,
    sum(neg) OVER (PARTITION BY scenario ORDER BY s)::bigint AS cum_neg FROM scored""",
)
def win6(spark, sf):
    counts = metrics.score_counts(X.preds(spark, sf), BY, P, Y)
    return running_sums(counts, BY, ["score"], ["pos", "neg"]).drop("tot_pos", "tot_neg")


_PERF = f"""
means AS (SELECT scenario, avg(greatest(probability, 1.0::double - probability)) AS mean_confidence, avg(probability) AS mean_probability
  FROM preds WHERE ground_truth IS NOT NULL GROUP BY 1),
base AS (SELECT accuracy, recall, f1 FROM full_metrics WHERE scenario = 'view')"""


def _drop(name):
    return f"CASE WHEN f.scenario <> 'view' THEN {r(f'b.{name} - f.{name}')} END AS {name}_drop"


@register(
    "mon6_scenario_performance",
    "preds ranked",
    f"""WITH {_CELLS}, {RANK_SQL}, {METRICS_SQL}, {_PERF}
    SELECT f.scenario, f.n_samples, {r('f.accuracy')} AS accuracy, {r('f.recall')} AS recall, {r('f.f1')} AS f1, {r('f.predicted_positive_rate')} AS predicted_positive_rate,
    {r('mean_confidence')} AS mean_confidence, {r('mean_probability')} AS mean_probability, {_drop('accuracy')}, {_drop('recall')}, {_drop('f1')}
    FROM full_metrics f JOIN means USING (scenario) CROSS JOIN base b""",
)
def mon6(spark, sf):
    out = monitor.scenario_performance(X.preds(spark, sf), "view")
    return out.select(
        "scenario", "n_samples", "accuracy", "recall", "f1", "predicted_positive_rate", "mean_confidence",
        "mean_probability", "accuracy_drop", "recall_drop", "f1_drop",
    )


@register(
    "jn8_baseline_comparison",
    "preds ranked",
    f"""WITH {_CELLS}, {RANK_SQL}, {METRICS_SQL}, base AS (SELECT accuracy, recall, f1 FROM full_metrics WHERE scenario = 'view')
    SELECT f.scenario, {_drop('accuracy')}, {_drop('recall')}, {_drop('f1')} FROM full_metrics f CROSS JOIN base b""",
)
def jn8(spark, sf):
    table = metrics.classification_metrics(_labelled(spark, sf), BY, P, Y, 0.5)
    return monitor.compare_to_baseline(table, "view").select("scenario", "accuracy_drop", "recall_drop", "f1_drop")
