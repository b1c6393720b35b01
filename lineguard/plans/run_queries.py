"""Queries over the run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineguard.functions import columns as C
from lineguard.operators import runs
from lineguard.plans import fixtures as X
from lineguard.plans.registry import register
from lineguard.plans.views_sql import r


def _gated(spark, sf):
    return runs.evaluate_gates(runs.clean_runs(X.runs(spark, sf)), X.GATES)


@register(
    "prj5_coalesce_metric",
    "runs",
    f"SELECT run_id, {r('coalesce(test_precision, 0.0::double)')} AS test_precision, {r('coalesce(test_f1, 0.0::double)')} AS test_f1, 0.5::double AS threshold FROM runs",
)
def prj5(spark, sf):
    df = X.runs(spark, sf)
    return df.select(
        "run_id",
        runs.metric_or_default(df, "test_precision").alias("test_precision"),
        runs.metric_or_default(df, "test_f1").alias("test_f1"),
        runs.metric_or_default(df, "threshold", 0.5).alias("threshold"),
    )


@register(
    "pro1_clean_runs",
    "best_runs",
    f"SELECT model, arch, run_id, {r('test_f1')} AS test_f1, {r('test_recall')} AS test_recall, {r('test_precision')} AS test_precision, {r('latency_p95_ms')} AS latency_p95_ms FROM best_runs",
)
def pro1(spark, sf):
    return runs.clean_runs(X.runs(spark, sf)).select("model", "arch", "run_id", "test_f1", "test_recall", "test_precision", "latency_p95_ms")


@register("win5_best_run_per_model", "best_runs", f"SELECT model, run_id::bigint AS run_id, {r('test_f1')} AS test_f1 FROM best_runs")
def win5(spark, sf):
    scored = X.runs(spark, sf).where(F.col("test_f1").isNotNull())
    return runs.best_run_per_model(scored).select("model", "run_id", "test_f1")


@register("pro2_evaluate_gates", "gated", "SELECT model, eligible, CASE WHEN eligible THEN 'eligible' ELSE why END AS reason FROM gated")
def pro2(spark, sf):
    return _gated(spark, sf).select("model", "eligible", "reason")


@register("prj16_gate_reason", "gated", "SELECT CASE WHEN eligible THEN 'eligible' ELSE why END AS reason, count(*) AS n FROM gated GROUP BY 1")
def prj16(spark, sf):
    failures = F.col("failures")
    return _gated(spark, sf).groupBy(runs.gate_reason(failures).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("jn10_eligible_models", "gated", f"SELECT model, run_id, {r('test_f1')} AS test_f1 FROM gated WHERE eligible")
def jn10(spark, sf):
    return runs.eligible_models(runs.clean_runs(X.runs(spark, sf)), _gated(spark, sf)).select("model", "run_id", "test_f1")


@register("win7_rank_runs", "best_runs", f"SELECT model, {r('test_f1')} AS test_f1 FROM best_runs")
def win7(spark, sf):
    return runs.rank_runs(runs.clean_runs(X.runs(spark, sf))).select("model", "test_f1")


_PICK = """
lead_row AS (SELECT * FROM gated WHERE eligible ORDER BY test_f1 DESC, model LIMIT 1),
ties AS (SELECT g.* FROM gated g, lead_row l WHERE g.eligible AND g.test_f1 >= l.ci_lo),
pick AS (SELECT * FROM ties ORDER BY latency_p95_ms, test_f1 DESC, model LIMIT 1)"""


@register(
    "pro3_select_best",
    "gated",
    f"""WITH {_PICK} SELECT model, run_id, {r('test_f1')} AS test_f1, {r('latency_p95_ms')} AS latency_p95_ms,
    (SELECT count(*) FROM gated WHERE eligible) AS n_eligible, (SELECT count(*) FROM ties) AS n_contenders FROM pick""",
)
def pro3(spark, sf):
    return runs.select_best(_gated(spark, sf)).drop("rationale")


@register(
    "pro4_comparison_report",
    "gated",
    f"""WITH {_PICK} SELECT model, run_id, {r('test_f1')} AS test_f1, printf('%.4f', test_f1) || ' [' || printf('%.4f', ci_lo) || ', ' || printf('%.4f', ci_hi) || ']' AS interval,
    eligible, CASE WHEN eligible THEN 'eligible' ELSE why END AS reason, model = (SELECT model FROM pick) AS selected FROM gated""",
)
def pro4(spark, sf):
    return runs.comparison_report(_gated(spark, sf)).drop("test_recall", "latency_p95_ms")


@register(
    "prj15_format_ci",
    "runs",
    """SELECT run_id, CASE WHEN ci_lo IS NULL THEN '-' ELSE printf('%.4f', test_f1) || ' [' || printf('%.4f', ci_lo) || ', ' || printf('%.4f', ci_hi) || ']' END AS cell FROM runs""",
)
def prj15(spark, sf):
    cell = C.format_ci(F.col("test_f1"), F.col("ci_lo"), F.col("ci_hi"))
    return X.runs(spark, sf).select("run_id", cell.alias("cell"))


@register("src11_comparison_csv", "gated", f"SELECT model, {r('test_f1')} AS test_f1, eligible FROM gated")
def src11(spark, sf):
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "comparison")
    tables.write_comparison_csv(_gated(spark, sf).select("model", "test_f1", "eligible"), path)
    return spark.read.schema("model string, test_f1 double, eligible boolean").option("header", True).csv(path)


@register(
    "win9_best_epoch",
    "",
    f"""WITH h AS (SELECT p_partkey // 40 AS run_id, p_partkey % 40 AS epoch, p_size / 50.0::double AS score FROM part),
    s AS (SELECT *, row_number() OVER w AS i, score > coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM h WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
    b AS (SELECT *, max(CASE WHEN better THEN i END) OVER (PARTITION BY run_id ORDER BY epoch) AS last_i FROM s),
    st AS (SELECT *, min(CASE WHEN i - last_i >= 4 THEN i END) OVER (PARTITION BY run_id) AS stop_i FROM b),
    k AS (SELECT * FROM st WHERE stop_i IS NULL OR i <= stop_i)
    SELECT run_id, max(CASE WHEN better THEN epoch END) AS best_epoch, {r('max(score)')} AS best_score, max(epoch) AS last_epoch, bool_or(stop_i IS NOT NULL) AS stopped_early FROM k GROUP BY 1""",
)
def win9(spark, sf):
    return runs.best_epoch(X.epochs(spark, sf))
