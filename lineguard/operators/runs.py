"""The run table: cleaning, best run per model, promotion gates, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import coalesce_metric, finite, fixed_text, format_ci, present

#: Rounding and default per run metric.
RUN_METRICS = {
    "threshold": (4, 0.5),
    "test_f1": (4, 0.0),
    "test_recall": (4, 0.0),
    "test_precision": (4, 0.0),
    "test_accuracy": (4, 0.0),
    "test_roc_auc": (4, 0.0),
    "latency_p95_ms": (2, 0.0),
    "throughput_ips": (1, 0.0),
    "train_s": (1, 0.0),
}


def metric_or_default(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A metric column with null, NaN and an absent column all read as *default*."""
    return coalesce_metric(F.col(name), default) if name in df.columns else F.lit(float(default))


def finished_runs(runs: DataFrame) -> DataFrame:
    """Training runs that completed: a test F1 and a model name are present."""
    named = F.col("model").isNotNull()
    scored = F.col("test_f1").isNotNull() & ~F.isnan("test_f1")
    out = runs.where(named & scored)
    metrics = {m: F.bround(metric_or_default(runs, m, d), places) for m, (places, d) in RUN_METRICS.items()}
    total = F.bround(metric_or_default(runs, "total_params") / 1e6, 3)
    epoch = metric_or_default(runs, "best_epoch").cast("int")
    arch = F.coalesce(F.col("arch"), F.lit("?")) if "arch" in runs.columns else F.lit("?")
    extra = [c for c in ("ci_lo", "ci_hi", "start_time") if c in runs.columns]
    return out.select(
        F.col("model").cast("string").alias("model"),
        arch.alias("arch"),
        F.substring(F.col("run_id").cast("string"), 1, 8).alias("run_id"),
        total.alias("params_M"),
        *[c.alias(m) for m, c in metrics.items()],
        epoch.alias("best_epoch"),
        *extra,
    )


def best_run_per_model(runs: DataFrame, metric: str = "test_f1", recency: str = "start_time") -> DataFrame:
    """The best run of each model, ties going to the most recent. A maximum, so no sort per model."""
    best = runs.groupBy("model").agg(
        F.max_by(F.struct(*runs.columns), F.struct(metric, recency, "run_id")).alias("_run")
    )
    return best.select("_run.*")


def clean_runs(runs: DataFrame) -> DataFrame:
    return best_run_per_model(finished_runs(runs))


def evaluate_gates(table: DataFrame, gates: dict = params.GATES) -> DataFrame:
    """Adds ``failures``, ``eligible`` and ``reason``; a missing latency counts as infinite."""
    f1, recall, p95 = F.col("test_f1"), F.col("test_recall"), F.col("latency_p95_ms")
    min_f1, min_recall = float(gates.get("min_test_f1", 0.0)), float(gates.get("min_test_recall", 0.0))
    max_p95 = float(gates.get("max_latency_p95_ms", float("inf")))
    latency = F.coalesce(p95, F.lit(float("inf")))
    failures = present(
        F.when(f1 < min_f1, F.concat(F.lit("test_f1 "), fixed_text(f1, 4), F.lit(f" < {min_f1:.4f}"))),
        F.when(
            recall < min_recall, F.concat(F.lit("test_recall "), fixed_text(recall, 4), F.lit(f" < {min_recall:.4f}"))
        ),
        F.when(
            latency > max_p95,
            F.concat(F.lit("latency_p95_ms "), F.coalesce(fixed_text(p95, 1), F.lit("inf")), F.lit(f" > {max_p95:.1f}")),
        ),
    )
    gated = table.withColumn("failures", failures).withColumn("eligible", F.size("failures") == 0)
    return gated.withColumn("reason", gate_reason(F.col("failures")))


def gate_reason(failures: Column) -> Column:
    return F.when(F.size(failures) == 0, F.lit("eligible")).otherwise(F.array_join(failures, "; "))


def eligible_models(table: DataFrame, gated: DataFrame) -> DataFrame:
    """Rows of the table whose model cleared the gates."""
    return table.join(gated.where("eligible").select("model"), "model", "left_semi")


def rank_runs(table: DataFrame, metric: str = "test_f1") -> DataFrame:
    """Models best first, ties in name order."""
    return table.orderBy(F.desc(metric), "model")


def select_best(gated: DataFrame, metric: str = "test_f1") -> DataFrame:
    """One row: the chosen model and why.

    The leader has the best metric among eligible models. When ``ci_lo`` is known, models at or above
    the leader's bound tie with it and the lowest p95 latency wins.
    """
    ok = gated.where("eligible")
    ci = F.col("ci_lo").cast("double") if "ci_lo" in gated.columns else F.lit(None).cast("double")
    row = F.struct("model", "run_id", F.col(metric).alias("score"), F.col("latency_p95_ms").alias("p95"), ci.alias("ci_lo"))
    best_first = F.struct((-F.col(metric)).alias("m"), "model")
    lead = ok.agg(F.count(F.lit(1)).alias("n_eligible"), F.min_by(row, best_first).alias("leader"))
    # The leader is one row.
    tied = ok.join(F.broadcast(lead.select("leader"))).where(F.col(metric) >= F.col("leader.ci_lo"))
    cheapest = tied.agg(
        F.count(F.lit(1)).alias("n_contenders"),
        F.min_by(row, F.struct("latency_p95_ms", (-F.col(metric)).alias("m"), "model")).alias("cheapest"),
    )
    both = lead.join(cheapest)
    contested = F.col("n_contenders") > 1
    pick = F.when(contested, F.col("cheapest")).otherwise(F.col("leader"))
    changed = contested & (F.col("cheapest.model") != F.col("leader.model"))
    lead_text = F.concat(F.lit(f"highest {metric} ("), fixed_text(F.col("leader.score"), 4), F.lit(")"))
    why = (
        F.when(F.col("n_eligible") == 0, F.lit("no candidate cleared the gates"))
        .when(
            changed,
            F.concat(
                F.col("n_contenders").cast("string"),
                F.lit(" candidates within the leader's interval; lowest p95 latency "),
                fixed_text(F.col("cheapest.p95"), 1),
                F.lit(" ms against "),
                fixed_text(F.col("leader.p95"), 1),
                F.lit(" ms"),
            ),
        )
        .when(contested, F.concat(lead_text, F.lit("; also the fastest of the tied candidates")))
        .otherwise(lead_text)
    )
    return both.withColumn("pick", pick).select(
        F.col("pick.model").alias("model"),
        F.col("pick.run_id").alias("run_id"),
        F.col("pick.score").alias(metric),
        F.col("pick.p95").alias("latency_p95_ms"),
        "n_eligible",
        F.col("n_contenders"),
        why.alias("rationale"),
    )


def comparison_report(gated: DataFrame, metric: str = "test_f1") -> DataFrame:
    """Gate outcome, interval text and selection flag of every model."""
    chosen = select_best(gated, metric).select(F.col("model").alias("_chosen"))
    lo = F.col("ci_lo") if "ci_lo" in gated.columns else F.lit(None).cast("double")
    hi = F.col("ci_hi") if "ci_hi" in gated.columns else F.lit(None).cast("double")
    # The choice is one row.
    return gated.join(F.broadcast(chosen)).select(
        "model",
        "run_id",
        metric,
        "test_recall",
        "latency_p95_ms",
        format_ci(F.col(metric), lo, hi).alias("interval"),
        "eligible",
        "reason",
        F.coalesce(F.col("model") == F.col("_chosen"), F.lit(False)).alias("selected"),
    )


def best_epoch(
    history: DataFrame, run: str = "run_id", epoch: str = "epoch", score: str = "score", patience: int = 4
) -> DataFrame:
    """Per run: the best epoch under early stopping, the epoch it stopped at and the score.

    The best epoch is the last strict improvement before ``patience`` epochs without one. A run's
    history is as long as its epoch limit, so the window per run is bounded.
    """
    by_epoch = Window.partitionBy(run).orderBy(epoch)
    earlier = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_epoch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max(F.when(finite(F.col(score)), F.col(score))).over(earlier)
    better = finite(F.col(score)) & (top.isNull() | (F.col(score) > top))
    steps = history.select(
        run, epoch, F.col(score).alias("_score"), F.row_number().over(by_epoch).alias("_i"), better.alias("_better")
    )
    mark = F.when(F.col("_better"), F.struct("_i", F.col(epoch).alias("epoch"), F.col("_score").alias("score")))
    tracked = steps.withColumn("_best", F.max(mark).over(so_far))
    idle = F.col("_i") - F.coalesce(F.col("_best._i"), F.lit(0))
    stopped = tracked.withColumn("_stop", F.min(F.when(idle >= patience, F.col("_i"))).over(Window.partitionBy(run)))
    seen = stopped.where(F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop")))
    return seen.groupBy(run).agg(
        F.max("_best").alias("_b"),
        F.max(epoch).alias("last_epoch"),
        F.max(F.col("_stop").isNotNull()).alias("stopped_early"),
    ).select(run, F.col("_b.epoch").alias("best_epoch"), F.col("_b.score").alias("best_score"), "last_epoch", "stopped_early")
