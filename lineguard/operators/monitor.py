"""Window signals: drift, behaviour and performance per group, in one job for all groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import finite, fixed_text, max_confidence, present, ratio
from lineguard.functions.pvalues import chi2_pvalue
from lineguard.operators.drift import (
    Reference,
    chi_square_columns,
    ks_two_sample,
    rollup_columns,
    wide_bin_counts,
    with_psi,
)
from lineguard.operators.logs import count_windows, first_present
from lineguard.operators.metrics import classification_metrics, metrics_from_ranked, score_counts, score_rows
from lineguard.operators.ordered import null_safe_join, order_number, running_sums
from lineguard.session import stage

LOG_COLUMNS = ("probability", "predicted_label", "decision", "ground_truth", "model_threshold", "scenario")
PERFORMANCE = ("accuracy", "precision", "recall", "f1", "roc_auc")


def labelled_performance(
    df: DataFrame,
    by: Sequence[str],
    *,
    min_labeled: int = params.MONITORING["min_labeled"],
    keys: Sequence[str] = ("ts_us", "id"),
    bounded: bool = False,
) -> DataFrame:
    """Metrics of each group with enough labels, at the threshold its first labelled row used.

    The threshold travels with the score counts as the value at the smallest (ts, id), so
    no row is joined back to its group.
    """
    at = F.when(F.col("model_threshold").isNotNull(), order_number(keys))
    stamped = df.select(*by, "probability", "ground_truth", "model_threshold", at.alias("_at"))
    scores = score_counts(
        stamped,
        by,
        "probability",
        "ground_truth",
        F.min_by("model_threshold", "_at").alias("threshold"),
        F.min("_at").alias("threshold_at"),
    )
    ranked = running_sums(
        scores,
        by,
        ["score"],
        ["pos", "neg"],
        bounded=bounded,
        carry_first=("threshold", "threshold_at"),
        cut_source=score_rows(df, "probability", "ground_truth"),
    )
    threshold = F.coalesce(F.col("first_threshold"), F.lit(0.5))
    return metrics_from_ranked(ranked, by, threshold).where(F.col("n_samples") >= min_labeled)


def alerts(t: dict = params.MONITORING) -> Column:
    """Alert structs of one signal row; a missing or NaN metric never alerts."""

    def alert(signal: str, sev: str, *detail: Column) -> Column:
        return F.struct(F.lit(signal).alias("signal"), F.lit(sev).alias("severity"), F.concat(*detail).alias("detail"))

    psi, worst = F.col("psi_max"), F.coalesce(F.col("worst_feature"), F.lit("?"))
    psi_text = (F.lit("PSI "), fixed_text(psi, 3), F.lit(" on "), worst)
    drop, acc, review = F.col("mean_confidence_drop"), F.col("accuracy_drop"), F.col("review_rate")
    return present(
        F.when(finite(psi) & (psi >= t["psi_alert"]), alert("data_drift", "high", *psi_text, F.lit(f", limit {t['psi_alert']}"))).when(
            finite(psi) & (psi >= t["psi_warn"]), alert("data_drift", "warning", *psi_text, F.lit(", above the warning band"))
        ),
        F.when(
            finite(drop) & (drop >= t["confidence_drop_alert"]),
            alert("confidence_collapse", "medium", F.lit("mean confidence down by "), fixed_text(drop, 3)),
        ),
        F.when(
            finite(review) & (review >= t["review_rate_alert"]),
            alert("review_queue_overflow", "medium", fixed_text(review * 100.0, 1), F.lit("% of rows sent to review")),
        ),
        F.when(
            finite(acc) & (acc >= t["accuracy_drop_alert"]),
            alert("accuracy_degradation", "high", F.lit("accuracy down by "), fixed_text(acc, 3)),
        ),
    )


def window_signals(
    log: DataFrame,
    by: Sequence[str],
    reference: Reference,
    *,
    features: Sequence[str] | None = None,
    thresholds: dict = params.MONITORING,
    classes: Sequence[str] = params.CLASSES,
    keys: Sequence[str] = ("ts_us", "id"),
    with_ks: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """All monitoring signals, one row per group.

    Drift bins, behaviour and label counts come from a single aggregate; only the ranked
    statistics (KS, AUC) need another pass. ``bounded`` says groups are fixed-size windows.
    """
    by, features = list(by), list(features or reference.features)
    base = reference.baseline
    p, label = F.col("probability"), F.col("predicted_label")
    wide = wide_bin_counts(
        log,
        by,
        reference,
        features,
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(max_confidence(p)).alias("mean_confidence"),
        F.avg(p).alias("mean_probability"),
        F.count_if(label == 0).alias("n_neg"),
        F.count_if(label == 1).alias("n_pos"),
        F.count_if(F.col("decision") == "human_review").alias("n_review"),
        F.count("ground_truth").alias("n_labeled"),
    )
    perf = labelled_performance(log, by, min_labeled=thresholds["min_labeled"], keys=keys, bounded=bounded)
    joined = null_safe_join(wide, perf.select(*by, *PERFORMANCE), by, "left")
    if "scenario" in by:
        joined = joined.withColumn("first_scenario", F.col("scenario"))
    else:
        joined = null_safe_join(joined, first_present(log, by, ["scenario"], keys), by, "left")
    joined = joined.withColumn("features", with_psi("entries", thresholds["psi_warn"], thresholds["psi_alert"]))
    if with_ks:
        ks = ks_two_sample(log, by, reference, features, bounded=bounded).groupBy(*by).agg(
            F.map_from_entries(
                F.collect_list(F.struct("feature", F.struct("ks_statistic", "ks_pvalue")))
            ).alias("_ks")
        )
        joined = null_safe_join(joined, ks, by, "left")
        merged = F.transform(
            "features",
            lambda e: e.withField("ks_statistic", F.try_element_at("_ks", e["feature"])["ks_statistic"])
            .withField("ks_pvalue", F.try_element_at("_ks", e["feature"])["ks_pvalue"])
            .withField(
                "ks_flag",
                F.coalesce(
                    F.try_element_at("_ks", e["feature"])["ks_pvalue"] < thresholds["ks_pvalue_alert"], F.lit(False)
                ),
            ),
        )
        joined = joined.withColumn("features", merged).drop("_ks")

    def baseline(name: str) -> Column:
        value = base.get(name)
        return F.lit(None if value is None else float(value)).cast("double")

    # An explicit mean confidence wins; otherwise the reference accuracy stands in for it.
    ref_conf = baseline("reference_mean_confidence")
    if base.get("reference_mean_confidence") is None:
        ref_conf = baseline("reference_accuracy")

    def drop_from(ref: Column, value: Column) -> Column:
        return F.when(finite(ref), ref - value)

    mix = reference.class_mix()
    zero = F.lit(0).cast("bigint")
    cells = [
        (F.lit(int(mix.get(c, 0))).cast("bigint"), F.col(n)) for c, n in zip(classes, ("n_neg", "n_pos"))
    ]

    def over(f) -> Column:
        return sum((F.when(n > 0, f(r, n)).otherwise(zero) for r, n in cells[1:]), F.when(cells[0][1] > 0, f(*cells[0])).otherwise(zero))

    one = F.when(cells[0][1] > 0, F.struct(cells[0][0].alias("n_ref"), cells[0][1].alias("n_cur"))).otherwise(
        F.struct(cells[1][0].alias("n_ref"), cells[1][1].alias("n_cur"))
    )
    chi2, dof = chi_square_columns(
        F.col("n_neg") + F.col("n_pos"),
        over(lambda r, n: r),
        over(lambda r, n: r.cast("double") * r / (r + n)),
        over(lambda r, n: n.cast("double") * n / (r + n)),
        over(lambda r, n: F.when(r > 0, 1).otherwise(0)),
        over(lambda r, n: F.lit(1)),
        one,
        F.lit(sum(mix.values())),
        F.lit(sum(n > 0 for n in mix.values())),
    )
    signals = joined.select(
        *by,
        "n_samples",
        "first_scenario",
        *rollup_columns("features"),
        "features",
        "mean_confidence",
        ref_conf.alias("reference_confidence"),
        drop_from(ref_conf, F.col("mean_confidence")).alias("mean_confidence_drop"),
        "mean_probability",
        ratio(F.col("n_pos").cast("double"), F.col("n_samples")).alias("predicted_defect_rate"),
        ratio(F.col("n_review").cast("double"), F.col("n_samples")).alias("review_rate"),
        chi2.alias("class_mix_chi2"),
        dof.alias("_dof"),
        # Too few labels count as none, here and in what the retraining policy sums.
        F.when(F.col("n_labeled") >= thresholds["min_labeled"], F.col("n_labeled")).otherwise(F.lit(0)).cast("bigint").alias("n_labeled"),
        *PERFORMANCE,
        drop_from(baseline("reference_accuracy"), F.col("accuracy")).alias("accuracy_drop"),
        drop_from(baseline("reference_recall"), F.col("recall")).alias("recall_drop"),
    )
    signals = signals.withColumn("class_mix_pvalue", chi2_pvalue(F.col("class_mix_chi2"), F.col("_dof"))).drop("_dof")
    return signals.withColumn("alerts", alerts(thresholds))


def scenario_report(
    log: DataFrame, reference: Reference, *, min_samples: int = params.MONITORING["min_samples"], **options
) -> DataFrame:
    """Signals per non-null scenario with enough rows."""
    tagged = log.where(F.col("scenario").isNotNull())
    return window_signals(tagged, ["scenario"], reference, **options).where(F.col("n_samples") >= min_samples)


def window_report(
    log: DataFrame,
    reference: Reference,
    *,
    size: int = params.MONITORING["window_size"],
    min_samples: int = params.MONITORING["min_samples"],
    keys: Sequence[str] = ("ts_us", "id"),
    **options,
) -> DataFrame:
    """Signals per count window of the log in (ts, id) order.

    The log is ordered once: its needed columns, with their window, are staged, and every
    aggregate reads that copy.
    """
    names = [f for f in (options.get("features") or reference.features) if f in log.columns]
    needed = dict.fromkeys([*keys, *names, *LOG_COLUMNS])
    windowed = stage(count_windows(log.select(*needed), size, min_samples, keys), "windowed-log")
    by = ["window_index", "row_start", "row_end"]
    return window_signals(windowed, by, reference, keys=keys, bounded=True, **options)


def report_summary(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """The short table of a report: rounded headline numbers and alert names."""
    return report.select(
        *by,
        F.bround("psi_max", 4).alias("psi_max"),
        "drifted_features",
        F.when(F.col("n_labeled") > 0, F.bround("accuracy", 4)).alias("accuracy"),
        F.bround("accuracy_drop", 4).alias("accuracy_drop"),
        F.bround("mean_confidence", 4).alias("mean_confidence"),
        F.bround("review_rate", 4).alias("review_rate"),
        F.transform("alerts", lambda a: a["signal"]).alias("alerts"),
    )


def detector_coverage(report: DataFrame, baseline: str) -> DataFrame:
    """Of the non-baseline scenarios, how many each detector caught."""
    names = F.transform("alerts", lambda a: a["signal"])
    return report.where(F.col("scenario") != baseline).agg(
        F.count(F.lit(1)).alias("n_scenarios"),
        F.count_if(F.array_contains(names, "confidence_collapse")).alias("by_confidence"),
        F.count_if(F.array_contains(names, "data_drift")).alias("by_data_drift"),
    )


def scenario_performance(log: DataFrame, baseline: str, threshold: float = 0.5) -> DataFrame:
    """Metrics per scenario over labelled rows and their drop against the baseline scenario."""
    labelled = log.where(F.col("ground_truth").isNotNull() & F.col("scenario").isNotNull())
    metrics = classification_metrics(labelled, ["scenario"], "probability", "ground_truth", threshold)
    p = F.col("probability")
    means = labelled.groupBy("scenario").agg(
        F.avg(max_confidence(p)).alias("mean_confidence"), F.avg(p).alias("mean_probability")
    )
    return compare_to_baseline(metrics.join(means, "scenario"), baseline)


def compare_to_baseline(table: DataFrame, baseline: str) -> DataFrame:
    """Adds accuracy, recall and f1 drops; the baseline row itself has null drops."""
    names = ("accuracy", "recall", "f1")
    base = table.where(F.col("scenario") == baseline).agg(*[F.max(n).alias(f"_{n}") for n in names])
    is_base = F.col("scenario") == baseline
    drops = [F.when(~is_base, F.col(f"_{n}") - F.col(n)).alias(f"{n}_drop") for n in names]
    # The baseline is a one-row aggregate.
    return table.join(F.broadcast(base)).select(*table.columns, *drops)
