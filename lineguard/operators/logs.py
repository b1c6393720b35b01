"""Operators over the append-only prediction log and its delayed labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import finite_only, ratio, utc_iso
from lineguard.operators.ordered import exact_quantiles, null_safe_join, running_sums


def flatten_stats(df: DataFrame, stats: str, features: Sequence[str] = params.FEATURE_NAMES) -> DataFrame:
    """Map of statistics to one nullable column each, plus ISO time and empty feedback columns."""
    return df.select(
        *[c for c in df.columns if c != stats],
        *[F.try_element_at(F.col(stats), F.lit(f)).cast("double").alias(f) for f in features],
        utc_iso(F.col("ts")).alias("ts_iso"),
        F.lit(None).cast("timestamp").alias("ground_truth_ts"),
        F.lit(None).cast("string").alias("feedback_source"),
    )


def select_log(
    log: DataFrame,
    *,
    limit: int | None = None,
    scenario: str | None = None,
    source: str | None = None,
    since: Column | None = None,
    order: str = "ASC",
    keys: Sequence[str] = ("ts", "id"),
) -> DataFrame:
    """Optional predicates (pushed to the scan), ordered by (ts, id), optionally limited."""
    out = log
    if scenario is not None:
        out = out.where(F.col("scenario") == scenario)
    if source is not None:
        out = out.where(F.col("source") == source)
    if since is not None:
        out = out.where(F.col(keys[0]) >= since)
    direction = F.desc if order.upper() == "DESC" else F.asc
    out = out.orderBy(*[direction(k) for k in keys])
    return out.limit(limit) if limit else out


def latest_window(
    log: DataFrame, n: int, scenario: str | None = None, keys: Sequence[str] = ("ts", "id")
) -> DataFrame:
    """The newest *n* rows, oldest first. Top-n runs as a per-task heap, not a full sort."""
    return select_log(log, limit=n, scenario=scenario, order="DESC", keys=keys).orderBy(*keys)


def attach_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """The log with the latest label per request; the log itself stays immutable.

    *feedback* is ``(request_id, ground_truth, arrival, source)``. It is reduced to
    one row per request before the join.
    """
    last = feedback.groupBy("request_id").agg(
        F.max_by(F.struct("ground_truth", "arrival", "source"), F.struct("arrival", "ground_truth", "source")).alias(
            "_f"
        )
    )
    base = log.drop("ground_truth", "ground_truth_ts", "feedback_source")
    return base.join(last, "request_id", "left").select(
        *base.columns,
        F.col("_f.ground_truth").alias("ground_truth"),
        F.col("_f.arrival").alias("ground_truth_ts"),
        F.col("_f.source").alias("feedback_source"),
    )


def unknown_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback whose request was never logged."""
    return feedback.join(log.select("request_id"), "request_id", "left_anti")


def log_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Headline counters; rates are 0 on an empty log, averages null."""
    n = F.count(F.lit(1))
    defect = F.count_if(F.col("predicted_label") == 1)
    review = F.count_if(F.col("decision") == "human_review")
    return log.groupBy(*by).agg(
        n.alias("n_predictions"),
        defect.alias("n_predicted_defect"),
        review.alias("n_human_review"),
        F.count("ground_truth").alias("n_labeled"),
        ratio(review.cast("double"), n).alias("review_rate"),
        ratio(defect.cast("double"), n).alias("predicted_defect_rate"),
        F.avg("probability").alias("mean_probability"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def scenario_counts(log: DataFrame) -> DataFrame:
    """Rows per non-null scenario; the scenario list is its key column."""
    return log.where(F.col("scenario").isNotNull()).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


def batch_items(df: DataFrame, request: str, index: str, error: str, result: Sequence[str]) -> DataFrame:
    """One output row per item: success carries a result struct, failure an error code.

    A bad item never affects the others; ``item_id`` is ``<request>-<index, 3 digits>``.
    """
    ok = F.col(error).isNull()
    return df.select(
        F.col(request).alias("batch_id"),
        F.col(index).alias("index"),
        F.format_string("%s-%03d", F.col(request).cast("string"), F.col(index).cast("int")).alias("item_id"),
        ok.alias("success"),
        F.when(ok, F.struct(*result)).alias("result"),
        F.when(~ok, F.col(error)).alias("error"),
    )


def split_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead-letter rows) of ``batch_items`` output."""
    return items.where("success"), items.where("NOT success")


def batch_summary(items: DataFrame, max_batch_size: int = params.MAX_BATCH_SIZE) -> DataFrame:
    """Requested, succeeded and failed items per batch; an over-limit batch is flagged."""
    return items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if("success").alias("n_succeeded"),
        F.count_if(~F.col("success")).alias("n_failed"),
        (F.count(F.lit(1)) > max_batch_size).alias("batch_too_large"),
    )


def latency_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, throughput and the latency distribution of a request log."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    base = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(F.col("status") == 200).alias("n_succeeded"),
        F.count_if(F.coalesce(F.col("status") != 200, F.lit(True))).alias("n_failed"),
        F.min(micros).alias("_t0"),
        F.max(micros).alias("_t1"),
        F.avg("latency_ms").alias("mean"),
        F.stddev_pop("latency_ms").alias("stdev"),
        F.min("latency_ms").alias("min"),
        F.max("latency_ms").alias("max"),
    )
    levels = [0.5, 0.9, 0.95, 0.99]
    finite_log = log.select(*by, finite_only(F.col("latency_ms")).alias("_latency"))
    q = exact_quantiles(finite_log, by, "_latency", levels).select(*by, "q")
    wall = (F.col("_t1") - F.col("_t0")) / 1e6
    return null_safe_join(base, q, list(by), "left").select(
        *by,
        "n_requests",
        "n_succeeded",
        "n_failed",
        ratio(F.col("n_requests").cast("double"), wall).alias("throughput_rps"),
        "mean",
        "stdev",
        "min",
        *[F.get("q", i).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))],
        "max",
    )


def status_counts(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return log.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def recent_latency_percentiles(
    log: DataFrame, rows: int = params.RECENT_LATENCY_ROWS, keys: Sequence[str] = ("ts", "id")
) -> DataFrame:
    """p50, p95, p99 over the latest requests: the feature itself is a fixed-size tail."""
    recent = log.orderBy(*[F.desc(k) for k in keys]).limit(rows)
    q = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return recent.agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select(
        "n", F.get("q", 0).alias("p50"), F.get("q", 1).alias("p95"), F.get("q", 2).alias("p99")
    )


def count_windows(
    log: DataFrame,
    size: int = params.MONITORING["window_size"],
    min_rows: int = params.MONITORING["min_samples"],
    keys: Sequence[str] = ("ts_us", "id"),
) -> DataFrame:
    """Consecutive chunks of ``size`` rows in (ts, id) order, with ``row_start`` and ``row_end``.

    A last chunk below ``min_rows`` is dropped. Only the last chunk can be short, so
    ``window_index`` and ``row_end`` need the row count alone, not a second pass.
    """
    counted = running_sums(log.withColumn("_one", F.lit(1).cast("bigint")), [], list(keys), ["_one"])
    chunk = F.floor((F.col("cum__one") - 1) / size).cast("bigint")
    return (
        counted.select(*log.columns, chunk.alias("window_index"), "tot__one")
        .select(
            *log.columns,
            "window_index",
            (F.col("window_index") * size).alias("row_start"),
            F.least((F.col("window_index") + 1) * size, F.col("tot__one")).alias("row_end"),
        )
        .where(F.col("row_end") - F.col("row_start") >= min_rows)
    )


def first_present(df: DataFrame, by: Sequence[str], columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Earliest non-null value of each column per group."""
    when = F.struct(*keys)
    aggs = [
        F.min_by(c, F.when(F.col(c).isNotNull(), when)).alias(f"first_{c}") for c in columns
    ]
    return df.groupBy(*by).agg(*aggs)
