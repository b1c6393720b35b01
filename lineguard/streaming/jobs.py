"""Streaming forms of the log operators: score, window signals, late labels, trigger, dedup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import max_confidence, ratio
from lineguard.operators.drift import Reference, rollup_columns, wide_bin_counts, with_psi
from lineguard.operators.metrics import cell_metrics
from lineguard.operators.model import score_batch
from lineguard.session import shared_folder


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """The session's state store is *provider* while a query starts."""
    before = spark.conf.get(_STATE_STORE, None)
    if provider:
        spark.conf.set(_STATE_STORE, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.set(_STATE_STORE, before) if before else spark.conf.unset(_STATE_STORE)


def run_to_table(
    stream: DataFrame,
    name: str,
    *,
    mode: str = "append",
    path: str | None = None,
    partition_by: Sequence[str] = (),
    keyed_state: bool = False,
) -> DataFrame:
    """Process everything available into a Parquet table and return that table.

    Table and checkpoint lie in the shared folder; a restart with the same path resumes. ``keyed_state`` gives
    the query the state store that operators with their own state and timers need.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/_checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _state_store(spark, _KEYED_STATE if keyed_state else None):
        query = writer.option("path", f"{path}/rows").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch into its own folder, in place of what an earlier attempt at the same batch left there."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")


def run_by_batch(stream: DataFrame, name: str, *, path: str | None = None) -> DataFrame:
    """Process everything available, a folder per micro-batch, and return the table (column ``batch`` added).

    For sinks that keep no log of their own: a batch that is run again, as after a crash between write and
    checkpoint, overwrites its folder, so nothing is added twice.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark, name)
    writer = stream.writeStream.foreachBatch(lambda rows, batch_id: write_batch(rows, batch_id, path))
    query = writer.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")


def stream_score(requests: DataFrame, model: PipelineModel, **options) -> DataFrame:
    """Prediction-log rows for a stream of requests: the batch scorer, unchanged."""
    return score_batch(model, requests, **options)


def dedup_requests(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """At most one row per request id within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["request_id"])


def window_signals(
    stream: DataFrame,
    reference: Reference,
    *,
    duration: str = "1 day",
    delay: str = "1 hour",
    ts: str = "ts",
    features: Sequence[str] | None = None,
    by: Sequence[str] = (),
    thresholds: dict = params.MONITORING,
    threshold: float = 0.5,
) -> DataFrame:
    """Signals per event-time window from additive parts only.

    Bins are frozen, so PSI follows from counts; so do confidence, rates and the confusion
    cells. Rows later than the watermark are dropped, and a window appears once it has closed.
    Runs on a batch table as well, with the same result for the closed windows.
    """
    features = list(features or reference.features)
    p, y = F.col("probability"), F.col("ground_truth")
    hit = p >= F.lit(float(threshold))
    rows = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    wide = wide_bin_counts(
        rows,
        [F.window(ts, duration).alias("window"), *by],
        reference,
        features,
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(max_confidence(p)).alias("_conf"),
        F.count_if(F.col("decision") == "human_review").alias("_review"),
        F.count_if((y == 1) & hit).alias("tp"),
        F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"),
        F.count_if((y == 0) & ~hit).alias("tn"),
    )
    scored = wide.withColumn("features", with_psi("entries", thresholds["psi_warn"], thresholds["psi_alert"]))
    scored = scored.select("*", *rollup_columns("features"))
    labeled = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    accuracy = cell_metrics()["accuracy"]
    measured = F.when(labeled >= thresholds["min_labeled"], accuracy)
    conf = ratio(F.col("_conf"), F.col("n_samples"))
    ref_acc = F.lit(reference.baseline.get("reference_accuracy")).cast("double")
    ref_conf = F.coalesce(F.lit(reference.baseline.get("reference_mean_confidence")).cast("double"), ref_acc)
    return scored.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        "n_samples",
        "psi_max",
        "psi_mean",
        "n_drifted",
        "worst_feature",
        conf.alias("mean_confidence"),
        (ref_conf - conf).alias("mean_confidence_drop"),
        ratio(F.col("_review").cast("double"), F.col("n_samples")).alias("review_rate"),
        F.when(labeled >= thresholds["min_labeled"], labeled).otherwise(F.lit(0)).cast("bigint").alias("n_labeled"),
        measured.alias("accuracy"),
        (ref_acc - measured).alias("accuracy_drop"),
    )


def feedback_join(
    predictions: DataFrame,
    feedback: DataFrame,
    *,
    within: str = "3 days",
    prediction_delay: str = "1 hour",
    feedback_delay: str = "1 hour",
) -> DataFrame:
    """Each prediction once, with the last label that came for it in time, or without one.

    A prediction stream meets a label stream in a left outer interval join; corrections make several rows of a prediction, of
    which an aggregate keeps the label that arrived last (of equal arrivals the greater one). A prediction leaves when the
    watermarks are ``within`` past it, labelled or not, so both states are bounded by the interval. Labels of
    unknown requests leave with the join's state. Columns of *predictions* must name a row together.
    """
    p = predictions.withWatermark("ts", prediction_delay).alias("p")
    f = (
        feedback.select(
            F.col("request_id").alias("f_request_id"), "ground_truth", "arrival", F.col("source").alias("feedback_source")
        )
        .withWatermark("arrival", feedback_delay)
        .alias("f")
    )
    cond = F.expr(
        f"p.request_id = f.f_request_id AND f.arrival >= p.ts AND f.arrival <= p.ts + INTERVAL {within}"
    )
    names = [c for c in predictions.columns if c not in ("ground_truth", "ground_truth_ts", "feedback_source")]
    label = F.struct(F.col("f.arrival").alias("ground_truth_ts"), F.col("f.ground_truth"), F.col("f.feedback_source"))
    joined = p.join(f, cond, "left_outer").select(*[F.col(f"p.{c}") for c in names], label.alias("_label"))
    last = joined.groupBy(*names).agg(F.max("_label").alias("_label"))
    return last.select(*names, "_label.ground_truth", "_label.ground_truth_ts", "_label.feedback_source")
