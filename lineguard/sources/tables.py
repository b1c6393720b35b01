"""Stored tables: scan, manifest, reference, prediction log, reports, retrain history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard import params, schemas
from lineguard.operators.drift import Reference, reference_to_json, stats_from_json
from lineguard.operators.logs import select_log


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _require(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return path


# -- scan ------------------------------------------------------------------------


def write_scan(scan: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet keeps every type; CSV keeps the issue text instead of the array."""
    if fmt == "csv":
        scan.drop("issues").write.mode("overwrite").option("header", True).csv(path)
    else:
        scan.write.mode("overwrite").parquet(path)


def read_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    _require(spark, path)
    if fmt == "csv":
        return spark.read.schema(schemas.SCAN_CSV).option("header", True).csv(path)
    return spark.read.schema(schemas.SCAN).parquet(path)


# -- manifest ----------------------------------------------------------------------


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Partitioned by split, each file sorted by class and path."""
    ordered = manifest.sortWithinPartitions("split", "class_name", "relpath")
    ordered.write.mode("overwrite").partitionBy("split").parquet(path)


def load_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The manifest, or one split of it, whose partition alone is then listed and read."""
    known = F.lit(True) if split is None else F.col("split") == split
    if split not in (None, *params.SPLITS):
        raise ValueError(f"{split!r} is none of the splits {', '.join(params.SPLITS)}")
    stored = spark.read.schema(schemas.MANIFEST).parquet(_require(spark, path))
    return stored.where(known).select(*schemas.MANIFEST.fieldNames())


# -- reference -----------------------------------------------------------------------


def write_reference(reference: Reference, spark: SparkSession, path: str) -> None:
    """Three Parquet tables and the model baseline. Parquet holds infinite edges as they are."""
    reference.stats.write.mode("overwrite").parquet(f"{path}/stats")
    reference.values.write.mode("overwrite").parquet(f"{path}/values")
    reference.classes.write.mode("overwrite").parquet(f"{path}/classes")
    rows = [(k, float(v)) for k, v in sorted(reference.baseline.items())]
    spark.createDataFrame(rows, schemas.REFERENCE_BASELINE).write.mode("overwrite").parquet(f"{path}/baseline")


def load_reference(spark: SparkSession, path: str) -> Reference:
    _require(spark, path)
    stats = spark.read.schema(schemas.REFERENCE_STATS).parquet(f"{path}/stats")
    values = spark.read.schema(schemas.REFERENCE_VALUES).parquet(f"{path}/values")
    classes = spark.read.schema(schemas.REFERENCE_CLASSES).parquet(f"{path}/classes")
    base = spark.read.schema(schemas.REFERENCE_BASELINE).parquet(f"{path}/baseline")
    baseline = {r["name"]: r["value"] for r in base.collect()}  # a handful of named metrics
    names = tuple(r["feature"] for r in stats.select("feature").collect())  # one row per feature
    return Reference(stats, values, classes, names, baseline)


def export_reference_json(reference: Reference, path: str) -> None:
    reference_to_json(reference).write.mode("overwrite").text(path)


def import_reference_json(spark: SparkSession, path: str) -> DataFrame:
    return stats_from_json(spark.read.text(path), schemas.REFERENCE_STATS)


# -- prediction log -------------------------------------------------------------------


def append_predictions(df: DataFrame, path: str) -> None:
    """Append rows, one folder per scenario. Works for one row as for billions."""
    df.write.mode("append").partitionBy("scenario").parquet(path)


def replace_scenario(df: DataFrame, path: str) -> None:
    """Overwrite only the scenarios present in *df*; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario").parquet(path)


def clear_predictions(spark: SparkSession, path: str, scenario: str | None = None) -> None:
    """Drop one scenario's folder, or the whole log. A file operation, no data is rewritten."""
    jvm = spark._jvm
    target = path
    if scenario is not None:
        utils = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        target = f"{path}/{utils.getPartitionPathString('scenario', scenario)}"
    hadoop = jvm.org.apache.hadoop.fs.Path(target)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path)
    return spark.read.schema(schemas.PREDICTION).parquet(path)


def stream_predictions(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same log as an unbounded table."""
    return spark.readStream.schema(schemas.PREDICTION).option("maxFilesPerTrigger", max_files).parquet(path)


def export_jsonl(log: DataFrame, path: str, limit: int | None = None) -> None:
    """JSON lines in (ts, id) order."""
    select_log(log, limit=limit).write.mode("overwrite").json(path)


# -- reports and history ----------------------------------------------------------------


def write_report_json(report: DataFrame, path: str) -> None:
    """A nested report, one JSON document per row."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_comparison_csv(table: DataFrame, path: str) -> None:
    """One row per model, so a single file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def record_retrains(events: DataFrame, path: str) -> None:
    """Append retrain events (``ts, reason``) in one job."""
    iso = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("ts"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = events.select(F.col("ts").cast("double"), iso.alias("ts_iso"), "reason")
    rows.coalesce(1).write.mode("append").json(path)


def record_retrain(spark: SparkSession, path: str, ts: float, reason: str) -> None:
    """Append one retrain event."""
    record_retrains(spark.createDataFrame([(float(ts), reason)], "ts double, reason string"), path)


def retrain_history(spark: SparkSession, path: str, rows: int = params.RETRAINING["history_rows"]) -> DataFrame:
    """The latest retrain events, newest first."""
    return spark.read.schema(schemas.RETRAIN_HISTORY).json(path).orderBy(F.desc("ts")).limit(rows)


def last_retrain(spark: SparkSession, path: str) -> float | None:
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schemas.RETRAIN_HISTORY).json(path).agg(F.max("ts")).first()[0]
