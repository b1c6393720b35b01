"""Views that carry the operators on the given tables, in Spark and in SQL.

Each view exists twice, as a DataFrame here and as a WITH clause in ``oracles``, with the
same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import hash_draw, predicted_class, predicted_label, route_decision
from lineguard.functions.text_keys import text_grid_key
from lineguard.operators.drift import Reference, build_reference
from lineguard.operators.quality import file_issues, with_validity
from lineguard.session import bounded_batches, stage

#: Fixed values of the fixture views.
REVIEW_BAND = (0.47, 0.53)
THRESHOLD = 0.5
PRED_FEATURES = ("f1", "f2", "f3", "f4", "f5")
DOC_FEATURES = ("n_chars", "words", "mean_word_length", "digit_share")
DOC_RULES = {
    **params.FILE_RULES,
    "allowed_formats": ("en", "de", "fr"),
    "max_file_bytes": 20_000,
    "min_width": 8,
    "min_height": 2,
    "max_width": 3_000,
    "max_height": 4_096,
    "min_mean_intensity": 0.0,
    "max_mean_intensity": 12.75,
    "min_std_intensity": 2.0,
}
DOC_CHECKS = {**params.CORPUS_RULES, "max_class_imbalance_ratio": 4.0, "max_duplicate_ratio": 0.03}
BASELINE = {"reference_accuracy": 0.80, "reference_recall": 0.75}
GATES = {"min_test_f1": 0.85, "min_test_recall": 0.5, "max_latency_p95_ms": 140.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(events: DataFrame) -> DataFrame:
    """The prediction log on a batch or streaming ``events`` table."""
    low, high = REVIEW_BAND
    base = events.selectExpr(
        "event_id AS id",
        "event_id AS request_id",
        "ts AS ts_ntz",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS scenario",
        "value",
        """value * (IF(event_type = 'error', 2.0D, 1.0D)
            * IF(ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00', 3.0D, 1.0D)) AS v""",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "user_id",
    ).selectExpr(
        "*",
        "v / (v + 50.0D) AS probability",
        "CASE WHEN id % 3 <> 0 THEN IF(value + (k - 50) >= 50, 1, 0) END AS ground_truth",
    )
    p, t = F.col("probability"), F.lit(THRESHOLD)
    label = predicted_label(p, t)
    judged = base.select(
        "*",
        t.alias("model_threshold"),
        label.alias("predicted_label"),
        predicted_class(label, params.CLASSES).alias("predicted_class"),
        route_decision(p, t, low, high).alias("decision"),
    )
    return judged.selectExpr(
        "*",
        "v AS f1",
        "probability AS f2",
        "CAST(k AS DOUBLE) AS f3",
        "CAST(hour(ts_ntz) AS DOUBLE) AS f4",
        "CAST(user_id % 97 AS DOUBLE) AS f5",
        "v AS latency_ms",
        "IF(scenario = 'error', 400, 200) AS status",
    ).drop("value")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delayed labels: a first label after k mod 48 hours and, for some, a correction later."""
    rows = preds(spark, sf_dir).where(F.col("ground_truth").isNotNull())
    return feedback_rows(rows)


def feedback_rows(rows: DataFrame) -> DataFrame:
    arrival = F.timestamp_micros(F.col("ts_us") + (F.col("k") % 48) * F.lit(3_600_000_000))
    return rows.select("request_id", "ground_truth", arrival.alias("arrival"), F.lit("line").alias("source"))


def corrected_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feedback`` plus corrections five hours later, and labels of requests never logged."""
    return corrected_rows(feedback(spark, sf_dir))


def corrected_rows(base: DataFrame) -> DataFrame:
    fix = base.where(F.col("request_id") % 10 == 1).select(
        "request_id",
        (1 - F.col("ground_truth")).alias("ground_truth"),
        F.timestamp_micros(F.unix_micros("arrival") + F.lit(18_000_000_000)).alias("arrival"),
        F.lit("audit").alias("source"),
    )
    stray = base.where(F.col("request_id") % 25 == 2).withColumn("request_id", -F.col("request_id"))
    return base.unionByName(fix).unionByName(stray)


def ref_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference period, features from the unshifted value."""
    events = table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    truth = F.when(v + (k - 50) >= 50, 1).otherwise(0)
    return events.select(
        F.col("event_id").alias("id"),
        v.alias("f1"),
        (v / (v + F.lit(50.0))).alias("f2"),
        k.cast("double").alias("f3"),
        F.hour("ts").cast("double").alias("f4"),
        (F.col("user_id") % 97).cast("double").alias("f5"),
        F.when(truth == 1, "defect").otherwise("ok").alias("class_name"),
    )


def reference(spark: SparkSession, sf_dir: str) -> Reference:
    return build_reference(
        ref_rows(spark, sf_dir), PRED_FEATURES, class_col="class_name", baseline=BASELINE
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after the reference period."""
    return preds(spark, sf_dir).where(F.col("ts_ntz") >= F.lit("2024-01-11").cast("timestamp_ntz"))


def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus scan of all documents, over whole texts; documents without a label have no class.

    Like an image scan it is stored once; every later stage reads the stored table.
    """
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").repartition("doc_id")
    space = "[ \\t\\n\\r\\f]+"
    words = F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+"))
    solid = F.length(F.regexp_replace("text", space, ""))
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    rows = docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("relpath"),
        F.when(F.col("quality") == 1, "ok").when(F.col("quality").isNotNull(), "defect").alias("class_name"),
        F.when(F.col("quality") == 1, 0).when(F.col("quality").isNotNull(), 1).alias("label"),
        F.col("n_chars").cast("bigint").alias("file_bytes"),
        words.cast("bigint").alias("width"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("height"),
        F.sha2("text", 256).alias("sha256"),
        text_grid_key("text").alias("dhash"),
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("words"),
        F.try_divide(solid.cast("double"), words.cast("double")).alias("mean_word_length"),
        F.try_divide(digits.cast("double"), F.col("n_chars").cast("double")).alias("digit_share"),
    )
    rows = rows.withColumns(
        {
            # The text statistics that play the two intensity statistics, on [0, 1].
            "mean_intensity": F.coalesce("digit_share", F.lit(0.0)),
            "std_intensity": F.coalesce(F.col("mean_word_length"), F.lit(0.0)) / 255.0,
        }
    )
    with bounded_batches(spark):
        return stage(with_validity(rows, file_issues(F.col("lang"), F.lit(True), DOC_RULES)), "scan")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths of a raw corpus: origin / class folder / name, with name collisions."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    folder = F.when(F.col("quality") == 1, "ok_front").when(F.col("quality") == 0, "def_front").otherwise("unsorted")
    ext = F.when(F.col("doc_id") % 11 == 0, "txt").otherwise("png")
    doc = F.col("doc_id")
    path = F.concat(
        F.lit("/raw/"), doc.cast("string"), F.lit("/cam"), (doc % 2).cast("string"), F.lit("/"), folder,
        F.lit("/part_"), (doc % 40).cast("string"), F.lit("."), ext,
    )
    return docs.select(path.alias("path"))


def manifest(spark: SparkSession, sf_dir: str, scan: DataFrame | None = None) -> DataFrame:
    """Manifest with folds fixed by a hash rule, so every output has a SQL counterpart.

    A query that reads the scan as well passes it as *scan*, so that it is made once.
    """
    from lineguard.operators.split import with_groups

    rows = with_groups(scan_docs(spark, sf_dir) if scan is None else scan)
    draw = hash_draw(params.SEED, F.col("group")) % 100
    split = F.when(draw < 65, "train").when(draw < 80, "val").otherwise("test")
    return rows.withColumn("split", split)


def pixel_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray grids in [0, 1]."""
    px = F.transform("embedding", lambda e: F.least(F.greatest(e.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), (F.col("label") % 2).alias("label"), px.alias("px")
    )


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as 8-bit gray image rows, shaped like Spark's image source."""
    grids = pixel_grids(spark, sf_dir).repartition("image_id")
    codes = F.transform("px", lambda v: F.lpad(F.hex(F.floor(v * 255.0 + 0.5)), 2, "0"))
    return grids.select(
        "image_id",
        "label",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(codes, "")).alias("data"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    f1 = F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") / 50.0)
    return part.select(
        F.col("p_brand").alias("model"),
        F.col("p_type").alias("arch"),
        F.col("p_partkey").alias("run_id"),
        F.col("p_partkey").alias("start_time"),
        f1.alias("test_f1"),
        ((F.col("p_partkey") % 50) / 50.0).alias("test_recall"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 60.0).alias("test_precision"),
        (F.col("p_retailprice") - 850).alias("latency_p95_ms"),
        (f1 - 0.02).alias("ci_lo"),
        (f1 + 0.02).alias("ci_hi"),
    )


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training histories of 40 epochs per run."""
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).cast("bigint").alias("run_id"),
        (F.col("p_partkey") % 40).alias("epoch"),
        (F.col("p_size") / 50.0).alias("score"),
    )
