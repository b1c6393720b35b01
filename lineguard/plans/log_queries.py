"""Queries over the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineguard.functions import columns as C
from lineguard.operators import logs, metrics
from lineguard.plans import fixtures as X
from lineguard.plans.registry import register
from lineguard.plans.views_sql import r

KEYS = ("ts_us", "id")


@register("prj4_finite_only", "preds", f"SELECT scenario, count(*) AS n, {r('sum(v)', 2)} AS total FROM preds WHERE k <> 7 GROUP BY 1")
def prj4(spark, sf):
    value = F.when(F.col("k") == 7, F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("v"))
    rows = X.preds(spark, sf).select("scenario", value.alias("v"))
    kept = rows.where(C.finite(F.col("v"))).groupBy("scenario")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@register("prj6_route_decision", "preds", "SELECT scenario, decision, count(*) AS n FROM preds GROUP BY 1, 2")
def prj6(spark, sf):
    return X.preds(spark, sf).groupBy("scenario", "decision").agg(F.count(F.lit(1)).alias("n"))


@register(
    "prj7_predict_columns",
    "preds",
    f"""SELECT request_id, predicted_label::bigint AS predicted_label, predicted_class,
    {r('CASE WHEN predicted_label = 1 THEN probability ELSE 1.0::double - probability END')} AS confidence FROM preds""",
)
def prj7(spark, sf):
    p, label = F.col("probability"), F.col("predicted_label")
    return X.preds(spark, sf).select("request_id", "predicted_label", "predicted_class", C.confidence(p, label).alias("confidence"))


@register(
    "prj8_max_confidence",
    "preds",
    f"SELECT scenario, {r('avg(greatest(probability, 1.0::double - probability))')} AS mean_confidence FROM preds GROUP BY 1",
)
def prj8(spark, sf):
    return X.preds(spark, sf).groupBy("scenario").agg(F.avg(C.max_confidence(F.col("probability"))).alias("mean_confidence"))


@register(
    "prj9_flatten_stats",
    "preds",
    f"""SELECT request_id, {r('f1')} AS f1, CASE WHEN k % 2 = 0 THEN {r('f2')} END AS f2, NULL::double AS missing,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso FROM preds""",
)
def prj9(spark, sf):
    stats = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("f1"), F.col("f1"), F.lit("f2"), F.col("f2"))).otherwise(
        F.create_map(F.lit("f1"), F.col("f1"))
    )
    rows = X.preds(spark, sf).select("request_id", "ts", stats.alias("stats"))
    return logs.flatten_stats(rows, "stats", ["f1", "f2", "missing"]).select("request_id", "f1", "f2", "missing", "ts_iso")


@register(
    "prj11_fetch",
    "preds",
    f"""SELECT id, ts_us, {r('probability')} AS probability FROM preds
    WHERE scenario = 'click' AND ts >= TIMESTAMP '2024-01-20' ORDER BY ts_us DESC, id DESC LIMIT 500""",
)
def prj11(spark, sf):
    rows = X.preds(spark, sf)
    since = F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    picked = logs.select_log(rows, scenario="click", since=since, order="DESC", limit=500, keys=KEYS)
    return picked.select("id", "ts_us", "probability")


@register(
    "prj13_batch_items",
    "preds",
    f"""SELECT batch_id, idx AS "index", batch_id || '-' || lpad(idx::varchar, 3, '0') AS item_id, NOT bad AS success,
    CASE WHEN NOT bad THEN {r('probability')} END AS probability, CASE WHEN bad THEN 'invalid_image' END AS error
    FROM (SELECT id // 16 AS batch_id, id % 16 AS idx, k >= 95 AS bad, probability FROM preds)""",
)
def prj13(spark, sf):
    return _items(X.preds(spark, sf)).select(
        "batch_id", "index", "item_id", "success", F.col("result.probability").alias("probability"), "error"
    )


def _items(preds):
    rows = preds.select(
        F.floor(F.col("id") / 16).cast("bigint").alias("batch_id"),
        (F.col("id") % 16).alias("index"),
        F.when(F.col("k") >= 95, F.lit("invalid_image")).alias("error_code"),
        "probability",
        "decision",
    )
    return logs.batch_items(rows, "batch_id", "index", "error_code", ["probability", "decision"])


@register(
    "agg31_batch_summary",
    "preds",
    """SELECT id // 16 AS batch_id, count(*) AS n_requested, count(*) FILTER (k < 95) AS n_succeeded,
    count(*) FILTER (k >= 95) AS n_failed, count(*) > 16 AS batch_too_large FROM preds GROUP BY 1""",
)
def agg31(spark, sf):
    return logs.batch_summary(_items(X.preds(spark, sf)))


@register(
    "prj12_request_gate",
    "base_preds",
    """SELECT coalesce(reason, 'accepted') AS reason, status::bigint AS status, count(*) AS n FROM (
      SELECT CASE WHEN k < 5 THEN 'empty' WHEN k * 100000 > 5242880 THEN 'size' WHEN id % 7 = 0 THEN 'content_type'
        WHEN id % 11 = 0 THEN 'undecodable' WHEN id % 13 = 0 THEN 'format' END AS reason,
      CASE WHEN k < 5 THEN 400 WHEN k * 100000 > 5242880 THEN 413 WHEN id % 7 = 0 THEN 415
        WHEN id % 11 = 0 THEN 400 WHEN id % 13 = 0 THEN 415 ELSE 200 END AS status FROM base_preds) GROUP BY 1, 2""",
)
def prj12(spark, sf):
    from lineguard.operators.quality import request_gate

    i, k = F.col("id"), F.col("k")
    uploads = X.preds(spark, sf).select(
        F.when(k < 5, 0).otherwise(k * 100000).alias("size"),
        F.when(i % 7 == 0, "text/html; charset=utf-8").when(i % 5 == 0, "IMAGE/PNG; q=1").when(i % 3 == 0, "").otherwise("image/jpeg").alias("kind"),
        (i % 11 != 0).alias("decodable"),
        F.when(i % 13 == 0, "GIF").when(i % 2 == 0, "png").alias("format"),
    )
    gate = request_gate(F.col("size"), F.col("kind"), F.col("decodable"), F.col("format")).alias("g")
    return (
        uploads.select(gate)
        .groupBy(F.coalesce("g.reason", F.lit("accepted")).alias("reason"), F.col("g.status").alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "agg19_log_summary",
    "preds",
    f"""SELECT scenario, count(*) AS n_predictions, count(*) FILTER (predicted_label = 1) AS n_predicted_defect,
    count(*) FILTER (decision = 'human_review') AS n_human_review, count(ground_truth) AS n_labeled,
    {r("count(*) FILTER (decision = 'human_review') / count(*)::double")} AS review_rate,
    {r('count(*) FILTER (predicted_label = 1) / count(*)::double')} AS predicted_defect_rate,
    {r('avg(probability)')} AS mean_probability, {r('avg(latency_ms)')} AS mean_latency_ms,
    min(ts_us) AS first_us, max(ts_us) AS last_us FROM preds GROUP BY 1""",
)
def agg19(spark, sf):
    out = logs.log_summary(X.preds(spark, sf), ["scenario"])
    return out.select(
        *[c for c in out.columns if c not in ("first_ts", "last_ts")],
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
    )


@register("agg20_scenario_counts", "preds", "SELECT scenario, count(*) AS n FROM preds GROUP BY 1")
def agg20(spark, sf):
    return logs.scenario_counts(X.preds(spark, sf))


_LAT = "quantile_cont(latency_ms, {})"


@register(
    "agg32_latency_summary",
    "preds",
    f"""SELECT scenario, count(*) AS n_requests, count(*) FILTER (status = 200) AS n_succeeded, count(*) FILTER (status <> 200) AS n_failed,
    {r('count(*) / ((max(ts_us) - min(ts_us)) / 1e6::double)')} AS throughput_rps, {r('avg(latency_ms)')} AS mean,
    {r('stddev_pop(latency_ms)')} AS stdev, {r('min(latency_ms)')} AS min,
    {r(_LAT.format(0.5))} AS p50, {r(_LAT.format(0.9))} AS p90, {r(_LAT.format(0.95))} AS p95, {r(_LAT.format(0.99))} AS p99,
    {r('max(latency_ms)')} AS max FROM preds GROUP BY 1""",
)
def agg32(spark, sf):
    return logs.latency_summary(X.preds(spark, sf), ["scenario"])


@register("agg32_status_counts", "preds", "SELECT status::bigint AS status, count(*) AS n FROM preds GROUP BY 1")
def agg32_status(spark, sf):
    return logs.status_counts(X.preds(spark, sf))


@register(
    "agg33_recent_latency",
    "preds",
    f"""SELECT count(*) AS n, {r(_LAT.format(0.5))} AS p50, {r(_LAT.format(0.95))} AS p95, {r(_LAT.format(0.99))} AS p99
    FROM (SELECT latency_ms FROM preds ORDER BY ts_us DESC, id DESC LIMIT 2000)""",
)
def agg33(spark, sf):
    return logs.recent_latency_percentiles(X.preds(spark, sf), keys=KEYS)


@register(
    "agg34_score_histogram",
    "preds",
    f"""SELECT scenario, bin, {r('bin / 40.0::double')} AS bin_start, n,
    {r('n / (sum(n) OVER (PARTITION BY scenario) * 0.025::double)')} AS density
    FROM (SELECT g.scenario, b.bin, count(p.scenario) AS n FROM (SELECT DISTINCT scenario FROM preds) g CROSS JOIN range(40) b(bin)
      LEFT JOIN preds p ON p.scenario = g.scenario AND least(floor(p.probability * 40), 39)::bigint = b.bin GROUP BY 1, 2)""",
)
def agg34(spark, sf):
    return metrics.score_histogram(X.preds(spark, sf), ["scenario"], "probability")


@register(
    "jn4_feedback_attach",
    "preds all_feedback",
    """SELECT p.request_id, f.ground_truth::bigint AS ground_truth, f.arrival AS arrival_us, f.source AS feedback_source FROM preds p LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival DESC, ground_truth DESC, source DESC) AS rn FROM all_feedback)
      WHERE rn = 1) f USING (request_id)""",
)
def jn4(spark, sf):
    out = logs.attach_feedback(X.preds(spark, sf), X.corrected_feedback(spark, sf))
    return out.select("request_id", "ground_truth", F.unix_micros("ground_truth_ts").alias("arrival_us"), "feedback_source")


@register(
    "jn4_unknown_feedback",
    "preds all_feedback",
    "SELECT request_id, ground_truth::bigint AS ground_truth, arrival AS arrival_us FROM all_feedback WHERE request_id NOT IN (SELECT request_id FROM preds)",
)
def jn4_unknown(spark, sf):
    out = logs.unknown_feedback(X.preds(spark, sf), X.corrected_feedback(spark, sf))
    return out.select("request_id", "ground_truth", F.unix_micros("arrival").alias("arrival_us"))


_WINDOWS = """
win AS (SELECT *, i // 200 AS window_index FROM (SELECT *, row_number() OVER (ORDER BY ts_us, id) - 1 AS i FROM preds)),
kept AS (SELECT * FROM win WHERE window_index IN (SELECT window_index FROM win GROUP BY 1 HAVING count(*) >= 100))"""


@register(
    "win1_count_windows",
    "preds",
    f"""WITH {_WINDOWS} SELECT window_index, min(i) AS row_start, max(i) + 1 AS row_end, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM kept GROUP BY 1""",
)
def win1(spark, sf):
    w = logs.count_windows(X.preds(spark, sf).select("id", "ts_us"), keys=KEYS)
    return w.groupBy("window_index", "row_start", "row_end").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@register("win2_latest_window", "preds", "SELECT id, ts_us, scenario FROM (SELECT * FROM preds WHERE scenario = 'view' ORDER BY ts_us DESC, id DESC LIMIT 200)")
def win2(spark, sf):
    return logs.latest_window(X.preds(spark, sf), 200, "view", keys=KEYS).select("id", "ts_us", "scenario")


@register(
    "win3_first_present",
    "preds",
    f"""WITH {_WINDOWS} SELECT window_index, arg_min(scenario, i) FILTER (scenario <> 'click') AS first_scenario,
    arg_min(ground_truth, i) FILTER (ground_truth IS NOT NULL)::bigint AS first_ground_truth FROM kept GROUP BY 1""",
)
def win3(spark, sf):
    rows = X.preds(spark, sf).select(
        "id", "ts_us", F.when(F.col("scenario") != "click", F.col("scenario")).alias("scenario"), "ground_truth"
    )
    w = logs.count_windows(rows, keys=KEYS)
    return logs.first_present(w, ["window_index"], ["scenario", "ground_truth"], KEYS)


def _log_rows(preds):
    """The fixture log in the stored schema."""
    from lineguard import schemas

    have = {
        "id": F.col("id"),
        "request_id": F.col("id").cast("string"),
        "ts": F.col("ts"),
        "ts_iso": C.utc_iso(F.col("ts")),
        "model_threshold": F.col("model_threshold"),
        "source": F.lit("batch"),
        "probability": F.col("probability"),
        "predicted_label": F.col("predicted_label"),
        "predicted_class": F.col("predicted_class"),
        "decision": F.col("decision"),
        "latency_ms": F.col("latency_ms"),
        "scenario": F.col("scenario"),
    }
    return preds.select(
        *[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PREDICTION.fields]
    )


@register(
    "src7_append_predictions",
    "preds",
    f"SELECT scenario, count(*) AS n, {r('avg(probability)')} AS mean_probability, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS last_iso FROM preds GROUP BY 1",
)
def src7(spark, sf):
    """Two appends, then a read of the stored log."""
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "log")
    rows = _log_rows(X.preds(spark, sf))
    tables.append_predictions(rows.where(F.col("probability") < 0.5), path)
    tables.append_predictions(rows.where(F.col("probability") >= 0.5), path)
    stored = tables.read_predictions(spark, path)
    return stored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.max("ts_iso").alias("last_iso")
    )


@register(
    "src8_replace_scenario",
    "preds",
    "SELECT scenario, count(*) FILTER (scenario <> 'error' OR probability >= 0.5::double) AS n FROM preds WHERE scenario <> 'view' GROUP BY 1",
)
def src8(spark, sf):
    """Write all, replace one scenario by a subset of its rows, clear another."""
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "log")
    rows = _log_rows(X.preds(spark, sf))
    tables.append_predictions(rows, path)
    tables.replace_scenario(rows.where((F.col("scenario") == "error") & (F.col("probability") >= 0.5)), path)
    tables.clear_predictions(spark, path, "view")
    return tables.read_predictions(spark, path).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


@register("src9_export_jsonl", "preds", f"SELECT id, scenario, {r('probability')} AS probability FROM preds")
def src9(spark, sf):
    from lineguard import schemas
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "jsonl")
    tables.export_jsonl(_log_rows(X.preds(spark, sf)), path)
    return spark.read.schema(schemas.PREDICTION).json(path).select("id", "scenario", "probability")
