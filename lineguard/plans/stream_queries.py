"""Streaming queries: the events table read as a stream, processed to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import route_decision
from lineguard.plans import fixtures as X
from lineguard.plans.drift_queries import _SIG_VIEWS, _WIN, _rule_sql, _signals, window_report
from lineguard.plans.image_queries import control_model
from lineguard.plans.registry import register
from lineguard.plans.views_sql import drift_sql, r
from lineguard.session import stage
from lineguard.streaming import jobs
from lineguard.streaming.trigger import stateful_trigger


def event_stream(spark, sf):
    """The events table as a stream, in the fixture log's columns."""
    schema = X.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return X.event_rows(raw)


@register("src12_stream_predictions", "preds", f"SELECT id, scenario, {r('probability')} AS probability FROM preds WHERE decision = 'human_review'")
def src12(spark, sf):
    """Store the log, then follow it as a stream."""
    from lineguard.plans.log_queries import _log_rows
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "log")
    tables.append_predictions(_log_rows(X.preds(spark, sf)), path)
    stream = tables.stream_predictions(spark, path).where("decision = 'human_review'")
    return jobs.run_to_table(stream.select("id", "scenario", "probability"), "followed")


@register(
    "str1_stream_score",
    "preds",
    "SELECT scenario, count(*) AS n_rows, count(DISTINCT request_id) AS n_requests, 0::bigint AS n_wrong FROM preds GROUP BY 1",
)
def str1(spark, sf):
    """Every request is scored once, though its first batch is written a second time, as after a crash.

    ``n_wrong`` counts rows whose label or routing does not follow from their probability.
    """
    from lineguard.session import shared_folder

    fitted = control_model(spark, sf)
    requests = event_stream(spark, sf).select("request_id", "ts", "scenario", *X.PRED_FEATURES)
    path = shared_folder(spark, "scored")
    scored = jobs.run_by_batch(jobs.stream_score(requests, fitted, context={"model_name": "control"}), "scored", path=path)
    jobs.write_batch(stage(scored.where("batch = 0").drop("batch"), "replayed"), 0, path)
    scored = spark.read.schema(scored.schema).parquet(f"{path}/rows")
    p, low, high = F.col("probability"), *params.REVIEW_BAND
    routed = route_decision(p, F.col("model_threshold"), low, high)
    right = p.between(0, 1) & (F.col("predicted_label") == (p >= F.col("model_threshold")).cast("int")) & (F.col("decision") == routed)
    return scored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("request_id").alias("n_requests"), F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong")
    )


_W = """
closed AS (SELECT *, epoch_us(date_trunc('day', ts)) AS g FROM preds
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM preds)),
wl AS (""" + " UNION ALL ".join(f"SELECT g, '{f}' AS feature, {i} AS pos, {f} AS value FROM closed" for i, f in enumerate(X.PRED_FEATURES)) + ")"


@register(
    "str2_stream_window_signals",
    "preds ref_share edges",
    f"""WITH {_W}, {drift_sql('wl', 'g')},
    roll AS (SELECT g, max(psi) AS psi_max, avg(psi) AS psi_mean, count(*) FILTER (psi >= 0.1) AS n_drifted, first(feature ORDER BY round(psi, 9) DESC, pos) AS worst_feature FROM drift GROUP BY 1),
    beh AS (SELECT g, count(*) AS n_samples, avg(greatest(probability, 1.0::double - probability)) AS mean_confidence,
      avg((decision = 'human_review')::int::double) AS review_rate, count(ground_truth) AS n_labeled,
      avg(((probability >= 0.5::double) = (ground_truth = 1))::int::double) FILTER (ground_truth IS NOT NULL) AS acc FROM closed GROUP BY 1)
    SELECT g AS start_us, n_samples, {r('psi_max')} AS psi_max, {r('psi_mean')} AS psi_mean, n_drifted, worst_feature, {r('mean_confidence')} AS mean_confidence,
    {r('0.8::double - mean_confidence')} AS mean_confidence_drop, {r('review_rate')} AS review_rate, CASE WHEN n_labeled >= 20 THEN n_labeled ELSE 0 END AS n_labeled,
    CASE WHEN n_labeled >= 20 THEN {r('acc')} END AS accuracy, CASE WHEN n_labeled >= 20 THEN {r('0.8::double - acc')} END AS accuracy_drop
    FROM beh JOIN roll USING (g)""",
)
def str2(spark, sf):
    signals = jobs.window_signals(event_stream(spark, sf), X.reference(spark, sf))
    stored = jobs.run_to_table(signals, "signals")
    rest = [c for c in stored.columns if c not in ("window_start", "window_end")]
    return stored.select(F.unix_micros("window_start").alias("start_us"), *rest)


def _feedback_stream(spark, sf):
    rows = event_stream(spark, sf).where(F.col("ground_truth").isNotNull())
    return X.corrected_rows(X.feedback_rows(rows))


@register(
    "str3_stream_feedback_join",
    "preds all_feedback",
    """WITH mark AS (SELECT (least((SELECT max(ts_us) FROM preds), (SELECT max(arrival) FROM all_feedback)) // 1000 - 3600000 - 1) * 1000 AS passed),
    last AS (SELECT request_id, max({'arrival': arrival, 'truth': ground_truth, 'source': source}) AS f FROM all_feedback GROUP BY 1)
    SELECT p.request_id, p.scenario, f.truth::bigint AS ground_truth, f.arrival AS arrival_us, f.source AS feedback_source
    FROM preds p LEFT JOIN last USING (request_id) WHERE p.ts_us + 3::bigint * 86400000000 <= (SELECT passed FROM mark)""",
)
def str3(spark, sf):
    """Predictions whose three days are over: the last label, corrections included, or none."""
    p = event_stream(spark, sf).select("request_id", "ts", "scenario", "probability")
    stored = jobs.run_to_table(jobs.feedback_join(p, _feedback_stream(spark, sf), within="3 days"), "labelled")
    return stored.select("request_id", "scenario", "ground_truth", F.unix_micros("ground_truth_ts").alias("arrival_us"), "feedback_source")


_EV = " UNION ALL ".join(_rule_sql(n, m, o, t) for n, m, o, t, _ in params.RULES)
#: Windows are six hours apart for the cooldown clock and come up to two places late, in so many parts.
_HOURS_APART, _DELAY_HOURS, _PARTS = 6, 13, 3


@register(
    "str4_stream_trigger",
    _SIG_VIEWS,
    f"""WITH RECURSIVE {_WIN}, {_signals('window_index')}, ev AS ({_EV}),
    passed AS (SELECT max(window_index) * {_HOURS_APART} - {_DELAY_HOURS} AS hours FROM final),
    two AS (SELECT window_index, rule, breached AND coalesce(lag(breached) OVER (PARTITION BY rule ORDER BY window_index), false) AS fired FROM ev),
    f AS (SELECT window_index, string_agg(rule, ',' ORDER BY rule) AS fired_rules, row_number() OVER (ORDER BY window_index) AS k
      FROM two WHERE fired AND window_index * {_HOURS_APART} <= (SELECT hours FROM passed) GROUP BY 1),
    notes AS (SELECT k, window_index AS last FROM f WHERE k = 1
      UNION ALL SELECT f.k, CASE WHEN (f.window_index - n.last) * {_HOURS_APART} >= {params.RETRAINING["cooldown_hours"]} THEN f.window_index ELSE n.last END
      FROM notes n JOIN f ON f.k = n.k + 1)
    SELECT 'control' AS model, window_index, fired_rules, window_index = last AS notified FROM f JOIN notes USING (k)""",
)
def str4(spark, sf):
    """Window signals that arrive out of order, a part at a time; the query is started anew for each part."""
    from lineguard.session import shared_folder

    report = window_report(spark, sf, with_ks=False)
    ends = X.preds(spark, sf).agg(F.max("ts_us")).first()[0]
    metrics = sorted({m for _, m, *_ in params.RULES})
    rows = stage(
        report.select(
            F.lit("control").alias("model"),
            "window_index",
            (F.lit(ends / 1e6) + F.col("window_index") * (_HOURS_APART * 3600.0)).alias("at"),
            *metrics,
            (F.col("window_index") + 2 * F.pmod(F.xxhash64("window_index"), F.lit(2))).alias("arrives"),
        ),
        "window-signals",
    )
    last = rows.agg(F.max("arrives")).first()[0] or 0
    path, out = shared_folder(spark, "arriving"), shared_folder(spark, "trigger")
    schema = rows.drop("arrives").schema
    for part in range(_PARTS):
        due = rows.where(F.floor(F.col("arrives") * _PARTS / (last + 1)) == part).orderBy(F.xxhash64("arrives", "window_index"))
        due.drop("arrives").write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        fired = jobs.run_to_table(stateful_trigger(stream, delay=f"{_DELAY_HOURS} hours"), "trigger", path=out, keyed_state=True)
    return fired


@register("str5_stream_dedup_requests", "preds", "SELECT request_id, 1::bigint AS n FROM preds")
def str5(spark, sf):
    """Every request is sent again, at once or some minutes later, and all of them anew in a second batch.

    Repeats within the watermark find their request in the state; older ones are late and dropped.
    """
    from lineguard.session import shared_folder

    log = X.preds(spark, sf).select("request_id", "ts")
    minutes = F.explode(F.array(F.lit(0), F.pmod(F.xxhash64("request_id"), F.lit(30)).cast("int")))
    path = shared_folder(spark, "repeated")
    rows = log.select("request_id", "ts", minutes.alias("m")).select("request_id", F.timestamp_seconds(F.unix_micros("ts") / 1e6 + F.col("m") * 60).alias("ts"))
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    kept = jobs.run_to_table(jobs.dedup_requests(stream, delay="1 hour"), "deduped")
    return kept.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
