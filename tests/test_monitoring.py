"""Log store, feedback, window signals, policy, run table and streams."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineguard import params, schemas
from lineguard.functions import columns as C
from lineguard.operators import drift, logs, monitor, policy, runs
from lineguard.sources import tables
from lineguard.streaming import jobs
from lineguard.streaming.trigger import OrderedTrigger, stateful_trigger, step_trigger


def log_frame(spark, n=30, scenario="line"):
    rows = spark.range(n).select(
        F.col("id"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        (F.col("id") % 10 / 10.0).alias("probability"),
        (F.col("id") % 2).cast("int").alias("predicted_label"),
        F.lit("auto_accept").alias("decision"),
        F.lit(5.0).alias("latency_ms"),
        F.lit(scenario).alias("scenario"),
    )
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PREDICTION.fields])


def test_log_store(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.append_predictions(log_frame(spark, 30, "a b/c"), path)
    tables.append_predictions(log_frame(spark, 20, "two"), path)
    read = lambda: {r["scenario"]: r["n"] for r in logs.scenario_counts(tables.read_predictions(spark, path)).collect()}
    assert read() == {"a b/c": 30, "two": 20}
    tables.replace_scenario(log_frame(spark, 7, "two"), path)
    assert read() == {"a b/c": 30, "two": 7}
    log = tables.read_predictions(spark, path)
    window = logs.latest_window(log, 5, "a b/c").collect()
    assert [r["id"] for r in window] == [25, 26, 27, 28, 29]
    tables.export_jsonl(log, f"{tmp_path}/jsonl", limit=12)
    assert spark.read.text(f"{tmp_path}/jsonl").count() == 12
    tables.clear_predictions(spark, path, "a b/c")
    assert read() == {"two": 7}
    tables.clear_predictions(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.read_predictions(spark, path)


def test_late_labels_last_write_wins(spark):
    fb = spark.createDataFrame(
        [("r1", 0, 10.0, "a"), ("r1", 1, 20.0, "b"), ("zz", 1, 5.0, "a")], "request_id string, ground_truth int, at double, source string"
    ).select("request_id", "ground_truth", F.timestamp_seconds("at").alias("arrival"), "source")
    log = log_frame(spark)
    got = logs.attach_feedback(log, fb)
    assert got.count() == 30 and got.where("request_id = 'r1'").first()["ground_truth"] == 1
    assert [r["request_id"] for r in logs.unknown_feedback(log, fb).collect()] == ["zz"]


def test_summary_of_an_empty_log(spark):
    row = logs.log_summary(log_frame(spark).withColumn("ground_truth", F.lit(None).cast("int")).limit(0)).first()
    assert row["n_predictions"] == 0 and row["review_rate"] == 0.0 and row["mean_probability"] is None


def test_review_band_is_closed_and_wins(spark):
    df = spark.createDataFrame([(x,) for x in (0.34, 0.35, 0.5, 0.65, 0.66)], "p double")
    got = [r[0] for r in df.select(C.route_decision(F.col("p"), F.lit(0.4), *params.REVIEW_BAND)).collect()]
    assert got == ["auto_accept", "human_review", "human_review", "human_review", "auto_reject"]


# -- signals and policy -----------------------------------------------------------


@pytest.fixture(scope="module")
def monitored(spark):
    """2,000 rows; the last 800 are shifted and mislabelled."""
    base = spark.range(2000).select(
        "id",
        (F.col("id") * 1_000_000).alias("ts_us"),
        F.lit("line").alias("scenario"),
        (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0).alias("u"),
    )
    late = F.col("id") >= 1200
    rows = base.select(
        "id", "ts_us", "scenario",
        F.when(late, F.col("u") + 0.5).otherwise(F.col("u")).alias("x"),
        F.col("u").alias("probability"),
        (F.col("u") >= 0.5).cast("int").alias("predicted_label"),
        F.when(F.col("u").between(0.45, 0.55), "human_review").otherwise("auto_accept").alias("decision"),
        F.when(F.col("id") % 4 != 0, F.when(late, F.col("u") < 0.5).otherwise(F.col("u") >= 0.5).cast("int")).alias("ground_truth"),
        F.lit(0.5).alias("model_threshold"),
    )
    train = base.select(F.col("u").alias("x"), F.when(F.col("u") >= 0.5, "defect").otherwise("ok").alias("class_name"))
    ref = drift.build_reference(train, ["x"], class_col="class_name", baseline={"reference_accuracy": 0.95, "reference_recall": 0.9})
    return rows, ref


def test_window_report_and_decision(monitored):
    rows, ref = monitored
    report = monitor.window_report(rows, ref, size=200).cache()
    got = {r["window_index"]: r for r in report.collect()}
    assert len(got) == 10 and got[0]["psi_max"] < 0.1 < 0.25 < got[9]["psi_max"]
    assert got[0]["accuracy"] == 1.0 and got[9]["accuracy"] == 0.0 and got[9]["n_labeled"] == 150
    assert [a["signal"] for a in got[9]["alerts"]][0] == "data_drift"
    assert {"accuracy_degradation"} <= {a["signal"] for a in got[9]["alerts"]}
    assert got[9]["features"][0]["ks_statistic"] == pytest.approx(0.5, abs=0.03)

    go = policy.decide(report, now=1e6).first()
    assert go["action"] == "retrain" and go["should_retrain"] and go["hours_since_last_retrain"] is None
    cooling = policy.decide(report, now=1e6, last_retrain=1e6 - 3600).first()
    assert not cooling["should_retrain"] and "cooldown" in cooling["blockers"][0]
    few = policy.decide(report, now=1e6, policy={**params.RETRAINING, "min_new_labeled_samples": 10**6}).first()
    assert not few["should_retrain"] and "labels" in few["blockers"][0]
    # A breach on the last window alone does not persist.
    early = policy.persistent_breach(report.where("window_index <= 6"), n=2)
    assert [r["rule"] for r in early.collect()] == ["confidence_collapse"]  # low on every window
    none = policy.decide(report.limit(0), now=1e6).first()
    assert none["action"] == "none" and not none["should_retrain"] and none["windows_evaluated"] == 0


def test_scenario_report_skips_small_groups(spark, monitored):
    rows, ref = monitored
    tagged = rows.withColumn("scenario", F.when(F.col("id") < 50, "few").when(F.col("id") < 1200, "line").otherwise("new"))
    got = {r["scenario"]: r for r in monitor.scenario_report(tagged, ref, with_ks=False).collect()}
    assert set(got) == {"line", "new"} and got["new"]["n_samples"] == 800
    again = {r["scenario"]: r for r in monitor.scenario_report(tagged.repartition(16), ref, with_ks=False).collect()}
    for k in got:
        assert got[k]["psi_max"] == pytest.approx(again[k]["psi_max"], abs=1e-12)
        assert got[k]["roc_auc"] == pytest.approx(again[k]["roc_auc"], abs=1e-12)


def test_rules_guard_missing_and_nan(spark):
    df = spark.createDataFrame([(0, float("nan"), 0.3), (1, 0.9, None)], "window_index int, psi_max double, review_rate double")
    rules = (("a", "psi_max", ">=", 0.25, "high"), ("b", "review_rate", "<", 0.5, "low"), ("c", "absent", ">=", 0.0, "low"))
    got = {(r["window_index"], r["rule"]): r["breached"] for r in policy.evaluate_rules(df, rules).collect()}
    assert got == {(0, "a"): False, (1, "a"): True, (0, "b"): True, (1, "b"): False, (0, "c"): False, (1, "c"): False}
    with pytest.raises(ValueError):
        policy.evaluate_rules(df, (("d", "psi_max", "~", 1.0, "low"),))


@pytest.mark.parametrize(
    "fired,psi,drop,labels,action",
    [(["accuracy_degradation", "data_drift_psi"], 0.9, 0.2, 50, "retrain"), (["data_drift_psi"], 0.9, 0.0, 50, "monitor"),
     (["data_drift_psi"], 0.9, None, 0, "investigate_capture"), (["data_drift_psi"], 0.3, None, 0, "retrain"),
     (["review_queue_overflow"], 0.0, None, 0, "recalibrate_or_retrain"), ([], 0.0, None, 0, "none")],
)
def test_actions(spark, fired, psi, drop, labels, action):
    df = spark.createDataFrame([(fired, psi, drop, labels)], "f array<string>, p double, d double, n int")
    a = policy.recommended_action(*(F.col(c) for c in "fpdn"))
    row = df.select(a.alias("a"), policy.next_steps(a).alias("s")).first()
    assert row["a"] == action and len(row["s"]) >= 1


def test_retrain_history(spark, tmp_path):
    path = f"{tmp_path}/history"
    assert tables.last_retrain(spark, path) is None
    for i in range(3):
        tables.record_retrain(spark, path, 100.0 + i, f"r{i}")
    assert tables.last_retrain(spark, path) == 102.0
    assert [r["reason"] for r in tables.retrain_history(spark, path, 2).collect()] == ["r2", "r1"]


# -- run table -----------------------------------------------------------------------


def run_rows(spark, rows):
    return spark.createDataFrame(rows, "model string, run_id string, start_time bigint, test_f1 double, test_recall double, latency_p95_ms double, ci_lo double")


def test_runs_are_cleaned_and_ties_go_to_the_newest(spark):
    nan = float("nan")
    df = run_rows(spark, [("a", "a1", 1, 0.9, 0.9, 5.0, None), ("a", "a2", 2, 0.9, 0.9, 5.0, None), ("a", "a3", 3, nan, 0.9, 5.0, None),
                          (None, "p1", 4, 0.99, 0.9, 5.0, None), ("b", "b1", 1, 0.8, nan, nan, None), ("c", "c1", 9, None, 0.9, 1.0, None)])
    for n in (1, 3, 8):
        got = {r["model"]: r for r in runs.clean_runs(df.repartition(n)).collect()}
        assert set(got) == {"a", "b"} and got["a"]["run_id"] == "a2"
        assert got["b"]["test_recall"] == 0.0 and got["b"]["threshold"] == 0.5


@pytest.mark.parametrize("lo,chosen", [(0.93, "fast"), (0.949, "lead"), (None, "lead")])
def test_selection_breaks_ties_on_latency(spark, lo, chosen):
    df = run_rows(spark, [("lead", "1", 1, 0.95, 0.9, 20.0, lo), ("fast", "2", 1, 0.94, 0.9, 3.0, 0.9), ("bad", "3", 1, 0.99, 0.1, 1.0, 0.9), ("slow", "4", 1, 0.94, 0.9, None, 0.9)])
    gated = runs.evaluate_gates(df)
    reasons = {r["model"]: r["reason"] for r in gated.collect()}
    assert reasons["lead"] == "eligible" and reasons["bad"] == "test_recall 0.1000 < 0.8500" and "latency" in reasons["slow"]
    assert runs.select_best(gated).first()["model"] == chosen
    assert [r["model"] for r in runs.comparison_report(gated).where("selected").collect()] == [chosen]


def test_nothing_eligible(spark):
    row = runs.select_best(runs.evaluate_gates(run_rows(spark, [("a", "1", 1, 0.1, 0.1, 1.0, None)]))).first()
    assert row["model"] is None and "no candidate" in row["rationale"]


def test_best_epoch_matches_the_loop(spark):
    histories = {1: [0.1, 0.3, 0.2, 0.2, 0.9], 2: [0.5, 0.4, 0.4], 3: [0.1, 0.2, 0.3], 4: [0.2, float("nan"), 0.3, 0.1, 0.1, 0.8]}
    for patience in (2, 3):
        df = spark.createDataFrame([(r, i, v) for r, h in histories.items() for i, v in enumerate(h)], "run_id int, epoch int, score double")
        got = {r["run_id"]: r["best_epoch"] for r in runs.best_epoch(df, patience=patience).collect()}
        for run, h in histories.items():
            best, at, idle = float("-inf"), None, 0
            for i, v in enumerate(h):
                if v > best:
                    best, at, idle = v, i, 0
                else:
                    idle += 1
                    if idle >= patience:
                        break
            assert got[run] == at


# -- streams ----------------------------------------------------------------------------


def test_last_label_wins_and_unlabelled_rows_leave_once(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    p = spark.createDataFrame([(i, t0 + dt.timedelta(hours=i)) for i in range(48)], "request_id int, ts timestamp")
    at = lambda h: t0 + dt.timedelta(hours=h)
    labels = [(i, i % 2, at(i + (2 if i % 3 else 30)), "line") for i in range(48)]  # every third label is too late
    labels += [(i, 1 - i % 2, at(i + 5), "audit") for i in range(0, 48, 4)]  # corrections, and first labels of some
    labels += [(i, i % 2, at(i + 11), "late") for i in range(0, 48, 5)] + [(900, 1, at(4), "stray")]
    f = spark.createDataFrame(labels[::-1], "request_id int, ground_truth int, arrival timestamp, source string")
    p.write.parquet(f"{tmp_path}/p")
    f.write.parquet(f"{tmp_path}/f")
    joined = jobs.feedback_join(
        spark.readStream.schema(p.schema).parquet(f"{tmp_path}/p"), spark.readStream.schema(f.schema).parquet(f"{tmp_path}/f"), within="10 hours"
    )
    rows = [(r["request_id"], r["ground_truth"], r["feedback_source"]) for r in jobs.run_to_table(joined, "joined").collect()]
    want = []
    for i in range(36):  # the prediction watermark stands at hour 46
        mine = [x for x in labels if x[0] == i and x[2] <= at(i + 10)]
        last = max(mine, key=lambda x: x[2], default=(i, None, None, None))
        want.append((i, last[1], last[3]))
    assert sorted(rows) == want and any(y is None for _, y, _ in want) and any(s == "audit" for *_, s in want)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    spark.range(20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: jobs.run_by_batch(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "rows", path=f"{tmp_path}/out")
    assert run().count() == 20
    spark.range(20, 30).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run().where("batch = 1").count() == 10
    jobs.write_batch(spark.range(20, 30), 1, f"{tmp_path}/out")
    assert sorted(r["id"] for r in run().collect()) == list(range(30))


def test_trigger_replays_like_the_batch_rule():
    rules = params.RULES
    rows = [{"psi_max": v, "at": 3600.0 * i} for i, v in enumerate([0.3, 0.1, 0.3, 0.3, 0.3, float("nan"), 0.4, 0.4])]
    streaks, last, fired, notified = {}, None, [], []
    for i, row in enumerate(rows):
        streaks, last, names, note = step_trigger(streaks, last, row, rules, 2, 2 * 3600.0)
        fired += [i] if names else []
        notified += [i] if note else []
    assert fired == [3, 4, 7] and notified == [3, 7]


def test_stateful_trigger_orders_windows_over_batches_and_restarts(spark, tmp_path):
    values = [0.0, 0.0, 0.3, 0.3, 0.3, 0.3, 0.0, 0.3, float("nan"), 0.3, 0.3, 0.3, 0.3]
    schema = "model string, window_index long, at double, psi_max double"
    out = f"{tmp_path}/out"

    def arrive(*windows):
        rows = [(m, i, i * 3600.0, values[i]) for i in windows for m in ("a", "b")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        fired = jobs.run_to_table(stateful_trigger(stream, cooldown_hours=2, delay="3 hours"), "t", path=out, keyed_state=True)
        got = sorted((r["model"], r["window_index"], r["fired_rules"], r["notified"]) for r in fired.collect())
        assert [g[1:] for g in got if g[0] == "a"] == [g[1:] for g in got if g[0] == "b"]
        return [g[1:] for g in got if g[0] == "a"]

    assert arrive(2, 0, 1) == []
    assert arrive(4, 3) == []  # the watermark stands at window 1
    arrive(6, 5, 4)  # window 4 again, while it waits
    arrive(9, 7, 8)
    arrive(3)  # long released: late
    last = arrive(12, 11, 10)
    streaks, clock, want = {}, None, []
    for i in range(10):
        row = {"psi_max": values[i], "at": i * 3600.0}
        streaks, clock, names, note = step_trigger(streaks, clock, row, params.RULES, params.RETRAINING["consecutive_windows"], 7200.0)
        want += [(i, ",".join(names), note)] if names else []
    assert last == want and [w[0] for w in want] == [3, 4, 5]


class StateCalls:
    """A processor handle that keeps its state in dictionaries and counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def _state(self, *_):
        return StateStub(self)

    getListState = getMapState = getValueState = _state


class StateStub:
    def __init__(self, handle):
        self.handle, self.rows, self.map, self.value = handle, [], {}, None

    def __getattribute__(self, name):
        if name in ("get", "put", "appendList", "clear", "iterator", "updateValue", "removeKey", "update", "exists"):
            object.__getattribute__(self, "handle").calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return iter(self.rows) if self.value is None else self.value

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows.extend(rows)

    def clear(self):
        self.rows = []

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)

    def update(self, value):
        self.value = value

    def exists(self):
        return self.value is not None


class Clock:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_trigger_calls_the_state_store_per_block_not_per_window():
    processor, handle = OrderedTrigger(params.RULES, 2, 7200.0), StateCalls()
    processor.init(handle)
    metrics = {m for _, m, *_ in params.RULES}
    rows = pd.DataFrame([{"window_index": i, "at": i * 3600.0, **{m: 1.0 for m in metrics}} for i in (*range(999, -1, -1), 5)])
    list(processor.handleInputRows(("m",), iter([rows[:600], rows[600:]]), None))
    found = []
    for watermark in (100 * 3_600_000, 2000 * 3_600_000):
        while due := sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(due[0])
            for out in processor.handleExpiredTimer(("m",), Clock(watermark), Clock(due[0])):
                found += out["window_index"].tolist()
    assert found == list(range(1, 1000)) and not handle.timers
    assert handle.calls < 100
