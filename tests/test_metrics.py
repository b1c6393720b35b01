"""Metrics, thresholds and intervals against direct computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineguard.operators import bootstrap, metrics


def frame(spark, y, p):
    rows = [(None if a is None else int(a), float(b)) for a, b in zip(y, p)]
    return spark.createDataFrame(rows, "y int, p double")


def naive_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a == 1], [b for a, b in zip(y, p) if a == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_exact_cells_and_perfect_scores(spark):
    row = metrics.classification_metrics(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), [], "p", "y").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 0, 0, 2)
    assert row["f1"] == row["roc_auc"] == row["average_precision"] == row["mcc"] == 1.0


def test_auc_with_ties_and_unlabelled_rows(spark):
    y, p = [1, 0, 1, 0, 1, 0], [0.5, 0.5, 0.5, 0.7, 0.3, 0.5]
    row = metrics.rank_metrics(frame(spark, [*y, None], [*p, 0.9]), [], "p", "y").first()
    assert row["roc_auc"] == pytest.approx(naive_auc(y, p), abs=1e-12)


def test_one_class_has_no_rank_metrics(spark):
    row = metrics.classification_metrics(frame(spark, [1, 1], [0.2, 0.7]), [], "p", "y").first()
    assert row["roc_auc"] is None and row["average_precision"] is None and row["recall"] == 0.5


@pytest.fixture(scope="module")
def beta(spark):
    rng = np.random.default_rng(0)
    y = np.r_[np.zeros(200, int), np.ones(200, int)]
    p = np.r_[rng.beta(2, 6, 200), rng.beta(6, 2, 200)]
    p[::9] = np.round(p[::9] * 500) / 500  # on grid points
    return y, p, frame(spark, y, p)


def scores(y, p, t):
    hit = p >= t
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    prec, rec = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
    return prec, rec, (2 * prec * rec / (prec + rec) if prec + rec else 0.0)


def test_thresholds_match_a_full_grid_search(beta):
    y, p, df = beta
    grid = np.linspace(0, 1, 501)
    all_scores = [scores(y, p, t) for t in grid]
    best = int(np.argmax([s[2] for s in all_scores]))
    assert metrics.choose_threshold(df, [], "p", "y").first()["threshold"] == pytest.approx(grid[best], abs=1e-12)
    feasible = [(s[0], t) for s, t in zip(all_scores, grid) if s[1] >= 0.9]
    row = metrics.choose_threshold(df, [], "p", "y", "target_recall", target_recall=0.9).first()
    assert row["threshold"] == pytest.approx(max(feasible, key=lambda x: x[0])[1], abs=1e-12) and row["reachable"]


def test_unreachable_recall_is_flagged(spark):
    row = metrics.choose_threshold(frame(spark, [0, 0], [0.1, 0.4]), [], "p", "y", "target_recall").first()
    assert not row["reachable"] and "unreachable" in row["rationale"]


def test_unknown_strategy_raises(beta):
    with pytest.raises(ValueError):
        metrics.choose_threshold(beta[2], [], "p", "y", "guess")


def test_fixed_strategy(beta):
    y, p, df = beta
    row = metrics.choose_threshold(df, [], "p", "y", "fixed", fixed_threshold=0.4).first()
    assert row["f1"] == pytest.approx(scores(y, p, 0.4)[2])


@pytest.mark.parametrize("metric", bootstrap.CELL_BOOTSTRAP)
def test_bootstrap_brackets_the_point(beta, metric):
    row = bootstrap.bootstrap_cells(beta[2], [], "p", "y", 0.5, metric).first()
    assert row["lo"] <= row["point"] <= row["hi"] and row["hi"] - row["lo"] < 0.15 and row["n_bootstrap"] == 500


def test_bootstrap_matches_row_resampling(beta):
    y, p, df = beta
    rng = np.random.default_rng(1)
    draws = []
    for _ in range(500):
        i = rng.integers(0, len(y), len(y))
        draws.append(scores(y[i], p[i], 0.5)[2])
    row = bootstrap.bootstrap_cells(df, [], "p", "y", 0.5, "f1").first()
    np.testing.assert_allclose([row["lo"], row["hi"]], np.percentile(draws, [2.5, 97.5]), atol=0.012)


def test_bootstrap_of_nothing_is_null(spark):
    row = bootstrap.bootstrap_cells(frame(spark, [], []), [], "p", "y", 0.5).first()
    assert row["point"] is None and row["lo"] is None


def test_bootstrap_auc_brackets_and_repeats(beta):
    y, p, df = beta
    a = bootstrap.bootstrap_ranked(df.repartition(2), [], "p", "y", n_samples=60).first()
    b = bootstrap.bootstrap_ranked(df.repartition(5), [], "p", "y", n_samples=60).first()
    assert a["lo"] <= naive_auc(y, p) <= a["hi"] and a["lo"] == pytest.approx(b["lo"], abs=1e-12)


@pytest.mark.parametrize("metric", ["roc_auc", "average_precision", "brier", "f1"])
def test_bootstrap_ranked_equals_weighted_metrics(spark, monkeypatch, metric):
    """Each replicate is the metric of the same rows with the weights that the operator draws."""
    monkeypatch.setattr(bootstrap, "_TOGETHER", 7)
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 900), np.round(rng.random(900), 2)
    df = frame(spark, y, p).withColumn("g", F.when(F.col("p") < 2, F.lit(None).cast("string"))).repartition(4)
    row = bootstrap.bootstrap_ranked(df, ["g"], "p", "y", metric, n_samples=40).collect()
    assert len(row) == 1 and row[0]["n_bootstrap"] == 40
    counts = metrics.score_counts(df, ["g"], "p", "y").withColumn("k", F.xxhash64("g", "score")).orderBy("score").toPandas()
    a, b = bootstrap._replicates(*(counts[c].to_numpy() for c in ("pos", "neg", "k")), 40, 42)
    s, values = counts["score"].to_numpy(), []
    for j in range(41):
        yy = np.concatenate([np.ones(int(a[:, j].sum())), np.zeros(int(b[:, j].sum()))])
        pp = np.concatenate([np.repeat(s, a[:, j].astype(int)), np.repeat(s, b[:, j].astype(int))])
        if metric == "roc_auc":
            v = naive_auc(yy.tolist(), pp.tolist())
        elif metric == "average_precision":
            v = sum((yy[pp == t].sum() / yy.sum()) * yy[pp >= t].mean() for t in np.unique(pp))
        elif metric == "brier":
            v = np.mean((pp - yy) ** 2)
        else:
            v = scores(yy, pp, 0.5)[2]
        values.append(v)
    want = [values[0], *np.percentile(values[1:], [2.5, 97.5])]
    np.testing.assert_allclose([row[0][c] for c in ("point", "lo", "hi")], want, rtol=1e-9)


def test_bootstrap_ranked_of_one_class_and_of_nothing(spark):
    row = bootstrap.bootstrap_ranked(frame(spark, [1, 1], [0.1, 0.9]), [], "p", "y", n_samples=20).first()
    assert row["point"] is None and row["n_bootstrap"] == 0
    assert bootstrap.bootstrap_ranked(frame(spark, [], []), [], "p", "y").collect() == []


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label int")
    w = {r["label"]: r["weight"] for r in metrics.class_weights(df, "label", 2).collect()}
    assert w[0] + w[1] == pytest.approx(2.0) and w[1] / w[0] == pytest.approx(3.0)
    assert metrics.positive_weight(df, "label").first()[0] == pytest.approx(3.0)


def test_results_do_not_depend_on_partitioning(beta):
    _, _, df = beta
    grouped = df.withColumn("g", F.when(F.col("p") > 0.05, "hot").otherwise("cold"))
    a = metrics.classification_metrics(grouped.repartition(1), ["g"], "p", "y").orderBy("g").collect()
    b = metrics.classification_metrics(grouped.repartition(16), ["g"], "p", "y").orderBy("g").collect()
    for x, z in zip(a, b):
        for c in x.asDict():
            assert x[c] == z[c] or x[c] == pytest.approx(z[c], abs=1e-12)


def test_auc_interval_draws_all_replicates(spark):
    from lineguard import params
    from lineguard.plans import catalog

    rows = catalog.queries()["agg26_bootstrap_auc"](spark, "/root/testdata/sf0.001").collect()
    drawn = [r["n_bootstrap"] for r in rows]
    assert rows and max(drawn) > 0.9 * params.BOOTSTRAP_SAMPLES and max(drawn) <= params.BOOTSTRAP_SAMPLES
