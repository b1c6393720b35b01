"""Drift statistics: known shapes, brute force and store round trips."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineguard.functions import pvalues
from lineguard.operators import drift
from lineguard.sources import tables


def values_frame(spark, **columns):
    n = max(len(v) for v in columns.values())
    rows = [tuple(float(v[i]) if i < len(v) else None for v in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("class_name", F.lit("ok"))


@pytest.fixture(scope="module")
def normal(spark):
    rng = np.random.default_rng(0)
    df = values_frame(spark, x=rng.normal(0, 1, 5000), c=np.full(500, 3.0))
    return drift.build_reference(df, ["x", "c"], class_col="class_name")


def psi_value(spark, ref, sample, feature="x"):
    row = drift.psi(values_frame(spark, **{feature: sample}), [], ref, [feature]).first()
    return row["psi"], row["severity"]


def test_edges_and_quantiles_match_numpy(normal):
    row = normal.stats.where("feature = 'x'").first()
    values = np.concatenate([[r["value"]] * r["n"] for r in normal.values.where("feature = 'x'").collect()])
    expected = np.percentile(values, np.linspace(0, 100, 11))
    np.testing.assert_allclose(row["bin_edges"][1:-1], expected[1:-1], rtol=1e-12)
    assert row["bin_edges"][0] == -math.inf and row["bin_edges"][-1] == math.inf
    assert row["std"] == pytest.approx(values.std()) and sum(row["bin_shares"]) == pytest.approx(1.0)


def test_psi_grows_with_the_shift(spark, normal):
    rng = np.random.default_rng(1)
    found = [psi_value(spark, normal, rng.normal(m, 1, 2000))[0] for m in (0.0, 0.5, 1.0, 2.0)]
    assert found[0] < 0.02 and found == sorted(found)
    assert psi_value(spark, normal, rng.normal(1, 1, 2000))[1] == "significant"


def test_constant_feature_and_empty_bins_are_finite(spark, normal):
    assert psi_value(spark, normal, np.full(50, 3.0), "c")[0] == 0.0
    assert math.isfinite(psi_value(spark, normal, np.full(50, 50.0))[0])


def test_value_on_an_edge_goes_up(spark, normal):
    edge = normal.frozen()["x"]["bin_edges"][3]
    rows = drift.bin_shares(values_frame(spark, x=[edge]), [], normal, ["x"]).where("n > 0").collect()
    assert [r["bin"] for r in rows] == [3]


def test_unusable_values_are_skipped(spark, normal):
    df = values_frame(spark, x=[0.1, math.nan, math.inf, -math.inf])
    assert drift.psi(df, [], normal, ["x"]).first()["n_current"] == 1
    assert drift.psi(values_frame(spark, x=[math.nan]), [], normal, ["x", "unknown"]).count() == 0


def test_empty_reference_raises(spark):
    with pytest.raises(ValueError):
        drift.build_reference(values_frame(spark, x=[1.0]).limit(0), ["x"], class_col="class_name")


def brute_ks(a, b):
    points = np.sort(np.r_[a, b])
    return max(abs(np.searchsorted(np.sort(a), points, "right") / len(a) - np.searchsorted(np.sort(b), points, "right") / len(b)))


def test_ks_per_group_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(0, 1, 700), 1)  # many ties
    ref = drift.build_reference(values_frame(spark, x=base), ["x"], class_col="class_name")
    groups = {f"g{i}": np.round(rng.normal(i / 2, 1 + i, 40 + 30 * i), 1) for i in range(4)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    for bounded in (False, True):
        got = {r["g"]: r["ks_statistic"] for r in drift.ks_two_sample(df, ["g"], ref, ["x"], bounded=bounded).collect()}
        for g, vs in groups.items():
            assert got[g] == pytest.approx(brute_ks(base, vs), abs=1e-12)


def test_ks_needs_two_values(spark, normal):
    row = drift.ks_two_sample(values_frame(spark, x=[0.3]), [], normal, ["x"]).first()
    assert row["ks_statistic"] is None and row["ks_pvalue"] is None


def test_exact_ks_pvalue_by_enumeration():
    n, m = 5, 4
    seen = []
    for picked in combinations(range(n + m), n):
        a = np.array(picked, float)
        b = np.array([i for i in range(n + m) if i not in picked], float)
        seen.append(brute_ks(a, b))
    for d in sorted(set(np.round(seen, 12))):
        expected = np.mean([s >= d - 1e-9 for s in seen])
        assert pvalues.ks_pvalue_value(d, n, m) == pytest.approx(expected, abs=1e-12)


def test_exact_and_asymptotic_ks_meet():
    for d in (0.02, 0.05, 0.08):
        assert pvalues._ks_exact(d, 2000, 1500) == pytest.approx(pvalues._ks_asymptotic(d, 2000, 1500), abs=0.02)


def test_chi_square_tail():
    # dof 2 and 4 have elementary closed forms; dof 1 is a two-sided normal tail.
    for x in (0.1, 1.0, 3.84, 10.0):
        assert pvalues.chi2_sf_value(x, 2) == pytest.approx(math.exp(-x / 2))
        assert pvalues.chi2_sf_value(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert pvalues.chi2_sf_value(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
    assert pvalues.chi2_sf_value(7.815, 3) == pytest.approx(0.05, abs=1e-4)


def brute_chi2(ref, cur):
    table = np.array([ref, cur], float)
    table = table[:, table.sum(axis=0) > 0]
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    gap = abs(table - expected)
    if table.shape[1] == 2:
        gap = gap - np.minimum(0.5, gap)
    return (gap**2 / expected).sum()


@pytest.mark.parametrize(
    "ref,cur",
    [({"a": 50, "b": 70}, {"a": 20, "b": 90}), ({"a": 50, "b": 70}, {"a": 20}), ({"a": 9}, {"a": 3, "b": 4}),
     ({"a": 5, "b": 6, "c": 7}, {"b": 3, "d": 4}), ({"a": 10, "b": 10}, {"a": 5, "b": 5})],
)
def test_chi_square_matches_the_table(spark, ref, cur):
    df = spark.createDataFrame([("g", k, n) for k, n in cur.items()], "g string, category string, n bigint")
    counts = spark.createDataFrame([*ref.items(), ("gone", 0)], "category string, n bigint")
    row = drift.chi_square_mix(df, ["g"], counts).first()
    names = sorted({*ref, *cur})
    expected = brute_chi2([ref.get(c, 0) for c in names], [cur.get(c, 0) for c in names])
    assert row["chi2"] == pytest.approx(expected, abs=1e-9) and row["dof"] == len(names) - 1


def test_one_category_has_no_chi_square(spark):
    df = spark.createDataFrame([("g", "a", 5)], "g string, category string, n bigint")
    ref = spark.createDataFrame([("a", 10)], "category string, n bigint")
    assert drift.chi_square_mix(df, ["g"], ref).first()["chi2"] is None
    assert drift.chi_square_mix(df, ["g"], ref.limit(0)).first()["chi2"] is None


def test_chi_square_of_thousands_of_categories(spark):
    rng = np.random.default_rng(2)
    ref, cur = rng.integers(0, 6, 5000), rng.integers(0, 4, 5000)
    names = [None, *(f"c{i}" for i in range(4999))]
    rows = [(None, c, int(n)) for c, n in zip(names, cur)] + [(None, "c7", 2)]
    cur[8] += 2
    got = drift.chi_square_mix(
        spark.createDataFrame(rows, "g string, category string, n bigint"),
        ["g"],
        spark.createDataFrame([(c, int(n)) for c, n in zip(names, ref)], "category string, n bigint"),
    ).first()
    assert got["chi2"] == pytest.approx(brute_chi2(ref, cur), rel=1e-9) and got["dof"] == (ref + cur > 0).sum() - 1


def test_rollup_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("g", 1)], "g string, z int")
    empty = df.select("g", F.expr("array()").cast("array<struct<feature:string,feature_pos:int,psi:double,severity:string>>").alias("e"))
    row = empty.select(*drift.rollup_columns("e")).first()
    assert row["psi_max"] == 0.0 and row["worst_feature"] is None and row["significant_features"] == []


def test_reference_store_round_trip(spark, normal, tmp_path):
    tables.write_reference(normal, spark, f"{tmp_path}/ref")
    stored = tables.load_reference(spark, f"{tmp_path}/ref")
    assert {k: v["bin_edges"] for k, v in stored.frozen().items()} == {k: v["bin_edges"] for k, v in normal.frozen().items()}
    tables.export_reference_json(stored, f"{tmp_path}/json")
    assert "Infinity" not in spark.read.text(f"{tmp_path}/json").first()[0]
    back = {r["feature"]: r["bin_edges"] for r in tables.import_reference_json(spark, f"{tmp_path}/json").collect()}
    assert back["x"] == stored.frozen()["x"]["bin_edges"]
    with pytest.raises(FileNotFoundError):
        tables.load_reference(spark, f"{tmp_path}/absent")


def test_few_groups_share_one_copy_of_the_reference(spark, monkeypatch):
    from lineguard.plans import fixtures

    sf, key = "/root/testdata/sf0.001", "spark.sql.shuffle.partitions"
    given = spark.conf.get(key)
    reference, log = fixtures.reference(spark, sf), fixtures.preds(spark, sf)

    seen, whole = [], drift._reference_at
    monkeypatch.setattr(drift, "_reference_at", lambda *args: (seen.append(args[-1]), whole(*args))[1])
    found = []
    try:
        spark.conf.set(key, "32")
        for shared in (drift.GROUPS_PER_SALT, 1):
            monkeypatch.setattr(drift, "GROUPS_PER_SALT", shared)
            ks = drift.ks_two_sample(log, ["scenario"], reference, fixtures.PRED_FEATURES)
            found.append(sorted(map(str, ks.collect())))
        assert seen == [1, 4] and found[0] == found[1]
    finally:
        spark.conf.set(key, given)
