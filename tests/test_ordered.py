"""Ordered operators against NumPy, with ranges forced and one hot group."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineguard.operators import ordered, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.gamma(2.0, 10.0, 4000), 2)]
    rows += [("hot", 5.0)] * 2000
    rows += [(f"g{i % 7}", float(v)) for i, v in enumerate(np.round(rng.normal(0, 1, 300), 3))]
    rows += [(None, float(i)) for i in range(20)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


def test_quantiles_match_numpy(skewed):
    rows, df = skewed
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g]
        assert got[g]["n"] == len(values)
        np.testing.assert_allclose(got[g]["q"], np.percentile(values, [100 * p for p in probs]), rtol=1e-12)


def test_quantiles_sort_only_the_ranges_of_wanted_ranks(skewed):
    _, df = skewed
    counts = ordered.value_counts(df, ["g"], "v")
    median = F.expr("_before_n <= (tot_n - 1) div 2 AND (tot_n - 1) div 2 < _before_n + _sum_n")
    every = {(r["g"], r["v"]): r for r in ordered.running_sums(counts, ["g"], ["v"], ["n"], bounded=True).collect()}
    some = ordered.running_sums(counts, ["g"], ["v"], ["n"], parts=16, ranges=median).collect()
    assert all(every[r["g"], r["v"]] == r for r in some)
    assert len(some) < len(every) / 2
    holds = [r for r in some if r["cum_n"] - r["n"] <= (r["tot_n"] - 1) // 2 < r["cum_n"]]
    assert {r["g"] for r in holds} == {k[0] for k in every} and len(holds) == len({k[0] for k in every})


def test_ranged_and_plain_running_sums_agree(skewed):
    _, df = skewed
    counts = ordered.value_counts(df, ["g"], "v")
    plain = ordered.running_sums(counts, ["g"], ["v"], ["n"], bounded=True)
    for parts in (2, 5, 16):
        ranged = ordered.running_sums(counts, ["g"], ["v"], ["n"], parts=parts)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, ranged.collect()))


def test_any_cut_points_give_the_same_sums(skewed):
    _, df = skewed
    counts = ordered.value_counts(df, ["g"], "v")
    plain = ordered.running_sums(counts, ["g"], ["v"], ["n"], bounded=True).collect()
    odd = ordered.running_sums(counts, ["g"], ["v"], ["n"], cuts=[(-100.0,), (5.0,), (5.01,), (1e9,)]).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, odd))


def test_row_index_with_a_hot_first_key(spark):
    rows = [(1 if i % 3 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "ts bigint, id bigint").repartition(5)
    got = {(r["ts"], r["id"]): r["row_index"] for r in ordered.row_index(df, [], ["ts", "id"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows))}


def test_row_index_over_text_keys(spark):
    rows = [("a" if i % 4 else "b", f"/p/{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, path string").repartition(6)
    got = {(r["g"], r["path"]): r["row_index"] for r in ordered.row_index(df, ["g"], ["path"]).collect()}
    for g in "ab":
        paths = sorted(p for k, p in rows if k == g)
        assert [got[g, p] for p in paths] == list(range(len(paths)))


def test_order_number_sorts_like_the_pair(spark):
    pairs = [(1, 9_000_000_000_000_000_000), (2, -9_000_000_000_000_000_000), (2, 5), (3, 0), (-4, 7)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("k", ordered.order_number(["a", "b"]))
    assert [(r["a"], r["b"]) for r in df.orderBy("k").collect()] == sorted(pairs)


@pytest.mark.parametrize("n", [0, 1, 37, 600, 5000])
def test_cap_sample_has_exact_size_and_fixed_rows(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"] for r in sampling.cap_sample(df.repartition(3), n, "k").collect()}
    b = {r["k"] for r in sampling.cap_sample(df.repartition(11), n, "k").collect()}
    assert a == b and len(a) == min(n, 1000)


def test_stratified_sample_sizes(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 999, "mid").otherwise("one").alias("c"))
    got = {r["c"]: r["count"] for r in sampling.stratified_sample(df, 100, "c", "id").groupBy("c").count().collect()}
    assert got == {"big": 90, "mid": 10, "one": 1}


@pytest.mark.parametrize("small", [1, 7, 10_000])
def test_samples_refined_to_any_depth_are_those_of_a_full_sort(spark, small):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k string, i long").repartition(5)
    got = sampling.take_by_hash(df, ["g"], F.lit(25).cast("bigint"), "k", small=small).collect()
    want = set()
    for g in {r[0] for r in rows}:
        keys = sorted((r[1] for r in rows if r[0] == g), key=lambda k: hashlib.md5(f"42{k}".encode()).hexdigest())
        want |= {(g, k) for k in keys[:25]}
    assert len(got) == len(want) and {(r["g"], r["k"]) for r in got} == want


def test_sample_size_is_exact_with_repeated_and_missing_keys(spark):
    rows = [(1,)] * 300 + [(None,)] * 200 + [(k,) for k in range(2, 102)]
    df = spark.createDataFrame(rows, "k long").repartition(6)
    for n in (0, 1, 150, 450, 599, 600, 601):
        assert sampling.take_by_hash(df, [], F.lit(n).cast("bigint"), "k", small=10).count() == min(n, 600)
    assert sampling.cap_sample(df.where("k < 0"), 5, "k").count() == 0
    assert sampling.cap_sample(df.where("k IS NULL"), 5, "k").count() == 5


def test_sample_filters_the_table_without_sorting_it(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    plan = sampling.cap_sample(df, 400, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Range (0, 3000") == 1
