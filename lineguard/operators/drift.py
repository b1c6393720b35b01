"""Frozen reference profiles and the drift statistics measured against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import finite_only
from lineguard.functions.pvalues import chi2_pvalue, ks_pvalue
from lineguard.operators.ordered import (
    cut_points,
    default_parts,
    exact_quantiles,
    null_safe_join,
    range_number,
    running_sums,
    value_counts,
)
from lineguard.session import stage

INF = float("inf")
#: Groups that share a copy of the reference in the KS distance.
GROUPS_PER_SALT = 100_000


# -- reference ---------------------------------------------------------------


def unpivot_features(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form ``(by..., feature, value)``, finite values only."""
    entry = [
        F.struct(F.lit(f).alias("feature"), finite_only(F.col(f).cast("double")).alias("value"))
        for f in features
    ]
    long = df.select(*by, F.explode(F.array(*entry)).alias("_e")).select(*by, "_e.feature", "_e.value")
    return long.where(F.col("value").isNotNull())


def edges_from_quantiles(q: Column) -> Column:
    """Unique quantiles with infinite ends; fewer than two collapse to one bin."""
    unique = F.array_sort(F.array_distinct(q))
    inner = F.slice(unique, 2, F.greatest(F.size(unique) - 2, F.lit(0)))
    ends = F.array(F.lit(-INF)), F.array(F.lit(INF))
    return F.when(F.size(unique) < 2, F.concat(*ends)).otherwise(F.concat(ends[0], inner, ends[1]))


def quantile_levels(n_bins: int) -> list[float]:
    return [i * 100.0 / n_bins / 100.0 for i in range(n_bins + 1)]


def quantile_bin_edges(
    long: DataFrame, n_bins: int = params.PSI_BINS, *, counted: bool = False
) -> DataFrame:
    """``(feature, bin_edges)`` from equal-frequency quantiles of the reference."""
    q = exact_quantiles(long, ["feature"], "value", quantile_levels(n_bins), counted=counted)
    return q.select("feature", edges_from_quantiles(F.col("q")).alias("bin_edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Bin index under array edges: ``[a, b)``, so a value on an edge goes up."""
    inner = F.slice(edges, 2, F.size(edges) - 2)
    return F.size(F.filter(inner, lambda e: e <= value))


def bin_sql(value: str, edges: Sequence[float]) -> str:
    """The same rule with literal edges, as a CASE that stays in generated code."""
    inner = list(edges[1:-1])
    if not inner:
        return "0"
    steps = " ".join(f"WHEN `{value}` < {float(e)!r}D THEN {i}" for i, e in enumerate(inner))
    return f"CASE {steps} ELSE {len(inner)} END"


def summarise(df: DataFrame, by: Sequence[str], features: Sequence[str], *, ddof: int = 0) -> DataFrame:
    """mean, std, min, p25, p50, p75, max per feature over finite values.

    Every feature yields a row; one without finite values has null statistics.
    """
    moments = feature_moments(df, by, features, ddof=ddof)
    q = exact_quantiles(unpivot_features(df, by, features), [*by, "feature"], "value", [0.25, 0.5, 0.75])
    q = q.select(*by, "feature", "q")
    return null_safe_join(moments, q, [*by, "feature"], "left").select(
        *by,
        "feature",
        "n",
        "mean",
        "std",
        "min",
        F.get("q", 0).alias("p25"),
        F.get("q", 1).alias("p50"),
        F.get("q", 2).alias("p75"),
        "max",
    )


def feature_moments(
    df: DataFrame, by: Sequence[str], features: Sequence[str], *, ddof: int = 0
) -> DataFrame:
    """n, mean, std, min, max per feature from one wide aggregate, no row blow-up."""
    std = F.stddev_samp if ddof else F.stddev_pop
    aggs = []
    for f in features:
        v = finite_only(F.col(f).cast("double"))
        aggs += [
            F.struct(
                F.lit(f).alias("feature"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                std(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"_{f}")
        ]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[f"_{f}" for f in features])).alias("_m")).select(
        *by, "_m.*"
    )


@dataclass
class Reference:
    """A frozen baseline.

    ``stats`` has one row per feature; ``values`` is the counted empirical distribution;
    ``classes`` the reference class mix; ``baseline`` the promoted model's own metrics.
    """

    stats: DataFrame
    values: DataFrame
    classes: DataFrame
    features: tuple[str, ...]
    baseline: dict[str, float] = field(default_factory=dict)
    _frozen: dict | None = None
    _mix: dict[str, int] | None = None

    def frozen(self) -> dict[str, dict]:
        """Edges and shares per feature as plain literals: one row per schema feature."""
        if self._frozen is None:
            rows = self.stats.select("feature", "n", "mean", "bin_edges", "bin_shares").collect()
            self._frozen = {r["feature"]: r.asDict() for r in rows}
        return self._frozen

    def class_mix(self) -> dict[str, int]:
        """Reference count per configured class."""
        if self._mix is None:
            self._mix = {str(r["category"]): int(r["n"]) for r in self.classes.collect()}
        return self._mix


def reference_stats(
    df: DataFrame, features: Sequence[str], n_bins: int = params.PSI_BINS
) -> tuple[DataFrame, DataFrame]:
    """``(stats, values)`` of a reference population.

    All quantiles and edges come from one ranked pass over the counted values, which are
    part of the reference and staged for the passes that follow.
    """
    values = stage(value_counts(unpivot_features(df, [], features), ["feature"], "value"), "reference-values")
    tail = list(params.REFERENCE_PERCENTILES)
    levels = quantile_levels(n_bins)
    q = exact_quantiles(values, ["feature"], "value", [*tail, *levels], counted=True).select(
        "feature",
        *[F.get("q", i).alias(f"p{round(p * 100):02d}") for i, p in enumerate(tail)],
        edges_from_quantiles(F.slice("q", len(tail) + 1, len(levels))).alias("bin_edges"),
    )
    # One row per schema feature, so broadcasting the edges is bounded.
    binned = values.join(F.broadcast(q.select("feature", "bin_edges")), "feature").select(
        "feature", bin_of(F.col("value"), F.col("bin_edges")).alias("bin"), "n"
    )
    counts = (
        binned.groupBy("feature", "bin")
        .agg(F.sum("n").alias("n"))
        .groupBy("feature")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_bins"))
    )
    moments = feature_moments(df, [], features)
    joined = moments.join(q, "feature").join(counts, "feature")
    slots = F.sequence(F.lit(0), F.size("bin_edges") - 2)
    share = F.transform(
        slots, lambda i: F.coalesce(F.try_element_at("_bins", i), F.lit(0)) / F.col("n").cast("double")
    )
    stats = joined.select(
        "feature",
        "n",
        "mean",
        "std",
        "min",
        "max",
        *[f"p{round(p * 100):02d}" for p in tail],
        "bin_edges",
        share.alias("bin_shares"),
    )
    return stats, values


def build_reference(
    df: DataFrame,
    features: Sequence[str],
    *,
    class_col: str,
    n_bins: int = params.PSI_BINS,
    baseline: dict[str, float] | None = None,
) -> Reference:
    """Freeze statistics, edges, class mix and model baseline of a training split."""
    if df.limit(1).isEmpty():
        raise ValueError("the reference split is empty")
    stats, values = reference_stats(df, features, n_bins)
    classes = df.groupBy(F.col(class_col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return Reference(stats, values, classes, tuple(features), dict(baseline or {}))


# -- bins and PSI ------------------------------------------------------------


def wide_bin_counts(
    df: DataFrame,
    by: Sequence[str | Column],
    reference: Reference,
    features: Sequence[str],
    *extra: Column,
) -> DataFrame:
    """One row per group with an ``entries`` array: per feature its bin counts, n and mean.

    One wide aggregate with conditional counts: rows are neither multiplied by the
    number of features nor shuffled before they are combined. Zero bins are kept,
    features without a finite value in the group are left out. ``extra`` aggregates
    ride along; their inputs must be columns of *df*.
    """
    frozen = reference.frozen()
    used = [f for f in features if f in frozen and f in df.columns]
    n_bins = {f: len(frozen[f]["bin_edges"]) - 1 for f in used}
    as_double = {f: f"CAST(`{f}` AS DOUBLE)" for f in used}
    # NaN sorts above infinity, so one comparison keeps exactly the finite values.
    finite_values = [f"IF(abs({v}) < double('Infinity'), {v}, NULL) AS `_v_{f}`" for f, v in as_double.items()]
    bins = [
        f"CASE WHEN `_v_{f}` IS NOT NULL THEN {bin_sql(f'_v_{f}', frozen[f]['bin_edges'])} END AS `_b_{f}`" for f in used
    ]
    binned = df.selectExpr("*", *finite_values).selectExpr("*", *bins)
    aggs: list[Column] = list(extra)
    for f in used:
        aggs += [F.expr(f"count_if(`_b_{f}` = {i}) AS `_c_{f}_{i}`") for i in range(n_bins[f])]
        aggs += [F.expr(f"count(`_v_{f}`) AS `_n_{f}`"), F.expr(f"avg(`_v_{f}`) AS `_m_{f}`")]
    wide = binned.groupBy(*by).agg(*aggs)

    def entry(pos: int, f: str) -> str:
        counts = ", ".join(f"`_c_{f}_{i}`" for i in range(n_bins[f]))
        shares = ", ".join(f"{float(x)!r}D" for x in frozen[f]["bin_shares"])
        return (
            f"named_struct('feature', '{f}', 'feature_pos', {pos}, 'counts', array({counts}), "
            f"'ref_shares', array({shares}), 'n_current', `_n_{f}`, 'current_mean', `_m_{f}`, "
            f"'n_reference', {int(frozen[f]['n'])}L, 'reference_mean', {float(frozen[f]['mean'])!r}D)"
        )

    internal = {f"_{k}_{f}" for f in used for k in ("n", "m")}
    internal |= {f"_c_{f}_{i}" for f in used for i in range(n_bins[f])}
    kept = [c for c in wide.columns if c not in internal]
    entries = ", ".join(entry(pos, f) for pos, f in enumerate(used))
    return wide.select(*kept, F.expr(f"filter(array({entries}), e -> e.n_current > 0) AS entries"))


def with_psi(entries: str, warn: float, alert: float) -> Column:
    """Entries with ``psi``, ``mean_shift`` and ``severity`` in place of the bins.

    PSI is the sum of (c - r) ln(c / r), both shares floored and not renormalised.
    """
    floor = f"{params.PSI_FLOOR!r}D"
    cur = f"transform(e.counts, n -> greatest(n / CAST(e.n_current AS DOUBLE), {floor}))"
    ref = f"transform(e.ref_shares, r -> greatest(r, {floor}))"
    terms = f"zip_with({cur}, {ref}, (c, r) -> (c - r) * ln(c / r))"
    scored = f"""transform({entries}, e -> named_struct('e', e, 'psi', aggregate({terms}, 0.0D, (a, x) -> a + x)))"""
    band = (
        f"CASE WHEN NOT coalesce(abs(s.psi) < double('Infinity'), false) THEN 'unknown' "
        f"WHEN s.psi >= {float(alert)!r}D THEN 'significant' WHEN s.psi >= {float(warn)!r}D THEN 'moderate' ELSE 'none' END"
    )
    return F.expr(
        f"""transform({scored}, s -> named_struct(
          'feature', s.e.feature, 'feature_pos', s.e.feature_pos, 'psi', s.psi,
          'reference_mean', s.e.reference_mean, 'current_mean', s.e.current_mean,
          'mean_shift', s.e.current_mean - s.e.reference_mean, 'severity', {band},
          'n_reference', s.e.n_reference, 'n_current', s.e.n_current))"""
    )


def bin_counts(df: DataFrame, by: Sequence[str], reference: Reference, features: Sequence[str]) -> DataFrame:
    """Long form of ``wide_bin_counts``: one row per (group, feature)."""
    wide = wide_bin_counts(df, by, reference, features)
    return wide.select(*by, F.explode("entries").alias("_e")).select(*by, "_e.*")


def bin_shares(df: DataFrame, by: Sequence[str], reference: Reference, features: Sequence[str]) -> DataFrame:
    """One row per (group, feature, bin) with reference and current shares."""
    counts = bin_counts(df, by, reference, features)
    return counts.select(
        *by, "feature", "n_current", "ref_shares", F.posexplode("counts").alias("bin", "n")
    ).select(
        *by,
        "feature",
        "bin",
        "n",
        (F.col("n") / F.col("n_current").cast("double")).alias("share"),
        F.get("ref_shares", F.col("bin")).alias("ref_share"),
    )


def psi(
    df: DataFrame,
    by: Sequence[str],
    reference: Reference,
    features: Sequence[str],
    *,
    warn: float = params.MONITORING["psi_warn"],
    alert: float = params.MONITORING["psi_alert"],
) -> DataFrame:
    """PSI, means and severity per (group, feature)."""
    wide = wide_bin_counts(df, by, reference, features)
    scored = F.explode(with_psi("entries", warn, alert)).alias("_e")
    return wide.select(*by, scored).select(*by, "_e.*")


# -- two-sample KS -----------------------------------------------------------


def _salts(df: DataFrame, by: Sequence[str], parts: int) -> int:
    """Copies of the reference: a value comes once per group, so only many groups need more than one."""
    if not by:
        return 1
    groups = df.agg(F.approx_count_distinct(F.xxhash64(*by))).first()[0]
    return min(max(1, parts // 8), 1 + groups // GROUPS_PER_SALT)


def _reference_at(
    current: DataFrame, by: Sequence[str], there: DataFrame, cuts: Sequence[tuple], salts: int
) -> DataFrame:
    """*current* with ``n_ref``, ``cum_n_ref`` and ``tot_n_ref``: reference rows at its value, up to it, and of its feature.

    *there* holds ``(feature, value, n_ref)``. Values of a feature without a reference are left out.
    """
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)) if by else F.lit(0).cast("bigint")
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    ours = current.select(*current.columns, F.lit(0).cast("bigint").alias("n_ref"), F.lit(True).alias("_own"), salt.alias("_salt"))
    theirs = there.select("feature", "value", "n_ref", F.lit(False).alias("_own"), F.explode(copies).alias("_salt"))
    at = range_number(["value"], cuts)
    stream = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_range", at)
    # The second window is clustered by more columns than the first, so one shuffle serves both.
    upto = Window.partitionBy("_salt", "feature", "_range").orderBy("value")
    same = Window.partitionBy("_salt", "feature", "_range", "value")
    passed = stream.select(
        *current.columns,
        "_own",
        "_range",
        F.sum("n_ref").over(upto.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.sum("n_ref").over(same).alias("n_ref"),
    )
    sums = there.withColumn("_range", at).groupBy("feature", "_range").agg(F.sum("n_ref").alias("_n"))
    ranges = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("_range")
    grid = sums.groupBy("feature").agg(F.sum("_n").alias("tot_n_ref")).select("feature", "tot_n_ref", ranges)
    before = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grid.join(sums, ["feature", "_range"], "left").select(
        "feature", "_range", "tot_n_ref", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # One row per schema feature and range, so broadcasting the offsets is bounded.
    return (
        passed.where("_own")
        .join(F.broadcast(offsets), ["feature", "_range"])
        .select(*current.columns, "n_ref", (F.col("_before") + F.col("_upto")).alias("cum_n_ref"), "tot_n_ref")
    )


def ks_two_sample(
    df: DataFrame,
    by: Sequence[str],
    reference: Reference,
    features: Sequence[str],
    *,
    bounded: bool = False,
) -> DataFrame:
    """Two-sample KS distance of every group against the one reference.

    The distance is attained at, or just below, a value of the current sample, so
    the reference CDF is read at those values only: both samples go through the value ranges as one tagged stream,
    in which a running sum of the reference counts passes every current value. No value is joined to. Groups are
    dealt over salts, each with its own copy of the counted reference, so that a value which very many groups show is
    not one task. ``bounded`` states that each group of *df* is small by construction.
    """
    by = list(by)
    rows = unpivot_features(df, by, features)
    current = value_counts(rows, [*by, "feature"], "value")
    there = reference.values.select("feature", "value", F.col("n").alias("n_ref"))
    cuts = cut_points(rows.select("value").union(there.select("value")), ["value"], ["value"], default_parts(df))
    both = _reference_at(current, by, there, cuts, _salts(df, by, default_parts(df)))
    both = running_sums(both, [*by, "feature"], ["value"], ["n"], bounded=bounded, cuts=cuts)
    total = F.col("tot_n_ref").cast("double")
    cur_at, cur_below = (
        F.col("cum_n") / F.col("tot_n").cast("double"),
        (F.col("cum_n") - F.col("n")) / F.col("tot_n").cast("double"),
    )
    ref_at, ref_below = F.col("cum_n_ref") / total, (F.col("cum_n_ref") - F.col("n_ref")) / total
    gap = F.greatest(cur_at - ref_at, ref_below - cur_below)
    agg = (
        both.where(F.col("tot_n_ref") > 0)
        .groupBy(*by, "feature")
        .agg(
            F.max(gap).alias("_d"),
            F.max("tot_n").cast("bigint").alias("n_current"),
            F.max("tot_n_ref").cast("bigint").alias("n_reference"),
        )
    )
    enough = (F.col("n_current") >= 2) & (F.col("n_reference") >= 2)
    stat = agg.select(
        *by, "feature", "n_current", "n_reference", F.when(enough, F.greatest(F.col("_d"), F.lit(0.0))).alias("ks_statistic")
    )
    return stat.withColumn(
        "ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("n_current"), F.col("n_reference"))
    )


# -- chi-square --------------------------------------------------------------


def align_categories(current: DataFrame, reference_counts: DataFrame) -> DataFrame:
    """Union of the categories of two ``(category, n)`` tables, a missing side counting 0.

    Categories that are empty on both sides are dropped.
    """
    ref = reference_counts.select("category", F.col("n").alias("n_ref"))
    cur = current.select("category", F.col("n").alias("n_cur"))
    return (
        ref.join(cur, "category", "full")
        .select(
            "category",
            F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
            F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
        )
        .where(F.col("n_ref") + F.col("n_cur") > 0)
    )


def chi_square_columns(
    n_cur: Column, matched_ref: Column, ref_part: Column, cur_part: Column,
    k_matched: Column, k_current: Column, one: Column, ref_total: Column, ref_kinds: Column,
) -> tuple[Column, Column]:
    """Chi-square statistic and dof of a group from sums over its own categories.

    A reference category the group never shows adds exactly its reference count to the
    reference part, so the group's rows suffice and the tables are never crossed.
    ``one`` is the (n_ref, n_cur) pair of any one category: with two categories it fixes
    the whole table, which then gets the continuity correction. *ref_total* and *ref_kinds* are the rows and the
    non-empty categories of the reference.
    """
    ref = ref_total.cast("double")
    cur = n_cur.cast("double")
    n = ref + cur
    full_ref_part = ref_part + (ref - matched_ref)
    plain = n * (full_ref_part / ref + cur_part / cur - 1.0)
    k = k_current + ref_kinds - k_matched
    col = (one["n_ref"] + one["n_cur"]).cast("double")
    det = F.abs(one["n_ref"] * cur - ref * one["n_cur"])
    shrunk = F.greatest(det - n / 2.0, F.lit(0.0))
    yates = n * shrunk * shrunk / (ref * cur * col * (n - col))
    usable = (k >= 2) & (ref > 0) & (cur > 0)
    return F.when(usable, F.when(k == 2, yates).otherwise(plain)), F.when(usable, (k - 1).cast("int"))


def chi_square_mix(current: DataFrame, by: Sequence[str], reference_counts: DataFrame) -> DataFrame:
    """Chi-square of each group's ``(by..., category, n)`` mix against the reference's ``(category, n)``.

    A join of two category tables of any size: each row of *current* looks up its own category, and the reference's total and
    number of categories, one row, stand for those a group never shows. A category may come in several rows of either table;
    null is a category. Without a reference, or with one category in all, there is no statistic.
    """
    by, text = list(by), F.col("category").cast("string").alias("category")
    known = reference_counts.where("n > 0").select(text, "n").groupBy("category").agg(F.sum("n").alias("n_ref"))
    size = known.agg(F.coalesce(F.sum("n_ref"), F.lit(0)).alias("_ref"), F.count(F.lit(1)).alias("_kr"))
    own = current.where("n > 0").select(*by, text, "n").groupBy(*by, "category").agg(F.sum("n").alias("n_cur"))
    rows = null_safe_join(own, known, ["category"], "left").withColumn("n_ref", F.coalesce("n_ref", F.lit(0).cast("bigint")))
    total = (F.col("n_cur") + F.col("n_ref")).cast("double")
    agg = rows.groupBy(*by).agg(
        F.sum("n_cur").alias("n_current"),
        F.sum("n_ref").alias("_matched"),
        F.sum(F.col("n_ref").cast("double") * F.col("n_ref") / total).alias("_rp"),
        F.sum(F.col("n_cur").cast("double") * F.col("n_cur") / total).alias("_cp"),
        F.count_if(F.col("n_ref") > 0).alias("_km"),
        F.count(F.lit(1)).alias("_kc"),
        F.first(F.struct("n_ref", "n_cur")).alias("_one"),
    )
    stat, dof = chi_square_columns(
        F.col("n_current"), F.col("_matched"), F.col("_rp"), F.col("_cp"),
        F.col("_km"), F.col("_kc"), F.col("_one"), F.col("_ref"), F.col("_kr"),
    )
    # The reference size is a one-row aggregate.
    out = agg.join(size).select(*by, "n_current", stat.alias("chi2"), dof.alias("dof"))
    return out.withColumn("pvalue", chi2_pvalue(F.col("chi2"), F.col("dof")))


# -- composites --------------------------------------------------------------


def feature_drift(
    df: DataFrame,
    by: Sequence[str],
    reference: Reference,
    features: Sequence[str] | None = None,
    *,
    warn: float = params.MONITORING["psi_warn"],
    alert: float = params.MONITORING["psi_alert"],
    with_ks: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """PSI, KS, means and severity for every (group, feature) in one job."""
    by = list(by)
    features = list(features or reference.features)
    base = psi(df, by, reference, features, warn=warn, alert=alert)
    if with_ks:
        ks = ks_two_sample(df, by, reference, features, bounded=bounded)
        ks = ks.select(*by, "feature", "ks_statistic", "ks_pvalue")
        return null_safe_join(base, ks, [*by, "feature"], "left")
    null = F.lit(None).cast("double")
    return base.withColumns({"ks_statistic": null, "ks_pvalue": null})


def rollup_columns(entries: str) -> list[Column]:
    """Maxima, counts and lists over an array column of per-feature drift entries."""
    scored = f"filter({entries}, e -> coalesce(abs(e.psi) < double('Infinity'), false))"
    values = f"transform({scored}, e -> e.psi)"
    moved = f"filter({entries}, e -> e.severity IN ('moderate', 'significant'))"
    sig = f"filter({entries}, e -> e.severity = 'significant')"
    # Rounded, so that values differing only in summation order tie and feature order decides.
    ranked = f"transform({scored}, e -> named_struct('psi', round(e.psi, 9), 'pos', -e.feature_pos, 'feature', e.feature))"
    return [
        F.expr(text)
        for text in (
            f"coalesce(array_max({values}), 0.0D) AS psi_max",
            f"coalesce(aggregate({values}, 0.0D, (a, x) -> a + x) / nullif(size({values}), 0), 0.0D) AS psi_mean",
            f"size({entries}) AS n_features",
            f"size({moved}) AS n_drifted",
            f"size({sig}) AS n_significant",
            f"array_sort(transform({moved}, e -> e.feature)) AS drifted_features",
            f"array_sort(transform({sig}, e -> e.feature)) AS significant_features",
            f"array_max({ranked}).feature AS worst_feature",
        )
    ]


def drift_rollup(drift: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group-level rollup of per-feature drift rows (one entry per schema feature)."""
    entry = F.struct("feature", "feature_pos", "psi", "severity")
    packed = drift.groupBy(*by).agg(F.collect_list(entry).alias("_entries"))
    return packed.select(*by, *rollup_columns("_entries"))


def psi_matrix(drift: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per group, one PSI column per feature."""
    return drift.groupBy(*by).pivot("feature", list(features)).agg(F.first("psi"))


def reference_to_json(reference: Reference) -> DataFrame:
    """One JSON line per feature; infinite edges become +-1e308 (JSON has no infinity)."""
    edges = F.transform(
        "bin_edges",
        lambda e: F.when(e == INF, F.lit(1e308)).when(e == -INF, F.lit(-1e308)).otherwise(e),
    )
    return reference.stats.withColumn("bin_edges", edges).select(F.to_json(F.struct("*")).alias("value"))


def stats_from_json(lines: DataFrame, schema) -> DataFrame:
    """Parse ``reference_to_json`` output, restoring edges beyond +-1e307 to infinity."""
    parsed = lines.select(F.from_json("value", schema).alias("s")).select("s.*")
    edges = F.transform(
        "bin_edges",
        lambda e: F.when(e >= 1e307, F.lit(INF)).when(e <= -1e307, F.lit(-INF)).otherwise(e),
    )
    return parsed.withColumn("bin_edges", edges)
