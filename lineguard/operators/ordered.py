"""Ordered operators without a single-task sort.

A running sum over one huge group cannot live in one window partition. Here the
order key is cut into ranges at literal cut points; each (group, range) is summed
on its own and the per-range totals, at most ``parts`` rows per group, supply
the offsets. Cut points only steer balance: any cut points give the same result,
and because they are literals in the plan, a recomputed task sees the same
ranges, so nothing has to be materialised in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAMPLES_PER_CUT = 32
_MAX_PARTS = 256


def default_parts(df: DataFrame) -> int:
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, min(_MAX_PARTS, configured))


def cut_points(
    df: DataFrame, order: Sequence[str], identity: Sequence[str], parts: int
) -> list[tuple]:
    """At most ``parts - 1`` order-key tuples that split the rows evenly.

    One numeric key is read off a quantile sketch, which merges map-side. Other keys come from
    the rows with the smallest identity hashes: a uniform, reproducible sample of fixed
    size. Either way one pass, nothing shuffled but the sketch or sample. A table
    smaller than the sample gets no cuts. Keys must be numbers or strings, and not null.
    """
    size = parts * _SAMPLES_PER_CUT
    numeric = isinstance(df.schema[order[0]].dataType, T.NumericType)
    if len(order) == 1 and numeric:
        levels = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        sketch = F.percentile_approx(order[0], levels, parts * _SAMPLES_PER_CUT)
        n, cuts = df.agg(F.count(F.lit(1)), sketch).first()
        return [(c,) for c in sorted(set(cuts))] if n >= size else []
    hashed = df.select(*order, F.xxhash64(*identity).alias("_hash"))
    sample = hashed.orderBy("_hash", *order).limit(size).collect()
    if len(sample) < size:
        return []
    keys = sorted(tuple(r[c] for c in order) for r in sample)
    picked = [keys[i * size // parts] for i in range(1, parts)]
    return sorted(set(picked))


def _below(order: Sequence[str], cut: tuple) -> Column:
    """Lexicographic ``key < cut``."""
    below: Column | None = None
    for name, bound in reversed(list(zip(order, cut))):
        strictly = F.col(name) < F.lit(bound)
        below = strictly if below is None else strictly | ((F.col(name) == F.lit(bound)) & below)
    assert below is not None
    return below


def range_number(order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """Index of the range holding the key: a binary search written as nested CASE."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_below(order, cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right key copies are dropped.

    Without keys both sides must be one-row aggregates, which are put side by side.
    """
    if not on:
        return left.join(right)
    renamed = right.select(
        *[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns]
    )
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_right_{c}" for c in on])


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    *,
    identity: Sequence[str] | None = None,
    bounded: bool = False,
    parts: int | None = None,
    carry_first: tuple[str, str] | None = None,
    cut_source: DataFrame | None = None,
    cuts: list[tuple] | None = None,
    ranges: Column | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum) and ``tot_<c>`` (group total) per sum column.

    ``order`` must be unique within a group. ``bounded=True`` states that every
    group is small by construction (a fixed-size window, a fixed grid) and uses
    a plain window. ``carry_first=(value, at)`` adds ``first_<value>``, the value at the
    group's smallest ``at``.
    ``cut_source`` is a table with the order columns to read cut points from, say the rows *df*
    was counted from, when that is cheaper than running *df* itself; ``cuts`` passes known ones.
    ``ranges`` is a condition on ``_before_<c>``, ``_sum_<c>`` and ``tot_<c>`` of a range. Rows of other ranges may be
    left out; where cuts exist they are, before anything is sorted. Totals cover all rows.
    """
    by, order, sums = list(by), list(order), list(sums)
    if bounded:
        cuts = []
    elif cuts is None:
        source = df if cut_source is None else cut_source
        cuts = cut_points(source, order, list(identity or [*by, *order]), parts or default_parts(df))
    if not cuts:
        whole = Window.partitionBy(*(by or [F.lit(0)]))
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.sum(c).over(upto).alias(f"cum_{c}") for c in sums],
            *[F.sum(c).over(whole).alias(f"tot_{c}") for c in sums],
            *([F.min_by(*carry_first).over(whole).alias(f"first_{carry_first[0]}")] if carry_first else []),
        )

    ranged = df.withColumn("_range", range_number(order, cuts))
    local = (
        Window.partitionBy(*by, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        *([F.min_by(*carry_first).alias("_first"), F.min(carry_first[1]).alias("_at")] if carry_first else []),
    )
    offsets = totals.select(
        *by,
        "_range",
        *([f"_sum_{c}" for c in sums] if ranges is not None else []),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(group).alias(f"tot_{c}") for c in sums],
        *([F.min_by("_first", "_at").over(group).alias(f"first_{carry_first[0]}")] if carry_first else []),
    )

    def placed(rows: DataFrame) -> DataFrame:
        if by:
            return null_safe_join(rows, offsets, [*by, "_range"])
        return rows.join(F.broadcast(offsets), "_range")  # one row per range, so the rows stay where they are

    sums_here = [F.sum(c).over(local).alias(f"_local_{c}") for c in sums]
    if ranges is None:
        joined = placed(ranged.select("*", *sums_here))
    else:
        offsets = offsets.where(ranges)
        joined = placed(ranged).select("*", *sums_here)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{c}") + F.col(f"_local_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"tot_{c}" for c in sums],
        *([f"first_{carry_first[0]}"] if carry_first else []),
    )


def order_number(keys: Sequence[str]) -> Column:
    """One number that sorts like one or two bigint columns.

    ``min_by`` over a struct or string forces a sort before aggregating; over a number it does
    not. Two keys share a decimal, the first scaled past the range of the second.
    """
    if len(keys) == 1:
        return F.col(keys[0]).cast("bigint")
    major, minor = (f"CAST(CAST(`{k}` AS BIGINT) AS DECIMAL(19,0))" for k in keys)
    return F.expr(f"CAST({major} * 20000000000000000000BD + {minor} AS DECIMAL(38,0))")


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Zero-based position within the group under a unique order, at any group size."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    counted = running_sums(one, by, order, ["_one"])
    return counted.select(*df.columns, (F.col("cum__one") - 1).alias(name))


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value; combined map-side, so a hot value costs one row per task."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    counted: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles as ``(by..., n, q array<double>)``.

    The built-in ``percentile`` holds a group's distinct values in one task's
    memory, so it serves only groups that are ``bounded`` by construction. Otherwise
    ranks come from running sums over the distinct values of the ranges that hold a wanted rank; the other
    ranges are counted but never sorted. ``counted=True`` means
    *df* already is ``value_counts`` output.
    """
    probs = [float(p) for p in probs]
    by = list(by)
    if bounded and not counted:
        levels = F.array(*[F.lit(p) for p in probs])
        return df.groupBy(*by).agg(
            F.count(value).cast("bigint").alias("n"), F.percentile(value, levels).alias("q")
        )
    rows = df if counted else df.where(F.col(value).isNotNull())
    counts = rows if counted else value_counts(rows, by, value)
    at = [f"({p!r}D * (tot_n - 1))" for p in probs]
    ranks = [(i, side, f"{end}({x})") for i, x in enumerate(at) for side, end in (("lo", "floor"), ("hi", "ceil"))]
    wanted = F.expr(" OR ".join(f"_before_n <= {rank} AND {rank} < _before_n + _sum_n" for _, _, rank in ranks))
    ranked = running_sums(
        counts.select(*by, value, "n"), by, [value], ["n"], bounded=bounded, cut_source=rows.select(value), ranges=wanted
    )
    picks = []
    for i, side, rank in ranks:
        hit = f"cum_n - n <= {rank} AND {rank} < cum_n"
        picks.append(F.expr(f"max(CASE WHEN {hit} THEN `{value}` END) AS _{side}_{i}"))
    agg = ranked.groupBy(*by).agg(F.max("tot_n").cast("bigint").alias("n"), *picks)
    quantiles = []
    for i, p in enumerate(probs):
        share = f"({p!r}D * (n - 1) - floor({p!r}D * (n - 1)))"
        quantiles.append(f"CAST(IF({share} = 0, _lo_{i}, _lo_{i} + (_hi_{i} - _lo_{i}) * {share}) AS DOUBLE)")
    return agg.where(F.col("n").isNotNull()).select(*by, "n", F.expr(f"array({', '.join(quantiles)}) AS q"))
