"""Exact-size samples by hash order: a threshold per group, found by radix selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import hash_order
from lineguard.operators.ordered import null_safe_join
from lineguard.session import stage

#: Hex digits of the hash that a round looks at, and the rows of a slice that are put in order at once.
_DIGITS, _SMALL = 3, 10_000
_HASH_LENGTH = 32


def take_by_hash(
    df: DataFrame, by: Sequence[str], take: Column, key: str, seed: int = params.SEED, small: int = _SMALL
) -> DataFrame:
    """Per group, the ``take`` rows that come first in hash order: a random sample of exact size.

    A round counts the rows of each group by the next digits of their hash, and opens the slice in which the quota
    ends, until every open slice holds at most *small* rows. The hash of the last row taken is then the group's
    threshold, and the sample is a filter: *df* meets a table of one row per group only, and no slice that grows with
    the data is sorted. *take* may use the group's row count ``n_group`` and the table's ``n_total``.

    Groups may be null. Rows without a key come first. *key* should tell rows apart: of rows that share the key at the
    threshold any may be taken, and they are numbered in one task.
    """
    by = list(by)
    text = F.coalesce(hash_order(seed, F.col(key)), F.lit(""))
    rows = df.select(*by, text.alias("_text"))
    group = Window.partitionBy(*(by or [F.lit(0)]))

    def matched(table: DataFrame, groups: DataFrame) -> DataFrame:
        return null_safe_join(table, groups, by) if by else table.join(F.broadcast(groups))

    def opened(slices: DataFrame) -> DataFrame:
        """Of the slices of each group, the one that holds row number ``_left``; at most 4096 counts per group."""
        before = group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        placed = slices.withColumn("_left", F.col("_left") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return stage(placed.where(F.col("_left").between(1, F.col("_n"))).select(*by, "_prefix", "_n", "_left"), "sample-cut")

    def counted(table: DataFrame, *carried: str) -> DataFrame:
        prefix = F.substring("_text", 1, digits).alias("_prefix")
        return table.groupBy(*by, *carried, prefix).agg(F.count(F.lit(1)).alias("_n"))

    digits = _DIGITS
    slices = stage(counted(rows), "sample-slices")
    total = slices.agg(F.sum("_n")).first()[0] or 0
    sized = slices.withColumn("n_group", F.sum("_n").over(group)).withColumn("n_total", F.lit(total).cast("bigint"))
    cut = opened(sized.withColumn("_left", F.least(take, F.col("n_group"))))
    while digits < _HASH_LENGTH and (cut.agg(F.max("_n")).first()[0] or 0) > small:
        digits += _DIGITS
        inside = matched(rows, cut.drop("_n")).where(F.col("_text").startswith(F.col("_prefix")))
        cut = opened(counted(inside.drop("_prefix"), "_left"))

    inside = matched(rows, cut.drop("_n")).where(F.col("_text").startswith(F.col("_prefix")))
    ordered = group.orderBy("_text")
    numbered = inside.select(
        "*",
        F.row_number().over(ordered).alias("_row"),
        F.rank().over(ordered).alias("_first"),
        F.count(F.lit(1)).over(Window.partitionBy(*by, "_text")).alias("_same"),
    )
    last = numbered.where(F.col("_row") == F.col("_left"))
    ties = (F.col("_row") - F.col("_first") + 1).alias("_ties")
    limits = stage(last.select(*by, F.col("_text").alias("_limit"), ties, "_same"), "sample-limits")

    reached = matched(df.withColumn("_text", text), limits)
    if limits.where(F.col("_ties") < F.col("_same")).isEmpty():
        return reached.where(F.col("_text") <= F.col("_limit")).select(*df.columns)
    below = reached.where(F.col("_text") < F.col("_limit"))
    number = F.row_number().over(group.orderBy("_text"))
    tied = reached.where(F.col("_text") == F.col("_limit")).withColumn("_row", number).where(F.col("_row") <= F.col("_ties"))
    return below.select(*df.columns).unionByName(tied.select(*df.columns))


def stratified_sample(df: DataFrame, n: int, stratum: str, key: str, seed: int = params.SEED) -> DataFrame:
    """About *n* rows with the strata in proportion.

    Each stratum gives ``max(1, round(n * share))`` rows (half-even), capped by its size;
    a table of at most *n* rows is returned whole.
    """
    share = F.lit(float(n)) * F.col("n_group") / F.col("n_total").cast("double")
    wanted = F.greatest(F.lit(1), F.bround(share, 0).cast("bigint"))
    take = F.when(F.col("n_total") <= n, F.col("n_group")).otherwise(F.least(wanted, F.col("n_group")))
    return take_by_hash(df, [stratum], take, key, seed)


def cap_sample(df: DataFrame, n: int, key: str, seed: int = params.SEED) -> DataFrame:
    """A simple random sample of at most *n* rows without replacement."""
    return take_by_hash(df, [], F.least(F.lit(n).cast("bigint"), F.col("n_total")), key, seed)
