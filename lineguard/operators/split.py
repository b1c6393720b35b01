"""Leakage-safe train/val/test manifests.

Whole duplicate groups go to one fold. Groups are put in a hash order per stratum; the place of a group's middle
on the running share of rows names its fold, so each quota is met within half a group, at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import hash_order
from lineguard.operators.duplicates import SCAN_ORDER, drop_exact_duplicates, group_key
from lineguard.operators.ordered import running_sums
from lineguard.session import stage

MANIFEST_COLUMNS = (
    "relpath", "class_name", "label", "split", "group", "sha256", "dhash", "width", "height", "file_bytes"
)


def fold_targets(val_size: float, test_size: float) -> dict[str, float]:
    if not 0 < val_size + test_size < 1:
        raise ValueError(f"val_size + test_size must lie in (0, 1), got {val_size + test_size}")
    return {"train": 1.0 - val_size - test_size, "val": val_size, "test": test_size}


def majority_label(df: DataFrame, group: str = "group", label: str = "label") -> DataFrame:
    """Size and most frequent label per group, the smallest label winning ties."""
    per_label = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy(group).agg(
        F.sum("n").alias("size"),
        F.max_by(label, F.struct("n", (-F.col(label)).alias("low"))).alias("majority"),
    )


def group_strata(df: DataFrame, group: str = "group", label: str = "label") -> DataFrame:
    """``(stratum, group, size)``: the most frequent known label, the smallest winning ties, and all rows of the group.

    Rows without a label count in the size but not in the vote; only a group without any label has a null stratum.
    """
    per_label = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    vote = F.when(F.col(label).isNotNull(), F.struct("n", (-F.col(label)).alias("low")))
    return per_label.groupBy(group).agg(F.sum("n").alias("size"), F.max_by(label, vote).cast("int").alias("stratum")).select(
        "stratum", group, "size"
    )


def assign_folds(groups: DataFrame, targets: dict[str, float], *, seed: int = params.SEED) -> DataFrame:
    """``(group, split)`` from ``(stratum, group, size)``.

    Deterministic in the seed: the order is a hash of seed and group key.
    """
    drawn = groups.select("stratum", "group", "size", hash_order(seed, F.col("group")).alias("draw"))
    running = running_sums(drawn, ["stratum"], ["draw"], ["size"])
    at = (F.col("cum_size") - F.col("size") / 2.0) / F.col("tot_size")
    *early, last = targets
    bounds = [sum(list(targets.values())[: i + 1]) for i in range(len(early))]
    split: Column = F.lit(last)
    for fold, bound in reversed(list(zip(early, bounds))):
        split = F.when(at < bound, F.lit(fold)).otherwise(split)
    return running.select("group", split.alias("split"))


def join_folds(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Attach the fold to every row of a group.

    The assignment has one row per group; a group holding much of the table is split
    across tasks by the adaptive skew join.
    """
    return rows.join(assignment, "group", "left")


def unassigned_rows(rows: DataFrame) -> DataFrame:
    """Rows without a fold; must be empty."""
    return rows.where(F.col("split").isNull())


def leakage_guard(rows: DataFrame) -> DataFrame:
    """One row: number of groups and of groups that span more than one fold."""
    spans = rows.groupBy("group").agg((F.min("split") != F.max("split")).alias("crosses"))
    return spans.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("crosses").alias("n_crossing"))


class SplitError(RuntimeError):
    """The manifest violates a guarantee."""


def check_manifest(manifest: DataFrame) -> None:
    """Raise when a row has no fold or a group spans folds."""
    missing = unassigned_rows(manifest).count()
    if missing:
        raise SplitError(f"{missing} rows have no fold")
    crossing = leakage_guard(manifest).first()["n_crossing"]
    if crossing:
        raise SplitError(f"{crossing} groups span more than one fold")


def with_groups(scan: DataFrame, *, by_hash: bool = True, order: Sequence[str] = SCAN_ORDER) -> DataFrame:
    """Valid rows without exact copies, keyed by duplicate group."""
    kept = drop_exact_duplicates(scan.where("is_valid"), "sha256", order=order)
    return kept.withColumn("group", group_key(F.col("dhash"), F.col("relpath"), by_hash))


def build_manifest(
    scan: DataFrame,
    *,
    val_size: float = params.SPLIT["val_size"],
    test_size: float = params.SPLIT["test_size"],
    stratify: bool = params.SPLIT["stratify"],
    group_by_hash: bool = params.SPLIT["group_by_hash"],
    seed: int = params.SEED,
) -> DataFrame:
    """The manifest of a validated scan."""
    targets = fold_targets(val_size, test_size)
    kept = [c for c in MANIFEST_COLUMNS if c in scan.columns]
    # Rows and groups feed several passes each, so both are staged.
    rows = stage(with_groups(scan.select(*kept, "is_valid"), by_hash=group_by_hash).drop("is_valid"), "split-rows")
    sized = group_strata(rows)
    groups = stage(sized if stratify else sized.withColumn("stratum", F.lit(0)), "split-groups")
    folds = assign_folds(groups, targets, seed=seed)
    return join_folds(rows, folds).select(*MANIFEST_COLUMNS)


# -- manifest tables -------------------------------------------------------------


def ordered_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("split", "class_name", "relpath")


def split_class_pivot(manifest: DataFrame, classes: Sequence[str] = params.CLASSES) -> DataFrame:
    """Rows per split and class, absent pairs 0."""
    return manifest.groupBy("split").pivot("class_name", list(classes)).count().na.fill(0)


def split_class_share(manifest: DataFrame) -> DataFrame:
    """Class share per split in percent, one decimal, and the share as a fraction."""
    counts = manifest.groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("split"))
    return counts.select("split", "class_name", "n", share.alias("share"), F.bround(share * 100.0, 1).alias("percent"))


def positive_share(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("positive_share")
    )


def dataset_card(
    manifest: DataFrame,
    scan: DataFrame,
    *,
    classes: Sequence[str] = params.CLASSES,
    policy: dict | None = None,
    source: str = "",
) -> DataFrame:
    """One-row card: sizes, class and split counts, groups, dropped copies, policy."""
    counts = [F.count_if(F.col("class_name") == c) for c in classes]
    in_split = [F.count_if(F.col("split") == s) for s in params.SPLITS]
    cells = [
        F.struct(
            F.lit(s).alias("split"),
            *[F.count_if((F.col("split") == s) & (F.col("class_name") == c)).alias(c) for c in classes],
        )
        for s in params.SPLITS
    ]
    totals = manifest.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.create_map(*[x for c, n in zip(classes, counts) for x in (F.lit(c), n)]).alias("class_counts"),
        F.create_map(*[x for s, n in zip(params.SPLITS, in_split) for x in (F.lit(s), n)]).alias("split_counts"),
        F.array(*cells).alias("split_class_matrix"),
    )
    groups = manifest.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_groups"))
    valid = scan.where("is_valid").agg(F.count(F.lit(1)).alias("n_valid"))
    rules = {k: str(v) for k, v in (policy or params.SPLIT).items()}
    # Three one-row aggregates side by side.
    return (
        totals.join(groups)
        .join(valid)
        .select(
            "n_rows",
            "class_counts",
            "split_counts",
            "split_class_matrix",
            "n_groups",
            (F.col("n_valid") - F.col("n_rows")).alias("exact_duplicates_dropped"),
            F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))]).alias("policy"),
            F.lit(source).alias("source"),
        )
    )


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def require_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
