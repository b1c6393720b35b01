"""What the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard.session import shared_folder, stage

__all__ = ["few", "fresh", "held", "load", "remainder", "sampled_rows", "shared_folder", "small_table", "stage"]

#: Rows of a table that one task may hold.
FEW_ROWS = 1 << 16


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow: pickled rows would need Python workers of their own kind
    on the executors, which stay there and hold memory beside those of the functions.
    """
    return spark.createDataFrame(pa.table(columns))


def few(staged: DataFrame) -> bool:
    """Whether a staged table is so small that one task may hold it."""
    return staged.count() <= FEW_ROWS


def held(df: DataFrame, small: bool) -> DataFrame:
    """*df* in one partition if it is *small*: grouping and joining it then need no shuffle.

    Every shuffle of a small table costs the driver as many tasks as there are shuffle partitions, and memory with them.
    """
    return df.coalesce(1) if small else df


def fresh(df: DataFrame, name: str) -> str:
    """*name*, with underscores put in front until no column of *df* has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo *parts*; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sampled_rows(df: DataFrame, key: Column, per_class: int, *order: Column) -> list:
    """At most *per_class* rows of each class, the smallest by a hash of *order*; rows with equal *order* count once.

    A class is thinned by its number of distinct hashes before anything is ranked, and repeats are merged by the
    executors, so that the driver never sees more than about twice the bound, whatever a class holds.
    """
    k, h, w = fresh(df, "class"), fresh(df, "order"), fresh(df, "share")
    keyed = df.withColumn(k, key).where(F.col(k).isNotNull()).withColumn(h, F.xxhash64(*order))
    counts = keyed.groupBy(k).agg(F.approx_count_distinct(h).alias("n")).collect()
    if not counts:
        return []
    share = {r[k]: min(1.0, (2.0 * per_class + 64) / max(1, r["n"])) for r in counts}
    thin = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    unit = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    few = keyed.withColumn(w, F.element_at(thin, F.col(k))).where(unit < F.col(w)).drop(w)
    rows = few.dropDuplicates([k, h]).withColumn(h, unit).collect()
    kept: dict = {}
    for r in sorted(rows, key=lambda r: r[h]):
        if len(kept.setdefault(r[k], [])) < per_class:
            kept[r[k]].append(r)
    return [r for x in sorted(kept, key=str) for r in kept[x]]
