"""Content keys and duplicate handling, safe for a key that holds much of the table.

"First in scan order" is a minimum, so it is an aggregate with map-side combine; no
window ever sorts all copies of one key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN_ORDER = ("label", "relpath")


def content_sha256(content: Column) -> Column:
    """Hash of the bytes."""
    return F.sha2(content, 256)


def _scan_place(order: Sequence[str]) -> Column:
    """Sorts like the columns of *order*, nulls last: a copy with a class goes before one without."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])


def flag_later_copies(
    df: DataFrame, key: str, name: str, *, order: Sequence[str] = SCAN_ORDER, row_id: str = "relpath"
) -> DataFrame:
    """Boolean column: true for every row after the first of its key.

    The first rows are found per key, then matched on the unique ``row_id``, so the
    join key is never hot.
    """
    firsts = df.groupBy(key).agg(F.min_by(row_id, _scan_place(order)).alias(row_id)).select(
        row_id, F.lit(False).alias(name)
    )
    return df.join(firsts, row_id, "left").withColumn(name, F.coalesce(name, F.lit(True)))


def drop_exact_duplicates(
    df: DataFrame, key: str = "sha256", *, order: Sequence[str] = SCAN_ORDER
) -> DataFrame:
    """Keep the first row of each key in scan order."""
    kept = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), _scan_place(order)).alias("_row"))
    return kept.select("_row.*")


def flag_near_copies(
    df: DataFrame,
    exact_key: str = "sha256",
    near_key: str = "dhash",
    *,
    order: Sequence[str] = SCAN_ORDER,
    row_id: str = "relpath",
) -> DataFrame:
    """``exact_dup``, ``near_dup`` and ``near_only`` (near and not exact)."""
    both = flag_later_copies(df, exact_key, "exact_dup", order=order, row_id=row_id)
    both = flag_later_copies(both, near_key, "near_dup", order=order, row_id=row_id)
    return both.withColumn("near_only", F.col("near_dup") & ~F.col("exact_dup"))


def duplicate_totals(df: DataFrame, exact_key: str = "sha256", near_key: str = "dhash") -> DataFrame:
    """One row: rows, exact duplicates, near-only duplicates and the key-count difference.

    Counts only, so copies collapse map-side: first to (near, exact) pairs, then to near
    keys. Both keys derive from the same content, hence one near key per exact key.
    """
    pairs = df.groupBy(near_key, exact_key).agg(F.count(F.lit(1)).alias("rows"))
    nears = pairs.groupBy(near_key).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("contents"))
    zero = F.lit(0)
    return nears.agg(
        F.coalesce(F.sum("rows"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("contents")), zero).alias("n_exact"),
        F.coalesce(F.sum(F.col("contents") - 1), zero).alias("n_near_only"),
        F.coalesce(F.sum(F.col("rows") - 1), zero).alias("n_near"),
    )


def group_key(key: Column, row_id: Column, by_hash: bool = True) -> Column:
    """The near-duplicate key, or a per-row key where it is absent or grouping is off."""
    own = F.concat(F.lit("row:"), row_id.cast("string"))
    return F.coalesce(F.nullif(key, F.lit("")), own) if by_hash else own


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent version of a table: row count plus XOR and sum of row hashes.

    Columns are taken in name order, so neither row nor column order matters. Doubled
    rows cancel in an XOR but not in the sum.
    """
    names = sorted(columns or df.columns)
    digest = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)

    def word(i: int) -> Column:
        return F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint")

    return df.select(word(0).alias("a"), word(1).alias("b"), word(2).alias("c")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor("a"), F.lit(0)).alias("xor_hi"),
        F.coalesce(F.bit_xor("b"), F.lit(0)).alias("xor_lo"),
        F.coalesce(F.sum(F.col("c").cast("decimal(38,0)")) % F.lit(1 << 60), F.lit(0)).cast("bigint").alias("total"),
    ).withColumn(
        "fingerprint", F.sha2(F.concat_ws(":", "n_rows", "xor_hi", "xor_lo", "total"), 256)
    )


def config_hash(config: dict) -> str:
    """Hash of a configuration that ignores key order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
