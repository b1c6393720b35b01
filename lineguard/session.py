"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch where the rows are whole texts.
TEXT_ROWS = 512
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lineguard")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table or stream.

    Lives under ``spark.checkpoint.dir``, the storage every executor sees. A session on one machine may leave it
    unset and uses its warehouse folder; a cluster may not, as its executors need not share that folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lineguard-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the session's Arrow batches to *rows* rows; a lower bound that is set already stays.

    A batch of whole texts is held twice, by the Python worker and by the JVM outside its heap.
    """
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """``bound_batches`` for what is computed inside the block; then the session has its own bound again."""
    given = spark.conf.get(_BATCH_ROWS)
    bound_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, given)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once to the shared folder and read it from there.

    For a table that several aggregates of one job start from: each would otherwise repeat
    its shuffles. The copy outlives lost executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
