"""Image corpora: listing, decoding, profiling and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import label_from_class
from lineguard.operators.features import image_profile
from lineguard.operators.ordered import row_index
from lineguard.operators.quality import file_issues, with_validity
from lineguard.schemas import SCAN


def _plain_path(c: Column) -> Column:
    """The two file sources spell the local scheme differently."""
    return F.regexp_replace(c, "^file:/+", "/")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def zero_length_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the empty files below a folder, which Spark's file sources leave out.

    A walk of the file metadata; only empty files are kept. For a very large store pass
    an inventory table to ``scan_images`` instead.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    empty = []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0:
            empty.append((status.getPath().toString(),))
    return spark.createDataFrame(empty, "path string")


def scan_images(
    spark: SparkSession,
    path: str,
    *,
    classes: Sequence[str] = params.CLASSES,
    rules: dict = params.FILE_RULES,
    empty_files: DataFrame | None = None,
) -> DataFrame:
    """The scan table of a corpus with one folder per class.

    File bytes are hashed and images profiled where they are read; only the results
    are joined, on the unique path. ``empty_files`` is a table of zero-length paths
    (from ``zero_length_files`` or an inventory), so that they are quarantined too.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            _plain_path(F.col("path")).alias("path"),
            F.col("length").alias("file_bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
    )
    if empty_files is not None:
        blank = empty_files.select(
            _plain_path(F.col("path")).alias("path"), F.lit(0).cast("bigint").alias("file_bytes"), F.lit("").alias("sha256")
        )
        files = files.unionByName(blank)
    decoded = (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("dropInvalid", False)
        .load(path)
        .select(_plain_path(F.col("image.origin")).alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    )
    profile = image_profile(decoded, ["path", "height", "width", "nChannels"])
    parts = F.split("path", "/")
    class_name = F.element_at(parts, -2)
    mode = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB").when(F.col("nChannels") == 4, "RGBA")
    readable = F.coalesce(F.col("height") > 0, F.lit(False))
    rows = files.join(profile, "path", "left").where(class_name.isin(list(classes)))
    suffix = suffix_of(F.col("path"))
    judged = with_validity(
        rows.select(
            "path",
            F.concat(class_name, F.lit("/"), F.element_at(parts, -1)).alias("relpath"),
            class_name.alias("class_name"),
            label_from_class(class_name, classes).alias("label"),
            "file_bytes",
            F.when(readable, F.col("width")).otherwise(0).alias("width"),
            F.when(readable, F.col("height")).otherwise(0).alias("height"),
            F.when(readable, F.when(suffix == "jpg", "jpeg").otherwise(suffix)).otherwise("").alias("format"),
            F.when(readable, mode).otherwise("").alias("mode"),
            F.when(readable, F.col("sha256")).otherwise("").alias("sha256"),
            F.coalesce("dhash", F.lit("")).alias("dhash"),
            *params.FEATURE_NAMES,
            readable.alias("_readable"),
        ),
        file_issues(suffix, F.col("_readable"), rules),
    )
    return judged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCAN.fields])


def normalise_corpus(
    files: DataFrame,
    class_map: dict[str, str] = params.CLASS_MAP,
    suffixes: Sequence[str] = params.IMAGE_SUFFIXES,
) -> DataFrame:
    """``(path, class_name, dest)`` of image files whose folder maps to a class.

    The target name is ``<origin folder>_<file name>``; the k-th further file of the same name
    becomes ``stem__k``. Numbering is per target name, in path order.
    """
    parts = F.split("path", "/")
    folder, origin, name = F.lower(F.element_at(parts, -2)), F.lower(F.element_at(parts, -3)), F.element_at(parts, -1)
    mapping = F.create_map(*[x for k, v in class_map.items() for x in (F.lit(k), F.lit(v))])
    mapped = files.select(
        "path",
        F.try_element_at(mapping, folder).alias("class_name"),
        F.concat(origin, F.lit("_"), name).alias("_name"),
        suffix_of(F.col("path")).alias("_suffix"),
    ).where(F.col("class_name").isNotNull() & F.col("_suffix").isin(list(suffixes)))
    numbered = row_index(mapped, ["class_name", "_name"], ["path"], "_k")
    stem, ext = F.regexp_extract("_name", r"^(.*)(\.[^.]+)$", 1), F.regexp_extract("_name", r"^(.*)(\.[^.]+)$", 2)
    dest = F.when(F.col("_k") == 0, F.col("_name")).otherwise(
        F.concat(stem, F.lit("__"), F.col("_k").cast("string"), ext)
    )
    return numbered.select("path", "class_name", dest.alias("dest"))


def provenance(
    files: DataFrame, classes: Sequence[str] = params.CLASSES, **source: str
) -> DataFrame:
    """One row: files per class, total, absent classes and source metadata."""
    counts = files.agg(
        *[F.count_if(F.col("class_name") == c).alias(f"n_{c}") for c in classes], F.count(F.lit(1)).alias("n_total")
    )
    meta = [F.lit(v).alias(k) for k, v in source.items()]
    absent = F.array_compact(F.array(*[F.when(F.col(f"n_{c}") == 0, F.lit(c)) for c in classes]))
    return counts.select(*meta, *[f"n_{c}" for c in classes], "n_total", absent.alias("absent_classes"))


class CorpusEmpty(ValueError):
    """A class has no files."""


def require_classes(record: DataFrame) -> DataFrame:
    """Raise when the corpus, or one of its classes, is empty."""
    row = record.first()
    if row["n_total"] == 0 or row["absent_classes"]:
        raise CorpusEmpty(f"no files for: {', '.join(row['absent_classes']) or 'any class'}")
    return record
