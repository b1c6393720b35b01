"""Per-file rules and corpus-level checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import fixed_text, present, ratio
from lineguard.operators.drift import feature_moments
from lineguard.operators.duplicates import duplicate_totals


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def file_issues(suffix: Column, readable: Column, rules: dict = params.FILE_RULES, scale: float = 255.0) -> Column:
    """Ordered issues of one file as an array; empty means valid.

    Reads ``file_bytes``, ``width``, ``height``, ``mean_intensity`` and ``std_intensity``. A bad format,
    an empty file and an unreadable one end the list there; an oversized file does not.
    Statistics are on [0, 1], their limits on 0 to ``scale``.
    """
    sfx = F.lower(suffix)
    size = F.col("file_bytes")
    w, h = F.col("width"), F.col("height")
    mean, std = F.col("mean_intensity") * scale, F.col("std_intensity") * scale
    wh = _text(w, "x", h)
    too_big = F.when(size > rules["max_file_bytes"], _text("file_too_large:", size))
    content = present(
        too_big,
        F.when((w < rules["min_width"]) | (h < rules["min_height"]), _text("too_small:", wh)),
        F.when((w > rules["max_width"]) | (h > rules["max_height"]), _text("too_large:", wh)),
        F.when(mean < rules["min_mean_intensity"], _text("too_dark:mean=", fixed_text(mean, 1))),
        F.when(mean > rules["max_mean_intensity"], _text("too_bright:mean=", fixed_text(mean, 1))),
        F.when(std < rules["min_std_intensity"], _text("no_variation:std=", fixed_text(std, 1))),
    )
    allowed = sfx.isin([s.lower() for s in rules["allowed_formats"]])
    return (
        F.when(~F.coalesce(allowed, F.lit(False)), F.array(_text("format_not_allowed:", F.coalesce(sfx, F.lit("")))))
        .when(size == 0, F.array(F.lit("empty_file")))
        .when(~readable, present(too_big, F.lit("unreadable:DecodeError")))
        .otherwise(content)
    )


def with_validity(df: DataFrame, issues: Column) -> DataFrame:
    """Adds ``issues`` (array), ``issue_text`` (joined by ``|``) and ``is_valid``."""
    return df.withColumn("issues", issues).withColumns(
        {"issue_text": F.array_join("issues", "|"), "is_valid": F.size("issues") == 0}
    )


def valid_rows(scan: DataFrame) -> DataFrame:
    return scan.where("is_valid")


def quarantine(scan: DataFrame) -> DataFrame:
    """Every rejected file with its reasons."""
    return scan.where("NOT is_valid").select("relpath", F.col("issue_text").alias("issues"))


def quarantine_report(scan: DataFrame, rows: int = params.QUARANTINE_REPORT_ROWS) -> DataFrame:
    """The report's excerpt of the quarantine table, in path order."""
    return quarantine(scan).orderBy("relpath").limit(rows)


# -- corpus checks -------------------------------------------------------------


def corpus_totals(scan: DataFrame, classes: Sequence[str] = params.CLASSES) -> DataFrame:
    """One row: files, rejects and valid rows per configured class (absent = 0)."""
    valid = F.col("is_valid")
    return scan.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~valid).alias("n_bad"),
        *[F.count_if(valid & (F.col("class_name") == c)).alias(f"n_{c}") for c in classes],
    )


def _message(details: Column) -> Column:
    """The details as text, by name: ``limit=0.02, ratio=0.01``."""
    entries = F.array_sort(F.transform(F.map_entries(details), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("none")))))
    return F.array_join(entries, ", ")


def _check(name: str, status: Column, sev: str, details: dict[str, Column]) -> Column:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    shown = F.create_map(*pairs)
    return F.struct(
        F.lit(name).alias("name"), status.alias("status"), F.lit(sev).alias("severity"), _message(shown).alias("message"), shown.alias("details")
    )


def _status(ok: Column, otherwise: str) -> Column:
    return F.when(ok, F.lit("PASS")).otherwise(F.lit(otherwise))


def count_checks(
    scan: DataFrame, rules: dict = params.CORPUS_RULES, classes: Sequence[str] = params.CLASSES
) -> DataFrame:
    """corrupt_file_ratio, min_images_per_class and class_imbalance from one aggregate."""
    t = corpus_totals(scan, classes)
    bad = ratio(F.col("n_bad").cast("double"), F.col("n_total"))
    limit = float(rules["max_corrupt_ratio"])
    counts = [F.col(f"n_{c}") for c in classes]
    need = int(rules["min_images_per_class"])
    least, most = F.least(*counts), F.greatest(*counts)
    imbalance = F.when(least > 0, most / least.cast("double"))
    bound = float(rules["max_class_imbalance_ratio"])
    checks = F.array(
        _check(
            "corrupt_file_ratio",
            _status(bad <= limit, "FAIL"),
            "error",
            {"quarantined": F.col("n_bad"), "total": F.col("n_total"), "ratio": F.round(bad, 5), "limit": F.lit(limit)},
        ),
        _check(
            "min_images_per_class",
            _status(least >= need, "FAIL"),
            "error",
            {**dict(zip(classes, counts)), "minimum": F.lit(need)},
        ),
        _check(
            "class_imbalance",
            _status(F.coalesce(imbalance <= bound, F.lit(False)), "WARN"),
            "warning",
            {"ratio": F.round(imbalance, 4), "limit": F.lit(bound)},
        ),
    )
    return t.select(F.explode(checks).alias("c")).select("c.*")


def duplicate_checks(valid: DataFrame, rules: dict = params.CORPUS_RULES) -> DataFrame:
    """exact_duplicate_ratio (error) and near_duplicate_ratio (warning)."""
    t = duplicate_totals(valid)
    limit = float(rules["max_duplicate_ratio"])
    exact = ratio(F.col("n_exact").cast("double"), F.col("n_rows"))
    near = ratio(F.col("n_near_only").cast("double"), F.col("n_rows"))
    checks = F.array(
        _check(
            "exact_duplicate_ratio",
            _status(exact <= limit, "FAIL"),
            "error",
            {"duplicates": F.col("n_exact"), "ratio": F.round(exact, 5), "limit": F.lit(limit)},
        ),
        _check(
            "near_duplicate_ratio",
            _status(near <= limit, "WARN"),
            "warning",
            {"near_duplicates": F.col("n_near_only"), "ratio": F.round(near, 5), "limit": F.lit(limit)},
        ),
    )
    return t.select(F.explode(checks).alias("c")).select("c.*")


def effect_sizes(valid: DataFrame, features: Sequence[str], min_pooled: float = 1e-9) -> DataFrame:
    """Cohen's d of each feature between label 0 and label 1, population variances.

    One wide aggregate; a feature without spread has a null effect size.
    """
    aggs = []
    for f in features:
        for i in (0, 1):
            v = F.when(F.col("label") == i, F.col(f))
            aggs += [F.avg(v).alias(f"_m{i}_{f}"), F.var_pop(v).alias(f"_v{i}_{f}")]
    wide = valid.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    entry = []
    for f in features:
        pooled = F.sqrt((F.col(f"_v0_{f}") + F.col(f"_v1_{f}")) / 2.0)
        gap = F.abs(F.col(f"_m0_{f}") - F.col(f"_m1_{f}"))
        entry.append(
            F.struct(F.lit(f).alias("feature"), F.when(pooled > min_pooled, gap / pooled).alias("effect_size"))
        )
    return wide.select("n_rows", F.explode(F.array(*entry)).alias("e")).select("n_rows", "e.*")


def leakage_check(
    valid: DataFrame, features: Sequence[str], rules: dict = params.CORPUS_RULES, n_classes: int = 2
) -> DataFrame:
    """global_statistic_leakage: features that separate the classes on their own."""
    bound, need = float(rules["leakage_effect_size"]), int(rules["leakage_min_rows"])
    applies = (F.col("n_rows") > need) & F.lit(n_classes == 2)
    leaks = applies & (F.col("effect_size") > bound)
    entry = F.when(leaks, F.struct("feature", F.round("effect_size", 3).cast("string").alias("d")))
    agg = effect_sizes(valid, features).agg(F.array_sort(F.collect_list(entry)).alias("leaks"))
    return agg.select(
        F.lit("global_statistic_leakage").alias("name"),
        _status(F.size("leaks") == 0, "WARN").alias("status"),
        F.lit("warning").alias("severity"),
        _message(F.map_from_entries("leaks")).alias("message"),
        F.map_from_entries("leaks").alias("details"),
    )


def shape_counts(valid: DataFrame) -> DataFrame:
    return valid.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))


def resolution_check(valid: DataFrame, top: int = 5) -> DataFrame:
    """resolution_consistency: number of distinct shapes and the most frequent ones."""
    shapes = shape_counts(valid)
    n = shapes.agg(F.count(F.lit(1)).alias("n_shapes"))
    best = (
        shapes.orderBy(F.desc("n"), "width", "height")
        .limit(top)
        .agg(F.collect_list(F.struct(_text(F.col("width"), "x", F.col("height")), F.col("n").cast("string"))).alias("t"))
    )
    # Both sides are one-row aggregates.
    return n.join(best).select(
        F.lit("resolution_consistency").alias("name"),
        _status(F.col("n_shapes") <= 1, "WARN").alias("status"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("shapes="), F.col("n_shapes").cast("string")).alias("message"),
        F.map_from_entries("t").alias("details"),
    )


def corpus_checks(
    scan: DataFrame,
    features: Sequence[str] = params.FEATURE_NAMES,
    rules: dict = params.CORPUS_RULES,
    classes: Sequence[str] = params.CLASSES,
) -> DataFrame:
    """All seven checks as rows, with ``blocking`` = failed with error severity."""
    valid = valid_rows(scan)
    checks = count_checks(scan, rules, classes)
    for part in (
        duplicate_checks(valid, rules),
        leakage_check(valid, features, rules, len(classes)),
        resolution_check(valid),
    ):
        checks = checks.unionByName(part)
    return checks.withColumn("blocking", (F.col("status") == "FAIL") & (F.col("severity") == "error"))


def feature_summary(valid: DataFrame, features: Sequence[str] = params.FEATURE_NAMES) -> DataFrame:
    """mean, sample std, min, max per feature over valid rows."""
    return feature_moments(valid, [], features, ddof=1).drop("n")


class CorpusRejected(RuntimeError):
    """A blocking corpus check failed."""


def validation_report(checks: DataFrame, *, fail_on_error: bool = False) -> DataFrame:
    """One row: passed flag, number of checks and the blocking check names.

    With ``fail_on_error`` the one row is read and a blocking failure raises.
    """
    report = checks.agg(
        (F.count_if("blocking") == 0).alias("passed"),
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("status") == "WARN").alias("n_warnings"),
        F.array_sort(F.collect_list(F.when(F.col("blocking"), F.col("name")))).alias("blocking_checks"),
    )
    if fail_on_error:
        row = report.first()
        if not row["passed"]:
            raise CorpusRejected(f"blocking checks failed: {', '.join(row['blocking_checks'])}")
    return report


def validation_document(
    scan: DataFrame,
    features: Sequence[str] = params.FEATURE_NAMES,
    rules: dict = params.CORPUS_RULES,
    classes: Sequence[str] = params.CLASSES,
) -> DataFrame:
    """The nested one-row report. The quarantine list is the report's fixed excerpt."""
    checks = corpus_checks(scan, features, rules, classes)
    totals = corpus_totals(scan, classes)
    listed = checks.agg(
        (F.count_if("blocking") == 0).alias("passed"),
        F.collect_list(F.struct("name", "status", "severity", "message", "details")).alias("checks"),
    )
    stats = feature_summary(valid_rows(scan), features).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std", "min", "max")))).alias("statistics")
    )
    excerpt = quarantine_report(scan).agg(F.collect_list(F.struct("relpath", "issues")).alias("quarantine"))
    class_counts = F.create_map(*[x for c in classes for x in (F.lit(c), F.col(f"n_{c}"))])
    # Four one-row aggregates side by side.
    return (
        totals.join(listed)
        .join(stats)
        .join(excerpt)
        .select(
            "passed",
            F.col("n_total").alias("n_files"),
            (F.col("n_total") - F.col("n_bad")).alias("n_valid"),
            F.col("n_bad").alias("n_quarantined"),
            class_counts.alias("class_counts"),
            "checks",
            "statistics",
            "quarantine",
        )
    )


# -- request gate --------------------------------------------------------------


def request_gate(
    size: Column,
    content_type: Column,
    decodable: Column,
    image_format: Column,
    *,
    max_bytes: int = params.MAX_UPLOAD_BYTES,
    content_types: Sequence[str] = params.CONTENT_TYPES,
    formats: Sequence[str] = params.UPLOAD_FORMATS,
) -> Column:
    """``struct(error_code, reason, status)`` of one upload; a null code means accepted.

    Order: empty, too large, content type, undecodable, format. An absent content type or
    format is not an error.
    """

    def bad(code: str, reason: str, status: int) -> Column:
        return F.struct(
            F.lit(code).alias("error_code"), F.lit(reason).alias("reason"), F.lit(status).alias("status")
        )

    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    known_kind = F.coalesce(content_type, F.lit("")) != ""
    known_format = F.coalesce(image_format, F.lit("")) != ""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, bad("invalid_image", "empty", 400))
        .when(size > max_bytes, bad("payload_too_large", "size", 413))
        .when(known_kind & ~kind.isin(list(content_types)), bad("invalid_image", "content_type", 415))
        .when(~decodable, bad("invalid_image", "undecodable", 400))
        .when(known_format & ~F.upper(image_format).isin(list(formats)), bad("invalid_image", "format", 415))
        .otherwise(
            F.struct(
                F.lit(None).cast("string").alias("error_code"),
                F.lit(None).cast("string").alias("reason"),
                F.lit(200).alias("status"),
            )
        )
    )
