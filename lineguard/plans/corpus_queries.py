"""Queries over the corpus scan, duplicates, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions import columns as C
from lineguard.operators import duplicates, metrics, quality, sampling, split
from lineguard.plans import fixtures as X
from lineguard.plans.registry import register
from lineguard.plans.views_sql import r

DOCS = list(X.DOC_FEATURES)


def _valid(spark, sf):
    return X.scan_docs(spark, sf).where("is_valid")


@register("src2_normalise_corpus", "normalised", "SELECT path, class_name, dest FROM normalised")
def src2(spark, sf):
    from lineguard.sources.corpus import normalise_corpus

    return normalise_corpus(X.corpus_files(spark, sf))


@register("jn2_class_map", "normalised", "SELECT class_name, count(*) AS n FROM normalised GROUP BY 1")
def jn2(spark, sf):
    from lineguard.sources.corpus import normalise_corpus

    return normalise_corpus(X.corpus_files(spark, sf)).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "src3_provenance",
    "normalised",
    """SELECT 'local' AS source, count(*) FILTER (class_name = 'ok') AS n_ok, count(*) FILTER (class_name = 'defect') AS n_defect,
    0::bigint AS n_scratched, count(*) AS n_total, 'scratched' AS absent_classes FROM normalised""",
)
def src3(spark, sf):
    from lineguard.sources.corpus import normalise_corpus, provenance

    return provenance(normalise_corpus(X.corpus_files(spark, sf)), (*params.CLASSES, "scratched"), source="local")


@register("prj1_label_from_class", "scan_docs", "SELECT relpath, class_name, label::bigint AS label FROM scan_docs")
def prj1(spark, sf):
    scan = X.scan_docs(spark, sf)
    return scan.select("relpath", "class_name", C.label_from_class(F.col("class_name"), params.CLASSES).alias("label"))


@register("prj2_file_issues", "scan_docs", "SELECT relpath, issue_text, is_valid FROM scan_docs")
def prj2(spark, sf):
    return X.scan_docs(spark, sf).select("relpath", "issue_text", "is_valid")


@register(
    "prj3_quarantine", "scan_docs", "SELECT relpath, issue_text AS issues FROM scan_docs WHERE NOT is_valid"
)
def prj3(spark, sf):
    return quality.quarantine(X.scan_docs(spark, sf))


@register(
    "prj3_quarantine_report",
    "scan_docs",
    "SELECT relpath, issue_text AS issues FROM scan_docs WHERE NOT is_valid ORDER BY relpath LIMIT 200",
)
def prj3_report(spark, sf):
    return quality.quarantine_report(X.scan_docs(spark, sf))


@register("src4_scan_csv", "scan_docs", f"SELECT class_name, count(*) AS n, count(*) FILTER (is_valid) AS n_valid, sum(file_bytes)::bigint AS bytes FROM scan_docs GROUP BY 1")
def src4(spark, sf):
    """Write the scan as CSV, read it back with its schema."""
    from lineguard import schemas
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "scan")
    scan = X.scan_docs(spark, sf)
    have = set(scan.columns)
    stored = scan.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SCAN.fields]
    )
    tables.write_scan(stored, path, "csv")
    return tables.read_scan(spark, path, "csv").groupBy("class_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"), F.sum("file_bytes").alias("bytes")
    )


# -- duplicates ---------------------------------------------------------------------


@register("dup1_content_sha256", "scan_docs", "SELECT relpath, sha256 FROM scan_docs")
def dup1(spark, sf):
    return X.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("relpath"),
        duplicates.content_sha256(F.col("text")).alias("sha256"),
    )


@register("dup3_near_key", "scan_docs", "SELECT relpath, dhash FROM scan_docs")
def dup3(spark, sf):
    return X.scan_docs(spark, sf).select("relpath", "dhash")


_FLAGS = """
f AS (SELECT relpath, row_number() OVER (PARTITION BY sha256 ORDER BY label, relpath) > 1 AS exact_dup,
  row_number() OVER (PARTITION BY dhash ORDER BY label, relpath) > 1 AS near_dup FROM valid_docs)"""


@register("dup4_flag_duplicates", "valid_docs", f"WITH {_FLAGS} SELECT relpath, exact_dup FROM f")
def dup4(spark, sf):
    return duplicates.flag_later_copies(_valid(spark, sf), "sha256", "exact_dup").select("relpath", "exact_dup")


@register(
    "dup5_drop_exact_duplicates",
    "valid_docs",
    "SELECT relpath, class_name, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY label, relpath) AS k FROM valid_docs) WHERE k = 1",
)
def dup5(spark, sf):
    return duplicates.drop_exact_duplicates(_valid(spark, sf)).select("relpath", "class_name", "sha256")


@register("dup6_near_but_not_exact", "valid_docs", f"WITH {_FLAGS} SELECT relpath, exact_dup, near_dup, near_dup AND NOT exact_dup AS near_only FROM f")
def dup6(spark, sf):
    return duplicates.flag_near_copies(_valid(spark, sf)).select("relpath", "exact_dup", "near_dup", "near_only")


@register(
    "dup6_duplicate_totals",
    "valid_docs",
    f"""WITH {_FLAGS} SELECT count(*) AS n_rows, count(*) FILTER (exact_dup) AS n_exact, count(*) FILTER (near_dup AND NOT exact_dup) AS n_near_only,
    count(*) FILTER (near_dup) AS n_near FROM f""",
)
def dup6_totals(spark, sf):
    return duplicates.duplicate_totals(_valid(spark, sf))


@register(
    "dup7_group_key",
    "scan_docs",
    "SELECT relpath, CASE WHEN width % 5 = 0 OR dhash = '' THEN 'row:' || relpath ELSE dhash END AS grp FROM scan_docs",
)
def dup7(spark, sf):
    key = F.when(F.col("width") % 5 == 0, F.when(F.col("width") % 2 == 0, "")).otherwise(F.col("dhash"))
    return X.scan_docs(spark, sf).select("relpath", duplicates.group_key(key, F.col("relpath")).alias("grp"))


@register("dup8_dataset_fingerprint")
def dup8(spark, sf):
    return duplicates.dataset_fingerprint(X.scan_docs(spark, sf).select("relpath", "label", "sha256", "dhash"))


# -- checks ----------------------------------------------------------------------------

_COUNTS = """
t AS (SELECT count(*) AS n_total, count(*) FILTER (NOT is_valid) AS n_bad, count(*) FILTER (is_valid AND class_name = 'ok') AS n_ok,
  count(*) FILTER (is_valid AND class_name = 'defect') AS n_defect FROM scan_docs),
df AS (SELECT row_number() OVER (PARTITION BY sha256 ORDER BY label, relpath) > 1 AS e, row_number() OVER (PARTITION BY dhash ORDER BY label, relpath) > 1 AS d FROM valid_docs),
dt AS (SELECT count(*) AS n, count(*) FILTER (e) AS ex, count(*) FILTER (d AND NOT e) AS nr FROM df)"""


def _d(f):
    return (
        f"SELECT '{f}' AS feature, count(*) AS n_rows, abs(avg({f}) FILTER (label = 0) - avg({f}) FILTER (label = 1)) / "
        f"sqrt((var_pop({f}) FILTER (label = 0) + var_pop({f}) FILTER (label = 1)) / 2.0::double) AS d FROM valid_docs"
    )


_EFFECTS = "eff AS (" + " UNION ALL ".join(_d(f) for f in DOCS) + ")"
_CHECKS = f"""
chk AS (
SELECT 'corrupt_file_ratio' AS name, CASE WHEN n_bad / n_total::double <= 0.02 THEN 'PASS' ELSE 'FAIL' END AS status, 'error' AS severity FROM t
UNION ALL SELECT 'min_images_per_class', CASE WHEN least(n_ok, n_defect) >= 100 THEN 'PASS' ELSE 'FAIL' END, 'error' FROM t
UNION ALL SELECT 'class_imbalance', CASE WHEN least(n_ok, n_defect) > 0 AND greatest(n_ok, n_defect) / least(n_ok, n_defect)::double <= 4.0 THEN 'PASS' ELSE 'WARN' END, 'warning' FROM t
UNION ALL SELECT 'exact_duplicate_ratio', CASE WHEN ex / n::double <= 0.03 THEN 'PASS' ELSE 'FAIL' END, 'error' FROM dt
UNION ALL SELECT 'near_duplicate_ratio', CASE WHEN nr / n::double <= 0.03 THEN 'PASS' ELSE 'WARN' END, 'warning' FROM dt
UNION ALL SELECT 'global_statistic_leakage', CASE WHEN count(*) FILTER (d > 2 AND n_rows > 20) = 0 THEN 'PASS' ELSE 'WARN' END, 'warning' FROM eff
UNION ALL SELECT 'resolution_consistency', CASE WHEN count(DISTINCT (width, height)) <= 1 THEN 'PASS' ELSE 'WARN' END, 'warning' FROM valid_docs)"""


def _check_query(spark, sf, name, metric):
    checks = quality.corpus_checks(X.scan_docs(spark, sf), DOCS, X.DOC_CHECKS)
    return checks.where(F.col("name") == name).select(
        "name", "status", "severity", "blocking", F.try_element_at("details", F.lit(metric)).cast("double").alias("metric")
    )


def _check_sql(name, value):
    return f"""WITH {_COUNTS}, {_EFFECTS}, {_CHECKS} SELECT name, status, severity, status = 'FAIL' AND severity = 'error' AS blocking,
    {r(value)} AS metric FROM chk CROSS JOIN t CROSS JOIN dt WHERE name = '{name}'"""


for _key, _name, _metric, _value in (
    ("agg1_corrupt_file_ratio", "corrupt_file_ratio", "ratio", "round(n_bad / n_total::double, 5)"),
    ("agg2_min_images_per_class", "min_images_per_class", "defect", "n_defect::double"),
    ("agg3_class_imbalance", "class_imbalance", "ratio", "round(greatest(n_ok, n_defect) / least(n_ok, n_defect)::double, 4)"),
    ("agg4_exact_duplicate_ratio", "exact_duplicate_ratio", "ratio", "round(ex / n::double, 5)"),
    ("agg5_near_duplicate_ratio", "near_duplicate_ratio", "ratio", "round(nr / n::double, 5)"),
):

    def _query(spark, sf, _name=_name, _metric=_metric):
        return _check_query(spark, sf, _name, _metric)

    register(_key, "scan_docs valid_docs", _check_sql(_name, _value))(_query)


@register("agg6_effect_sizes", "valid_docs", f"WITH {_EFFECTS} SELECT feature, n_rows, {r('d')} AS effect_size FROM eff")
def agg6(spark, sf):
    return quality.effect_sizes(_valid(spark, sf), DOCS)


@register(
    "agg7_resolution_consistency",
    "valid_docs",
    """SELECT width, height, n, (SELECT count(DISTINCT (width, height)) FROM valid_docs) AS n_shapes FROM (
      SELECT width, height, count(*) AS n FROM valid_docs GROUP BY 1, 2 ORDER BY n DESC, width, height LIMIT 5)""",
)
def agg7(spark, sf):
    check = quality.resolution_check(_valid(spark, sf))
    wh = F.split(F.col("e.key"), "x")
    return check.select("message", F.explode(F.map_entries("details")).alias("e")).select(
        wh[0].cast("bigint").alias("width"),
        wh[1].cast("bigint").alias("height"),
        F.col("e.value").cast("bigint").alias("n"),
        F.regexp_extract("message", r"(\d+)$", 1).cast("bigint").alias("n_shapes"),
    )


@register("agg8_validation_checks", "scan_docs valid_docs", f"WITH {_COUNTS}, {_EFFECTS}, {_CHECKS} SELECT name, status, severity, status = 'FAIL' AND severity = 'error' AS blocking FROM chk")
def agg8(spark, sf):
    return quality.corpus_checks(X.scan_docs(spark, sf), DOCS, X.DOC_CHECKS).select("name", "status", "severity", "blocking")


@register(
    "agg8_validation_report",
    "scan_docs valid_docs",
    f"""WITH {_COUNTS}, {_EFFECTS}, {_CHECKS} SELECT count(*) FILTER (status = 'FAIL' AND severity = 'error') = 0 AS passed, count(*) AS n_checks,
    count(*) FILTER (status = 'WARN') AS n_warnings, coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'FAIL' AND severity = 'error'), '') AS blocking_checks FROM chk""",
)
def agg8_report(spark, sf):
    return quality.validation_report(quality.corpus_checks(X.scan_docs(spark, sf), DOCS, X.DOC_CHECKS))


@register(
    "agg9_feature_summary",
    "valid_docs",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r(f'avg({f})')} AS mean, {r(f'stddev_samp({f})')} AS std, {r(f'min({f})')} AS min, {r(f'max({f})')} AS max FROM valid_docs"
        for f in DOCS
    ),
)
def agg9(spark, sf):
    return quality.feature_summary(_valid(spark, sf), DOCS)


@register("src10_validation_document")
def src10_validation(spark, sf):
    doc = quality.validation_document(X.scan_docs(spark, sf), DOCS, X.DOC_CHECKS)
    return doc.select("passed", "n_files", "n_valid", "n_quarantined", F.to_json("checks").alias("checks"), F.to_json("statistics").alias("statistics"))


@register(
    "agg27_class_weights",
    "valid_docs",
    f"""WITH c AS (SELECT l.label, greatest(count(v.label), 1) AS m, count(v.label) AS n FROM (SELECT unnest([0, 1, 2]) AS label) l LEFT JOIN valid_docs v ON v.label = l.label GROUP BY 1),
    w AS (SELECT label, n, (SELECT sum(m) FROM c)::double / (3.0::double * m) AS raw FROM c)
    SELECT label::bigint AS label, n, {r('raw / (SELECT avg(raw) FROM w)')} AS weight FROM w""",
)
def agg27(spark, sf):
    return metrics.class_weights(_valid(spark, sf), "label", 3)


@register("agg27_pos_weight", "valid_docs", f"SELECT {r('count(*) FILTER (label = 0) / (count(*) FILTER (label = 1))::double')} AS pos_weight FROM valid_docs")
def agg27_pos(spark, sf):
    return metrics.positive_weight(_valid(spark, sf), "label")


# -- manifest -----------------------------------------------------------------------


@register("src5_manifest_partition", "manifest", "SELECT relpath, class_name, label::bigint AS label, split, width, height FROM manifest WHERE split = 'test'")
def src5(spark, sf):
    """Write the manifest, read one split back through partition pruning."""
    from lineguard import schemas
    from lineguard.session import shared_folder
    from lineguard.sources import tables

    path = shared_folder(spark, "manifest")
    rows = X.manifest(spark, sf)
    tables.write_manifest(rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.MANIFEST.fields]), path)
    return tables.load_manifest(spark, path, "test").select("relpath", "class_name", "label", "split", "width", "height")


@register(
    "jn1_manifest_with_stats",
    "manifest doc_features",
    f"""SELECT m.relpath, {r('f.words')} AS words, {r('f.digit_share')} AS digit_share FROM manifest m LEFT JOIN
    (SELECT * FROM doc_features WHERE doc_id % 4 <> 0) f USING (relpath)""",
)
def jn1(spark, sf):
    """Left join on the unique path; only the needed columns travel."""
    scan = X.scan_docs(spark, sf)
    stats = scan.where("cast(substring(relpath, 5) AS bigint) % 4 <> 0").select("relpath", "words", "digit_share")
    return X.manifest(spark, sf, scan).select("relpath").join(stats, "relpath", "left")


@register("jn1_missing_stats", "manifest", "SELECT relpath FROM manifest WHERE doc_id % 4 = 0")
def jn1_missing(spark, sf):
    """The rows whose statistics have to be computed again."""
    scan = X.scan_docs(spark, sf)
    stats = scan.where("cast(substring(relpath, 5) AS bigint) % 4 <> 0").select("relpath")
    return X.manifest(spark, sf, scan).select("relpath").join(stats, "relpath", "left_anti")


@register("jn3_group_folds", "manifest", "SELECT relpath, split FROM manifest")
def jn3(spark, sf):
    rows = X.manifest(spark, sf)
    folds = rows.groupBy("group").agg(F.first("split").alias("split"))
    return split.join_folds(rows.drop("split"), folds).select("relpath", "split")


@register(
    "agg28_split_class_pivot",
    "manifest",
    "SELECT split, count(*) FILTER (class_name = 'ok') AS ok, count(*) FILTER (class_name = 'defect') AS defect FROM manifest GROUP BY 1",
)
def agg28(spark, sf):
    return split.split_class_pivot(X.manifest(spark, sf))


@register(
    "agg29_split_class_share",
    "manifest",
    f"""SELECT split, class_name, n, {r('n / sum(n) OVER (PARTITION BY split)')} AS share, {r('round_even(100.0::double * n / sum(n) OVER (PARTITION BY split), 1)')} AS percent
    FROM (SELECT split, class_name, count(*) AS n FROM manifest GROUP BY 1, 2)""",
)
def agg29(spark, sf):
    return split.split_class_share(X.manifest(spark, sf))


@register("agg29_positive_share", "manifest", f"SELECT split, count(*) AS n, {r('avg(label::double)')} AS positive_share FROM manifest GROUP BY 1")
def agg29_pos(spark, sf):
    return split.positive_share(X.manifest(spark, sf))


@register(
    "agg30_leakage_guard",
    "manifest",
    "SELECT count(*) AS n_groups, count(*) FILTER (k > 1) AS n_crossing FROM (SELECT grp, count(DISTINCT split) AS k FROM manifest GROUP BY 1)",
)
def agg30(spark, sf):
    return split.leakage_guard(X.manifest(spark, sf))


@register(
    "agg37_majority_label",
    "manifest",
    """SELECT grp AS "group", sum(n)::bigint AS size, first(label ORDER BY n DESC, label)::bigint AS majority FROM (SELECT grp, label, count(*) AS n FROM manifest GROUP BY 1, 2) GROUP BY 1""",
)
def agg37(spark, sf):
    return split.majority_label(X.manifest(spark, sf))


@register(
    "agg38_dataset_card",
    "manifest valid_docs",
    """SELECT count(*) AS n_rows, count(*) FILTER (class_name = 'ok') AS n_ok, count(*) FILTER (split = 'train') AS n_train,
    count(*) FILTER (split = 'test' AND class_name = 'defect') AS n_test_defect, count(DISTINCT grp) AS n_groups,
    (SELECT count(*) FROM valid_docs) - count(*) AS exact_duplicates_dropped FROM manifest""",
)
def agg38(spark, sf):
    scan = X.scan_docs(spark, sf)
    card = split.dataset_card(X.manifest(spark, sf, scan), scan)
    return card.select(
        "n_rows",
        F.col("class_counts")["ok"].alias("n_ok"),
        F.col("split_counts")["train"].alias("n_train"),
        F.filter("split_class_matrix", lambda x: x["split"] == "test")[0]["defect"].alias("n_test_defect"),
        "n_groups",
        "exact_duplicates_dropped",
    )


@register("win8_ordering", "manifest", "SELECT split, class_name, relpath FROM manifest ORDER BY split, class_name, relpath")
def win8(spark, sf):
    return split.ordered_manifest(X.manifest(spark, sf)).select("split", "class_name", "relpath")


@register(
    "set1_union_strata",
    "manifest",
    "SELECT relpath, class_name FROM manifest WHERE class_name = 'ok' AND split = 'val' UNION ALL SELECT relpath, class_name FROM manifest WHERE class_name = 'defect' AND split = 'test'",
)
def set1(spark, sf):
    m = X.manifest(spark, sf)
    ok = m.where("class_name = 'ok' AND split = 'val'").select("relpath", "class_name")
    return ok.unionByName(m.where("class_name = 'defect' AND split = 'test'").select("class_name", "relpath"))


@register(
    "smp1_stratified_sample",
    "manifest",
    """SELECT relpath, class_name FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('42' || relpath), relpath) AS k,
      count(*) OVER (PARTITION BY class_name) AS nc, count(*) OVER () AS nt FROM manifest)
    WHERE k <= CASE WHEN nt <= 50 THEN nc ELSE least(greatest(1, round_even(50.0::double * nc / nt, 0)::bigint), nc) END""",
)
def smp1(spark, sf):
    return sampling.stratified_sample(X.manifest(spark, sf), 50, "class_name", "relpath").select("relpath", "class_name")


@register(
    "smp2_cap_sample",
    "base_preds",
    "SELECT id, scenario FROM base_preds ORDER BY md5('42' || id), id LIMIT 4000",
)
def smp2(spark, sf):
    return sampling.cap_sample(X.preds(spark, sf), 4000, "id").select("id", "scenario")


#: Folds by the running share of rows in hash order, per majority class.
_FOLDS = f"""
WITH per AS (SELECT grp, label, count(*) AS n FROM manifest GROUP BY 1, 2),
sized AS (SELECT grp, sum(n)::bigint AS size, arg_max(label, 2 * n - label) AS stratum FROM per GROUP BY 1),
run AS (SELECT *, (sum(size) OVER (PARTITION BY stratum ORDER BY md5('42' || grp)) - size / 2.0::double) / sum(size) OVER (PARTITION BY stratum) AS at_share FROM sized),
folds AS (SELECT *, CASE WHEN at_share < {1.0 - 0.15 - 0.2!r}::double THEN 'train' WHEN at_share < {1.0 - 0.15 - 0.2 + 0.15!r}::double THEN 'val' ELSE 'test' END AS fold FROM run)
"""


@register(
    "spl1_greedy_group_split",
    "manifest",
    f"SELECT * FROM ({_FOLDS} SELECT stratum::bigint AS stratum, fold AS split, sum(size)::bigint AS n_rows, count(*) AS n_groups FROM folds GROUP BY 1, 2)",
)
def spl1(spark, sf):
    """Fold sizes against quotas, per stratum."""
    groups = split.group_strata(split.with_groups(X.scan_docs(spark, sf)))
    folds = split.assign_folds(groups, split.fold_targets(0.15, 0.20))
    return groups.join(folds, "group").groupBy("stratum", "split").agg(F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


@register(
    "spl2_build_manifest",
    "manifest",
    f"SELECT * FROM ({_FOLDS} SELECT m.relpath, m.class_name, m.label::bigint AS label, f.fold AS split, m.grp AS \"group\" FROM manifest m JOIN folds f USING (grp))",
)
def spl2(spark, sf):
    return split.build_manifest(X.scan_docs(spark, sf)).select("relpath", "class_name", "label", "split", "group")


@register(
    "spl2_manifest_guarantees",
    "manifest",
    "SELECT count(*) AS n_rows, count(DISTINCT grp) AS n_groups, 0::bigint AS n_crossing, 0::bigint AS n_unassigned FROM manifest",
)
def spl2_guarantees(spark, sf):
    """What holds for any seed: every row once, no group across folds, none left out."""
    m = split.build_manifest(X.scan_docs(spark, sf))
    per_group = m.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split").isNull()).alias("open"),
        (F.min("split") != F.max("split")).alias("crosses"),
    )
    return per_group.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if("crosses").alias("n_crossing"),
        F.sum("open").alias("n_unassigned"),
    )
