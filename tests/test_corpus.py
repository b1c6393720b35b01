"""Image corpus, gates, duplicates, splits and image features."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions import pixels, text_keys
from lineguard.operators import duplicates, features, model, quality, split
from lineguard.sources import corpus as source
from lineguard.sources import tables

RULES = {**params.CORPUS_RULES, "min_images_per_class": 10, "max_corrupt_ratio": 0.1}


@pytest.fixture(scope="module")
def scan(spark, corpus):
    return source.scan_images(spark, corpus, empty_files=source.zero_length_files(spark, corpus)).cache()


def test_scan_flags_each_bad_file(scan):
    issues = {r["relpath"]: r["issue_text"] for r in scan.where("NOT is_valid").collect()}
    assert issues["defect/broken.png"] == "unreadable:DecodeError"
    assert issues["defect/empty.png"] == "empty_file"
    assert issues["defect/notes.txt"] == "format_not_allowed:txt"
    assert issues["ok/tiny.png"] == "too_small:8x8|no_variation:std=0.0"
    assert issues["ok/black.png"] == "too_dark:mean=0.0|no_variation:std=0.0"
    assert len(issues) == 5 and scan.count() == 86


def test_checks_pass_and_fail(scan):
    ok = {r["name"]: r["status"] for r in quality.corpus_checks(scan, rules=RULES).collect()}
    # The two classes differ in brightness, which the leakage check must report.
    assert len(ok) == 7 and [n for n, s in ok.items() if s != "PASS"] == ["global_statistic_leakage"]
    strict = {**RULES, "max_corrupt_ratio": 0.01}
    with pytest.raises(quality.CorpusRejected, match="corrupt_file_ratio"):
        quality.validation_report(quality.corpus_checks(scan, rules=strict), fail_on_error=True)
    document = quality.validation_document(scan, rules=RULES).first()
    assert document["passed"] and document["n_quarantined"] == 5 and len(document["quarantine"]) == 5


def test_scan_store_round_trip(spark, scan, tmp_path):
    for fmt in ("csv", "parquet"):
        tables.write_scan(scan, f"{tmp_path}/{fmt}", fmt)
        assert tables.read_scan(spark, f"{tmp_path}/{fmt}", fmt).where("is_valid").count() == 81


def test_statistics_agree_with_the_definition():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (20, 17)).astype(np.uint8)
    g = pixels.decode_row(20, 17, 1, img.tobytes())
    mean, std, p05, p95, edges, lap, entropy = pixels.statistics(g)
    np.testing.assert_allclose((mean, std), (g.mean(), g.std()))
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    kl = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
    spots = [(y, x) for y in range(18) for x in range(15)]
    gx, gy, l = (np.array([(g[y : y + 3, x : x + 3] * k).sum() for y, x in spots]) for k in (kx, kx.T, kl))
    assert edges == pytest.approx(np.mean(np.hypot(gx, gy) / 4 > 0.12)) and lap == pytest.approx(l.var())
    hist, _ = np.histogram(g, bins=64, range=(0, 1))
    share = hist[hist > 0] / hist.sum()
    assert entropy == pytest.approx(-(share * np.log2(share)).sum())


def test_statistics_react_to_the_image():
    rng = np.random.default_rng(3)
    g = np.clip(rng.normal(0.4, 0.2, (64, 64)), 0, 1)
    blurred = pixels.area_resize(pixels.area_resize(g, 16, 16), 64, 64)
    bright, soft, base = (pixels.statistics(a) for a in (np.clip(g + 0.3, 0, 1), blurred, pixels.statistics and g))
    assert bright[0] > base[0] and soft[5] < base[5] and soft[4] < base[4]
    flat = pixels.statistics(np.full((10, 10), 0.5))
    assert flat[1] == flat[4] == flat[5] == flat[6] == 0.0


def test_colour_rows_become_gray():
    bgr = np.random.default_rng(1).integers(0, 256, (6, 7, 3)).astype(np.uint8)
    gray = pixels.decode_row(6, 7, 3, bgr.tobytes())
    np.testing.assert_allclose(gray * 255, 0.114 * bgr[:, :, 0] + 0.587 * bgr[:, :, 1] + 0.299 * bgr[:, :, 2], atol=0.5)


def test_hog_dimension_and_range():
    g = np.random.default_rng(4).random((128, 128))
    v = pixels.hog(g)
    assert len(v) == pixels.hog_dim(128, 128) == 1764 and v.min() >= 0 and v.max() <= 1
    np.testing.assert_array_equal(v, pixels.hog(g))
    with pytest.raises(ValueError):
        pixels.hog(g[:16, :16])


def test_descriptors_leave_a_task_in_slices(spark):
    class Captured:
        schema = spark.range(1).withColumnRenamed("id", "image_id").schema

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    rng = np.random.default_rng(3)
    data = [rng.integers(0, 256, 64, dtype=np.uint8).tobytes() for _ in range(700)]
    batch = pd.DataFrame({"image_id": range(700), "height": 8, "width": 8, "nChannels": 1, "data": data})
    out = list(features.hog_features(Captured(), ["image_id"], cell=2)(iter([batch])))
    assert max(map(len, out)) <= 256
    whole = pd.concat(out)
    assert whole["image_id"].tolist() == list(range(700))
    for d, hog in zip(data, whole["hog"]):
        assert np.array_equal(hog, pixels.hog(pixels.decode_row(8, 8, 1, d), 2))


def test_difference_hash_survives_small_noise():
    rng = np.random.default_rng(6)
    a = pixels.area_resize(rng.random((8, 9)), 64, 64)
    b = np.clip(a + rng.normal(0, 0.001, a.shape), 0, 1)
    bits = [np.unpackbits(np.frombuffer(bytes.fromhex(pixels.difference_hash(x)), np.uint8)) for x in (a, b, rng.random((64, 64)))]
    assert (bits[0] != bits[1]).sum() <= 3 < (bits[0] != bits[2]).sum()


def test_preprocess_normalises(spark):
    df = spark.createDataFrame([(1, 4, 4, 1, bytes([128] * 16))], "k int, height int, width int, nChannels int, data binary")
    out = features.preprocess(df, ["k"], resize=8).first()["tensor"]
    assert len(out) == 64 and out[0] == pytest.approx((128 / 255 - 0.485) / 0.229, abs=1e-6)


# -- duplicates -------------------------------------------------------------------


@pytest.fixture(scope="module")
def copies(spark):
    """One content holds a third of all rows; near keys group contents in pairs."""
    rows = []
    for i in range(900):
        content = 0 if i % 3 == 0 else i
        rows.append((f"p{i:04d}", "ok" if i % 2 else "defect", 0 if i % 2 else 1, f"s{content}", f"d{content // 4}", True, 10, 10, 5))
    return spark.createDataFrame(
        rows, "relpath string, class_name string, label int, sha256 string, dhash string, is_valid boolean, width int, height int, file_bytes bigint"
    ).repartition(7)


def test_duplicate_flags_match_pandas(copies):
    pdf = copies.toPandas().sort_values(["label", "relpath"])
    exact, near = pdf["sha256"].duplicated(), pdf["dhash"].duplicated()
    want = {r: (bool(e), bool(n and not e)) for r, e, n in zip(pdf["relpath"], exact, near)}
    got = {r["relpath"]: (r["exact_dup"], r["near_only"]) for r in duplicates.flag_near_copies(copies).collect()}
    assert got == want
    totals = duplicates.duplicate_totals(copies).first()
    assert totals["n_exact"] == exact.sum() and totals["n_near_only"] == (near & ~exact).sum()
    kept = {r["relpath"] for r in duplicates.drop_exact_duplicates(copies).collect()}
    assert kept == set(pdf["relpath"][~exact])


def test_fingerprint_ignores_order_but_not_content(copies):
    key = lambda df: duplicates.dataset_fingerprint(df).first()["fingerprint"]
    base = key(copies)
    assert base == key(copies.repartition(3).select(*reversed(copies.columns)))
    assert base != key(copies.limit(899)) and base != key(copies.union(copies)) and base != key(copies.withColumn("label", F.lit(7)))
    assert duplicates.config_hash({"a": 1, "b": 2}) == duplicates.config_hash({"b": 2, "a": 1})


# -- split --------------------------------------------------------------------------


def brute_split(groups, targets, seed):
    order = sorted(groups, key=lambda g: hashlib.md5(f"{seed}{g[0]}".encode()).hexdigest())
    total, seen, out = sum(s for _, s in groups), 0, {}
    for g, size in order:
        at, upto = (seen + size / 2) / total, 0.0
        for f, share in targets.items():
            upto += share
            if at < upto:
                break
        out[g] = f
        seen += size
    return out


def test_folds_follow_the_running_share(spark):
    rng = np.random.default_rng(8)
    groups = [(f"g{i}", int(s)) for i, s in enumerate(rng.geometric(0.4, 300))]
    df = spark.createDataFrame([(0, g, s) for g, s in groups], "stratum int, group string, size bigint")
    targets = split.fold_targets(0.15, 0.2)
    got = {r["group"]: r["split"] for r in split.assign_folds(df, targets).collect()}
    assert got == brute_split(groups, targets, 42)


def test_rows_without_a_label_do_not_vote(spark):
    rows = [("a", None), ("a", None), ("a", 1), ("b", None), ("c", 1), ("c", 0), ("c", None), ("d", 0), ("d", 1), ("d", 1)]
    strata = split.group_strata(spark.createDataFrame(rows, "group string, label int"))
    assert {r["group"]: (r["stratum"], r["size"]) for r in strata.collect()} == {"a": (1, 3), "b": (None, 1), "c": (0, 3), "d": (1, 3)}


def test_quotas_are_met_within_the_largest_group(spark):
    groups = [("hot", 3000)] + [(f"g{i}", 1 + i % 3) for i in range(3000)]
    df = spark.createDataFrame([(i % 2 if g != "hot" else 0, g, s) for i, (g, s) in enumerate(groups)], "stratum int, group string, size bigint")
    targets = split.fold_targets(0.15, 0.2)
    folds = split.assign_folds(df, targets)
    rows = df.join(folds, "group").groupBy("stratum", "split").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    for stratum, largest in ((0, 3000), (1, 3)):
        sizes = {r["split"]: r["n"] for r in rows if r["stratum"] == stratum}
        total = sum(sizes.values())
        for f, share in targets.items():
            assert abs(sizes.get(f, 0) - share * total) <= largest
    assert folds.count() == len(groups) == folds.select("group").distinct().count()


def test_manifest_guarantees(spark, copies, tmp_path):
    m = split.build_manifest(copies).cache()
    split.check_manifest(m)
    assert m.count() == copies.select("sha256").distinct().count()
    again = split.build_manifest(copies.repartition(2))
    assert sorted(m.select("relpath", "split").collect()) == sorted(again.select("relpath", "split").collect())
    assert m.select("split").distinct().count() == 3
    tables.write_manifest(m, f"{tmp_path}/m")
    assert tables.load_manifest(spark, f"{tmp_path}/m", "val").count() == m.where("split = 'val'").count()
    with pytest.raises(ValueError):
        tables.load_manifest(spark, f"{tmp_path}/m", "holdout")
    with pytest.raises(ValueError):
        split.build_manifest(copies, val_size=0.6, test_size=0.5)
    broken = m.withColumn("split", F.when(F.hash("relpath") % 2 == 0, "train").otherwise("test"))
    with pytest.raises(split.SplitError):
        split.check_manifest(broken.withColumn("group", F.lit("one")))


def test_manifest_stratum_ignores_rows_without_a_label(spark):
    rows = [(f"r{i}", None if i % 3 else "ok", None if i % 3 else i // 3 % 2, f"s{i}", f"g{i // 3}", 8, 8, 1, True) for i in range(900)]
    names = "relpath string, class_name string, label int, sha256 string, dhash string, width int, height int, file_bytes int, is_valid boolean"
    got = {r["group"]: r["split"] for r in split.build_manifest(spark.createDataFrame(rows, names)).collect()}
    for label in (0, 1):
        groups = [(f"g{g}", 3) for g in range(300) if g % 2 == label]
        assert {g: got[g] for g, _ in groups} == brute_split(groups, split.fold_targets(0.15, 0.2), 42)


def test_required_columns(copies):
    with pytest.raises(ValueError, match="absent"):
        split.require_columns(copies, ["relpath", "absent"])


# -- provenance and model ---------------------------------------------------------------


def test_near_keys_hold_a_bounded_cache(monkeypatch):
    monkeypatch.setattr(text_keys, "MAX_CELLS", 10)
    sizes, whole = [], text_keys.grid_key
    monkeypatch.setattr(text_keys, "grid_key", lambda t, cells: (sizes.append(len(cells)), whole(t, cells))[1])
    texts = [None if i % 7 == 0 else f"part {i} of a text, word{i * i}" for i in range(200)]
    keys = [k for out in text_keys.text_grid_key.func(iter([pa.array(texts[:90]), pa.array(texts[90:])])) for k in out.to_pylist()]
    assert keys == [None if t is None else whole(t, {}) for t in texts]
    assert max(sizes) <= 10


def test_normalise_numbers_collisions(spark):
    paths = ["/r/a/ok_front/x.png", "/r2/a/ok_front/x.png", "/r3/A/ok_front/x.png", "/r/b/def_front/y.JPG", "/r/b/other/z.png", "/r/b/ok_front/t.txt"]
    got = {r["path"]: (r["class_name"], r["dest"]) for r in source.normalise_corpus(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {
        "/r/a/ok_front/x.png": ("ok", "a_x.png"),
        "/r2/a/ok_front/x.png": ("ok", "a_x__1.png"),
        "/r3/A/ok_front/x.png": ("ok", "a_x__2.png"),
        "/r/b/def_front/y.JPG": ("defect", "b_y.JPG"),
    }
    record = source.provenance(spark.createDataFrame([("ok",)], "class_name string"), source="local")
    with pytest.raises(source.CorpusEmpty, match="defect"):
        source.require_classes(record)


def test_control_model_learns_from_hog(spark, scan, corpus):
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(corpus)
    rows = images.select("image.*").where("height = 64").withColumn("label", F.col("origin").contains("/defect/").cast("int"))
    hog = features.hog_features(rows, ["origin", "label"], resize=64, cell=16)
    fitted = model.fit_control_model(hog, "hog", c=1.0, max_iter=20)
    scored = model.score_batch(fitted, hog, array_features="hog")
    assert scored.where("probability BETWEEN 0 AND 1").count() == rows.count()
    assert set(r[0] for r in scored.select("decision").distinct().collect()) <= {"auto_accept", "auto_reject", "human_review"}


@pytest.mark.parametrize("name", ["jn1_manifest_with_stats", "jn1_missing_stats", "agg38_dataset_card"])
def test_a_query_scans_the_corpus_once(spark, monkeypatch, name):
    from lineguard.plans import catalog, fixtures

    calls, scan = [], fixtures.scan_docs
    monkeypatch.setattr(fixtures, "scan_docs", lambda *a: (calls.append(a), scan(*a))[1])
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_texts_reach_the_near_key_in_bounded_batches(spark, monkeypatch):
    from lineguard.plans import fixtures
    from lineguard.session import TEXT_ROWS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    monkeypatch.setattr(fixtures, "text_grid_key", F.arrow_udf(lambda texts: pa.array([str(len(texts))] * len(texts)), "string"))
    found = fixtures.scan_docs(spark, "/root/testdata/sf0.01").select(F.col("dhash").cast("int").alias("n"))
    assert found.agg(F.max("n")).first()[0] <= TEXT_ROWS < found.count()
    assert spark.conf.get(key) == given
