"""Queries over gray images derived from the embeddings, and the control model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineguard import params
from lineguard.operators import features, metrics, model, quality
from lineguard.plans import fixtures as X
from lineguard.plans.registry import register
from lineguard.plans.views_sql import r

STATS = list(params.FEATURE_NAMES)
_STATS_SQL = ", ".join(f"{r(c)} AS {c}" for c in STATS)


@register(
    "dup2_gradient_key",
    "pixels",
    """SELECT image_id, string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY y) AS dhash FROM (
      SELECT image_id, y, sum(CASE WHEN bit THEN (64 >> x) ELSE 0 END)::bigint AS row7 FROM (
        SELECT image_id, i // 7 AS y, i % 7 AS x, px[(i // 7) * 8 + i % 7 + 2] > px[(i // 7) * 8 + i % 7 + 1] AS bit
        FROM (SELECT image_id, px, unnest(range(56)) AS i FROM pixels)) GROUP BY 1, 2) GROUP BY 1""".replace(
        "string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY y)",
        "lpad(lower(to_hex(sum(row7::hugeint * power(2::double, (7 - y) * 7)::hugeint)::bigint)), 14, '0')",
    ),
)
def dup2(spark, sf):
    """The no-resize path, in column expressions."""
    return features.gradient_key(X.pixel_grids(spark, sf), "px", 8, 8).select("image_id", "dhash")


@register("dup2_image_dhash")
def dup2_image(spark, sf):
    return features.image_dhash(X.gray_images(spark, sf), ["image_id"])


@register("fea1_to_gray_unit", "cells", f"SELECT image_id, y * 8 + x AS pos, {r('v')} AS v FROM cells")
def fea1(spark, sf):
    px = features.gray_pixels(X.gray_images(spark, sf), ["image_id"])
    return px.select("image_id", F.posexplode("px").alias("pos", "v"))


@register("fea2_image_statistics", "pixel_stats", f"SELECT image_id, {_STATS_SQL} FROM pixel_stats")
def fea2(spark, sf):
    return features.image_statistics(X.gray_images(spark, sf), ["image_id"])


@register(
    "fea3_statistics_frame",
    "pixel_stats",
    "SELECT label::bigint AS label, count(*) AS n, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in STATS) + " FROM pixel_stats GROUP BY 1",
)
def fea3(spark, sf):
    stats = features.image_statistics(X.gray_images(spark, sf), ["image_id", "label"])
    return stats.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in STATS])


@register(
    "prj18_feature_vector",
    "pixel_stats",
    f"SELECT image_id, i AS pos, {r('[' + ', '.join(STATS) + '][i + 1]')} AS v FROM (SELECT *, unnest(range(7)) AS i FROM pixel_stats)",
)
def prj18(spark, sf):
    stats = features.image_statistics(X.gray_images(spark, sf), ["image_id"])
    return features.feature_vector(stats).select("image_id", F.posexplode("features").alias("pos", "v"))


@register(
    "agg6_pixel_effect_sizes",
    "pixel_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS n_rows, {r(f"abs(avg({c}) FILTER (label = 0) - avg({c}) FILTER (label = 1)) / sqrt((var_pop({c}) FILTER (label = 0) + var_pop({c}) FILTER (label = 1)) / 2.0::double)")} AS effect_size FROM pixel_stats"""
        for c in STATS
    ),
)
def agg6_pixels(spark, sf):
    return quality.effect_sizes(features.image_statistics(X.gray_images(spark, sf), ["image_id", "label"]), STATS)


@register("fea4_hog_features")
def fea4(spark, sf):
    hog = features.hog_features(X.gray_images(spark, sf), ["image_id"], cell=2)
    return hog.select("image_id", F.size("hog").alias("dim"), F.array_min("hog").alias("least"), F.array_max("hog").alias("most"))


@register(
    "fea5_preprocess",
    "cells",
    f"SELECT image_id, y * 8 + x AS pos, (round((v - 0.485::double) / 0.229::double, 4) + 0.0::double) AS v FROM cells",
)
def fea5(spark, sf):
    """At the images' own size, so the resampler is the identity."""
    out = features.preprocess(X.gray_images(spark, sf), ["image_id"], resize=8)
    return out.select("image_id", F.posexplode("tensor").alias("pos", "x")).select(
        "image_id", "pos", F.round(F.col("x").cast("double"), 4).alias("v")
    )


def _training_rows(spark, sf):
    rows = X.preds(spark, sf).where(F.col("ground_truth").isNotNull())
    return rows.select(*X.PRED_FEATURES, F.col("ground_truth").alias("label"))


def control_model(spark, sf):
    return model.fit_control_model(_training_rows(spark, sf), list(X.PRED_FEATURES))


@register("fea6_control_model")
def fea6(spark, sf):
    """Fit, then AUC on the training rows."""
    scored = model.score_batch(control_model(spark, sf), _training_rows(spark, sf))
    return metrics.rank_metrics(scored, [], "probability", "label")


@register("fea7_score_batch")
def fea7(spark, sf):
    """A fresh score for every logged row, tallied by scenario and decision."""
    requests = X.preds(spark, sf).select("request_id", "ts", "scenario", *X.PRED_FEATURES)
    scored = model.score_batch(control_model(spark, sf), requests, context={"model_name": "control"})
    return scored.groupBy("scenario", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 4).alias("mean_probability")
    )
