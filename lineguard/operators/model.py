"""The classical control model and batch scoring, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import confidence, predicted_class, predicted_label, route_decision, utc_iso
from lineguard.operators.metrics import class_weights


def fit_control_model(
    train: DataFrame,
    features: Sequence[str] | str,
    label: str = "label",
    *,
    c: float = 1.0,
    max_iter: int = 100,
) -> PipelineModel:
    """Standardised, class-balanced L2 logistic regression.

    *features* names scalar columns, or one array column such as a HOG descriptor. ``c`` is the inverse
    penalty on the summed loss, so Spark's mean-loss penalty is ``1 / (c * rows)``.
    """
    weights = {r["label"]: (r["weight"], r["n"]) for r in class_weights(train, label, 2).collect()}
    rows = sum(n for _, n in weights.values())
    weighted = train.withColumn(
        "_weight", F.when(F.col(label) == 1, F.lit(weights[1][0])).otherwise(F.lit(weights[0][0]))
    )
    stages = []
    if isinstance(features, str):
        weighted = weighted.withColumn("_raw", array_to_vector(F.col(features)))
    else:
        stages.append(VectorAssembler(inputCols=list(features), outputCol="_raw"))
    stages += [
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_scaled",
            labelCol=label,
            weightCol="_weight",
            regParam=1.0 / (c * max(rows, 1)),
            standardization=False,
            maxIter=max_iter,
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score_batch(
    model: PipelineModel,
    df: DataFrame,
    *,
    threshold: float = 0.5,
    classes: Sequence[str] = params.CLASSES,
    band: tuple[float, float] = params.REVIEW_BAND,
    array_features: str | None = None,
    context: dict[str, str] | None = None,
) -> DataFrame:
    """Prediction-log columns for every row: probability, label, class, decision, model context."""
    inputs = df.withColumn("_raw", array_to_vector(F.col(array_features))) if array_features else df
    scored = model.transform(inputs).withColumn(
        "probability", vector_to_array(F.col("probability")).getItem(1)
    )
    return decision_columns(scored.select(*df.columns, "probability"), threshold, classes, band, context)


def decision_columns(
    df: DataFrame,
    threshold: float,
    classes: Sequence[str] = params.CLASSES,
    band: tuple[float, float] = params.REVIEW_BAND,
    context: dict[str, str] | None = None,
) -> DataFrame:
    p, t = F.col("probability"), F.lit(float(threshold))
    label = predicted_label(p, t)
    extra: dict[str, Column] = {k: F.lit(v) for k, v in (context or {}).items()}
    if "ts" in df.columns:
        extra["ts_iso"] = utc_iso(F.col("ts"))
    return df.withColumns(
        {
            "predicted_label": label,
            "predicted_class": predicted_class(label, classes),
            "confidence": confidence(p, label),
            "decision": route_decision(p, t, *band),
            "model_threshold": t,
            **extra,
        }
    )
