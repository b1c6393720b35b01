"""Classification metrics, curves and thresholds, computed per group in one job.

Everything starts from ``score_counts``: positives and negatives per distinct
score. Ties are then a single row, so mid-ranks and curve points need no special
case, and a hot score is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard import params
from lineguard.functions.columns import fixed_text
from lineguard.operators.ordered import running_sums

CELL_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "specificity",
    "f1",
    "mcc",
    "false_negative_rate",
    "false_positive_rate",
)


def confusion_counts(
    df: DataFrame, by: Sequence[str], score: str, label: str, threshold: Column | float
) -> DataFrame:
    """tp, fp, fn, tn of ``score >= threshold`` over labelled rows."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos, neg = F.col(score) >= t, F.col(label) == 1, F.col(label) == 0
    return df.groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"),
        F.count_if(neg & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"),
        F.count_if(neg & ~hit).alias("tn"),
    )


def _over(num: str, den: str) -> str:
    """SQL for a quotient that is 0.0 where the denominator is zero."""
    return f"IF({den} <> 0, ({num}) / CAST({den} AS DOUBLE), 0.0D)"


def cell_metrics() -> dict[str, Column]:
    """Every metric that follows from the columns tp, fp, fn, tn; a zero denominator gives 0.0."""
    precision, recall, specificity = _over("tp", "(tp + fp)"), _over("tp", "(tp + fn)"), _over("tn", "(tn + fp)")
    d = {c: f"CAST({c} AS DOUBLE)" for c in ("tp", "fp", "fn", "tn")}
    spread = f"sqrt(({d['tp']} + fp) * ({d['tp']} + fn) * ({d['tn']} + fp) * ({d['tn']} + fn))"
    sql = {
        "accuracy": _over("tp + tn", "(tp + fp + fn + tn)"),
        "balanced_accuracy": f"({recall} + {specificity}) / 2.0D",
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "f1": _over(f"2 * {precision} * {recall}", f"({precision} + {recall})"),
        "mcc": _over(f"{d['tp']} * tn - {d['fp']} * fn", spread),
        "false_negative_rate": _over("fn", "(tp + fn)"),
        "false_positive_rate": _over("fp", "(tn + fp)"),
    }
    return {m: F.expr(f"{text} AS {m}") for m, text in sql.items()}


def score_rows(df: DataFrame, score: str, label: str) -> DataFrame:
    """The scores of labelled rows, from which running sums take their cut points."""
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return scored.select(F.col(score).cast("double").alias("score"))


def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str, *extra: Column) -> DataFrame:
    """``(by..., score, pos, neg)`` over labelled, scored rows."""
    return (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
            *extra,
        )
    )


def ranked_scores(
    df: DataFrame, by: Sequence[str], score: str, label: str, *, bounded: bool = False
) -> DataFrame:
    """Score counts with running and total positives and negatives, ascending."""
    return running_sums(
        score_counts(df, by, score, label),
        by,
        ["score"],
        ["pos", "neg"],
        bounded=bounded,
        cut_source=score_rows(df, score, label),
    )


def _rank_metrics() -> list[Column]:
    """AUC: pairs won by a positive plus half the ties. AP: precision at each score, weighted by
    the positives found there."""
    auc = "sum(pos * (CAST(cum_neg - neg AS DOUBLE) + neg / 2.0D)) / (CAST(max(tot_pos) AS DOUBLE) * max(tot_neg))"
    tp, fp = "(tot_pos - cum_pos + pos)", "(tot_neg - cum_neg + neg)"
    ap = f"sum(pos * ({tp} / CAST({tp} + {fp} AS DOUBLE))) / CAST(max(tot_pos) AS DOUBLE)"
    both = "max(tot_pos) > 0 AND max(tot_neg) > 0"
    return [
        F.expr(f"CASE WHEN {both} THEN {auc} END AS roc_auc"),
        F.expr(f"CASE WHEN {both} THEN {ap} END AS average_precision"),
    ]


def rank_metrics(
    df: DataFrame, by: Sequence[str], score: str, label: str, *, bounded: bool = False
) -> DataFrame:
    """ROC-AUC with mid-ranks and step-sum average precision; null for one class."""
    return ranked_scores(df, by, score, label, bounded=bounded).groupBy(*by).agg(*_rank_metrics())


def metrics_from_ranked(ranked: DataFrame, by: Sequence[str], threshold: Column) -> DataFrame:
    """The full metric row per group from ranked score counts.

    *threshold* may be a literal or any column that is constant per group.
    """
    cut = ranked.withColumn("_threshold", threshold)
    agg = cut.groupBy(*by).agg(
        F.first("_threshold").alias("threshold"),
        F.expr("coalesce(sum(pos) FILTER (WHERE score >= _threshold), 0) AS tp"),
        F.expr("coalesce(sum(neg) FILTER (WHERE score >= _threshold), 0) AS fp"),
        F.expr("coalesce(sum(pos) FILTER (WHERE NOT score >= _threshold), 0) AS fn"),
        F.expr("coalesce(sum(neg) FILTER (WHERE NOT score >= _threshold), 0) AS tn"),
        F.expr("sum(pos * (score - 1.0D) * (score - 1.0D) + neg * score * score) AS _brier"),
        *_rank_metrics(),
    )
    cells = cell_metrics()
    n = "(tp + fp + fn + tn)"
    return agg.select(
        *by,
        "threshold",
        *[cells[m] for m in CELL_METRICS],
        "roc_auc",
        "average_precision",
        F.expr(f"{_over('_brier', n)} AS brier"),
        "tp",
        "fp",
        "fn",
        "tn",
        F.expr(f"{n} AS n_samples"),
        F.expr(f"{_over('tp + fn', n)} AS positive_rate"),
        F.expr(f"{_over('tp + fp', n)} AS predicted_positive_rate"),
    )


def classification_metrics(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    label: str,
    threshold: float = 0.5,
    *,
    bounded: bool = False,
) -> DataFrame:
    """All metrics of each group at one threshold."""
    ranked = ranked_scores(df, by, score, label, bounded=bounded)
    return metrics_from_ranked(ranked, by, F.lit(float(threshold)))


def pr_curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    ranked = ranked_scores(df, by, score, label)
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return ranked.select(
        *by,
        F.col("score").alias("threshold"),
        (tp / (tp + fp).cast("double")).alias("precision"),
        (tp / F.greatest(F.col("tot_pos"), F.lit(1)).cast("double")).alias("recall"),
    )


def roc_curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (inf, 0, 0) start row."""
    ranked = ranked_scores(df, by, score, label)
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    points = ranked.select(
        *by,
        F.col("score").alias("threshold"),
        (fp / F.greatest(F.col("tot_neg"), F.lit(1)).cast("double")).alias("fpr"),
        (tp / F.greatest(F.col("tot_pos"), F.lit(1)).cast("double")).alias("tpr"),
        (F.col("cum_pos") + F.col("cum_neg") == F.col("tot_pos") + F.col("tot_neg")).alias("_top"),
    )
    # Each group has one top row; it also yields the start of the curve.
    start = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    point = F.struct("threshold", "fpr", "tpr")
    both = F.when(F.col("_top"), F.array(start, point)).otherwise(F.array(point))
    return points.select(*by, F.explode(both).alias("_p")).select(*by, "_p.threshold", "_p.fpr", "_p.tpr")


def _grid_index(p: Column, steps: int) -> Column:
    """Largest grid index whose grid value is <= p, compared on the grid doubles."""
    step = F.lit(1.0 / steps)
    guess = F.least(F.greatest(F.floor(p * steps), F.lit(-1)), F.lit(steps))
    up = (guess < steps) & ((guess + 1) * step <= p)
    down = (guess >= 0) & (guess * step > p)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess).cast("int")


def threshold_grid(
    df: DataFrame, by: Sequence[str], score: str, label: str, n_grid: int = params.THRESHOLD_GRID
) -> DataFrame:
    """Confusion cells and metrics at every grid threshold, from one pass over the rows.

    Scores fall into grid cells (at most ``n_grid + 1`` per group, combined
    map-side); suffix sums over the cells give the counts at each threshold.
    """
    by = list(by)
    steps = n_grid - 1
    cells = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .select(*by, _grid_index(F.col(score), steps).alias("_cell"), F.col(label).alias("_label"))
        .groupBy(*by, "_cell")
        .agg(F.count_if(F.col("_label") == 1).alias("pos"), F.count_if(F.col("_label") == 0).alias("neg"))
    )
    packed = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_cell", F.struct("pos", "neg")))).alias("_cells"),
        F.sum("pos").alias("tot_pos"),
        F.sum("neg").alias("tot_neg"),
    )
    dense = packed.select(
        *by, "tot_pos", "tot_neg", "_cells", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("idx")
    ).select(
        *by,
        "idx",
        "tot_pos",
        "tot_neg",
        F.coalesce(F.try_element_at("_cells", F.col("idx"))["pos"], F.lit(0)).alias("pos"),
        F.coalesce(F.try_element_at("_cells", F.col("idx"))["neg"], F.lit(0)).alias("neg"),
    )
    # At most n_grid rows per group, so a plain window is bounded.
    at_or_above = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(F.desc("idx"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = dense.select(
        *by,
        "idx",
        F.when(F.col("idx") == steps, F.lit(1.0))
        .otherwise(F.col("idx") * F.lit(1.0 / steps))
        .alias("threshold"),
        F.sum("pos").over(at_or_above).alias("tp"),
        F.sum("neg").over(at_or_above).alias("fp"),
        "tot_pos",
        "tot_neg",
    ).select(
        *by,
        "idx",
        "threshold",
        "tp",
        "fp",
        (F.col("tot_pos") - F.col("tp")).alias("fn"),
        (F.col("tot_neg") - F.col("fp")).alias("tn"),
    )
    metrics = cell_metrics()
    return counts.select("*", *[metrics[m] for m in CELL_METRICS])


def choose_threshold(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    label: str,
    strategy: str = "max_f1",
    *,
    fixed_threshold: float = 0.5,
    target_recall: float = params.TARGET_RECALL,
    n_grid: int = params.THRESHOLD_GRID,
) -> DataFrame:
    """One operating point per group: ``(by..., threshold, strategy, reachable, rationale, metrics...)``.

    ``max_f1`` takes the lowest threshold with the best F1. ``target_recall`` takes the
    most precise threshold that reaches the recall, or the best recall, flagged
    unreachable. ``fixed`` evaluates the given constant.
    """
    by = list(by)
    values = ["tp", "fp", "fn", "tn", *CELL_METRICS]
    if strategy == "fixed":
        cells = confusion_counts(df.where(F.col(label).isNotNull()), by, score, label, fixed_threshold)
        m = cell_metrics()
        return cells.select(
            *by,
            F.lit(float(fixed_threshold)).alias("threshold"),
            F.lit(strategy).alias("strategy"),
            F.lit(True).alias("reachable"),
            F.lit(f"fixed threshold {fixed_threshold:.3f}").alias("rationale"),
            "tp",
            "fp",
            "fn",
            "tn",
            *[m[k] for k in CELL_METRICS],
        )
    grid = threshold_grid(df, by, score, label, n_grid)
    point = F.struct("threshold", *values)
    earliest = -F.col("idx")
    if strategy == "max_f1":
        best = grid.groupBy(*by).agg(F.max_by(point, F.struct("f1", earliest)).alias("best"))
        reachable = F.lit(True)
        why = F.concat(F.lit("best F1 "), fixed_text(F.col("best.f1"), 4), F.lit(f" over {n_grid} thresholds"))
    elif strategy == "target_recall":
        ok = F.col("recall") >= F.lit(float(target_recall))
        # Reaching thresholds outrank the rest; within a tier precision, or recall, decides.
        rank = F.struct(
            ok, F.when(ok, F.col("precision")).otherwise(F.col("recall")), earliest
        )
        best = grid.groupBy(*by).agg(F.max_by(point, rank).alias("best"))
        reachable = F.col("best.recall") >= F.lit(float(target_recall))
        why = F.when(
            reachable,
            F.concat(
                F.lit("best precision "),
                fixed_text(F.col("best.precision"), 4),
                F.lit(f" with recall of at least {target_recall:.2f}"),
            ),
        ).otherwise(
            F.concat(
                F.lit(f"recall {target_recall:.2f} unreachable, best is "), fixed_text(F.col("best.recall"), 4)
            )
        )
    else:
        raise ValueError(f"unknown threshold strategy {strategy!r}: use max_f1, target_recall or fixed")
    return best.select(
        *by,
        F.col("best.threshold").alias("threshold"),
        F.lit(strategy).alias("strategy"),
        reachable.alias("reachable"),
        why.alias("rationale"),
        *[F.col(f"best.{v}").alias(v) for v in values],
    )


def class_weights(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Inverse-frequency weights with mean 1; an absent class counts as one row."""
    counts = df.agg(*[F.count_if(F.col(label) == i).alias(f"n{i}") for i in range(n_classes)])
    seen = [F.greatest(F.col(f"n{i}"), F.lit(1)).cast("double") for i in range(n_classes)]
    total = sum(seen[1:], seen[0])
    raw = [total / (F.lit(float(n_classes)) * s) for s in seen]
    mean = sum(raw[1:], raw[0]) / float(n_classes)
    entry = [
        F.struct(F.lit(i).alias("label"), F.col(f"n{i}").alias("n"), (raw[i] / mean).alias("weight"))
        for i in range(n_classes)
    ]
    return counts.select(F.explode(F.array(*entry)).alias("w")).select("w.label", "w.n", "w.weight")


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight of class 1 relative to class 0: the loss weight of the positive class."""
    w = class_weights(df, label, 2)
    one, zero = (F.max(F.when(F.col("label") == i, F.col("weight"))) for i in (1, 0))
    return w.agg((one / zero).alias("pos_weight"))


def score_histogram(df: DataFrame, by: Sequence[str], score: str, bins: int = params.SCORE_HISTOGRAM_BINS) -> DataFrame:
    """Equal-width density on [0, 1], the last bin closed; every group has all its bins, empty ones too."""
    inside = df.where(F.col(score).between(0.0, 1.0))
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("bin", "n")))  # at most one per bin
    groups = counts.groupBy(*by).agg(F.sum("n").alias("total"), entries.alias("filled"))
    n = F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0)).cast("bigint")
    each = groups.where("total > 0").select(*by, "total", "filled", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return each.select(
        *by, "bin", (F.col("bin") / float(bins)).alias("bin_start"), n.alias("n"), (n / (F.col("total") * (1.0 / bins))).alias("density")
    )
