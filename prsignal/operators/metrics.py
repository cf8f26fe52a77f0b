"""Exact area under the ROC and precision-recall curves, without one global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prsignal.session import materialize

# Ranges of scores that are worked on apart; the table of their totals has as many rows.
RANGES = 200


def curve_points(scored: DataFrame, score: str = "p1", label: str = "label", ranges: int = RANGES) -> DataFrame:
    """One row per distinct score: positives and negatives at it and at any higher score.

    Rows are first counted per score, which merges ties before the shuffle; the
    counts are kept, as they are gone over three times.  The scores are then cut
    into ranges at quantiles; running totals inside a range start from the
    totals of the ranges above it.
    """
    positive = (F.col(label) != 0).cast("bigint")
    counts = materialize(
        scored.groupBy(F.col(score).alias("score")).agg(
            F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
        )
    )
    quantiles = [i / ranges for i in range(1, ranges)]
    cuts = counts.agg(F.percentile_approx("score", quantiles, 10_000).alias("cuts")).scalar()
    ranged = counts.withColumn("cuts", cuts).withColumn(
        "range", F.size(F.filter(F.coalesce("cuts", F.array()), lambda c: c <= F.col("score")))
    )
    totals = ranged.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # At most `ranges` rows: one small window, and a table that is safe to broadcast.
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("neg_above"),
    )
    running = (
        Window.partitionBy("range")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumns(
            {"pos_in": F.sum("pos").over(running), "neg_in": F.sum("neg").over(running)}
        )
        .join(F.broadcast(offsets), "range")
        .select(
            "score",
            "pos",
            "neg",
            (F.col("pos_in") + F.col("pos_above")).alias("tp"),
            (F.col("neg_in") + F.col("neg_above")).alias("fp"),
        )
    )


def areas(scored: DataFrame, score: str = "p1", label: str = "label") -> DataFrame:
    """One row: n, positives, roc (area under ROC), pr (area under precision-recall).

    Both curves are joined by straight lines between distinct scores; the
    precision-recall curve begins at recall 0 with the precision of its first
    point.  A curve that is not defined (one class is missing) gives null.
    """
    points = curve_points(scored, score, label)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    before_tp, before_fp = tp - F.col("pos"), fp - F.col("neg")
    precision = tp / (tp + fp)
    before = F.when(before_tp + before_fp > 0, F.try_divide(before_tp, before_tp + before_fp))
    return points.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("neg") * (before_tp + tp) / 2).alias("roc_area"),
        F.sum(F.col("pos") * (F.coalesce(before, precision) + precision) / 2).alias("pr_area"),
    ).select(
        "n",
        "positives",
        F.try_divide("roc_area", F.col("positives") * (F.col("n") - F.col("positives"))).alias("roc"),
        F.try_divide("pr_area", F.col("positives")).alias("pr"),
    )
