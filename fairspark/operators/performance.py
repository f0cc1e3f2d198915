"""Classification performance from hard labels, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.scalar import ratio


def confusion(df: DataFrame, *keys: str, truth: str = "y", prediction: str = "p", weight: str | None = None) -> DataFrame:
    """tn, fp, fn and tp by keys (over all rows without any); weight: a column of how many rows each stands for."""
    many = F.col(weight).cast("long") if weight else F.lit(1)
    y, p = F.col(truth).cast("long"), F.col(prediction).cast("long")
    cells = {"tn": (1 - y) * (1 - p), "fp": (1 - y) * p, "fn": y * (1 - p), "tp": y * p}
    return df.groupBy(*keys).agg(*(F.coalesce(F.sum(c * many), F.lit(0)).cast("long").alias(k) for k, c in cells.items()))


def _c() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))


def accuracy() -> Column:
    tn, fp, fn, tp = _c()
    return ratio(tp + tn, tn + fp + fn + tp)


def precision() -> Column:
    _, fp, _, tp = _c()
    return ratio(tp, tp + fp)


def sensitivity() -> Column:
    _, _, fn, tp = _c()
    return ratio(tp, tp + fn)


recall = sensitivity


def specificity() -> Column:
    tn, fp, _, _ = _c()
    return ratio(tn, tn + fp)


def f1() -> Column:
    _, fp, fn, tp = _c()
    return ratio(2 * tp, 2 * tp + fp + fn)


def hard_auc() -> Column:
    """The area under the curve through (0, 0), the one point of hard labels, and (1, 1)."""
    return (sensitivity() + specificity()) / 2


def matthews() -> Column:
    tn, fp, fn, tp = _c()
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def balanced_gmean() -> Column:
    return F.sqrt(sensitivity() * specificity())


ALL = {"accuracy": accuracy, "f1_score": f1, "auc": hard_auc, "precision": precision, "recall": recall, "specificity": specificity, "matthews_cc": matthews, "gmean": balanced_gmean}


def performance(df: DataFrame, within: Sequence[str] = (), truth: str = "y", prediction: str = "p", metrics: Sequence[str] = ("accuracy", "f1_score", "auc"), weight: str | None = None) -> DataFrame:
    """``performance_<metric>`` columns, one row by keys."""
    return confusion(df, *within, truth=truth, prediction=prediction, weight=weight).select(*within, *(ALL[m]().alias(f"performance_{m}") for m in metrics))


def roc_points(df: DataFrame, truth: str = "y", prediction: str = "p") -> DataFrame:
    """The three points of the curve of hard labels: ordinal, fpr, tpr."""
    cells = confusion(df, truth=truth, prediction=prediction)
    points = F.array(
        F.struct(F.lit(0).alias("ordinal"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")),
        F.struct(F.lit(1).alias("ordinal"), (1 - specificity()).alias("fpr"), sensitivity().alias("tpr")),
        F.struct(F.lit(2).alias("ordinal"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")),
    )
    return cells.select(F.inline(points))
