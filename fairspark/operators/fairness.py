"""Group-fairness metrics as column expressions over contingency counts (the group is unprivileged, the rest privileged)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.scalar import ratio, squared_error_to_one
from fairspark.operators.contingency import contingency, with_rest
from fairspark.operators.neighbours import consistency


def _rates(prefix: str) -> dict[str, Column]:
    c = lambda x: F.col(prefix + x)
    negative = c("n") - c("pos")
    return {"selection": ratio(c("pp"), c("n")), "tpr": ratio(c("tp"), c("pos")), "fpr": ratio(c("fp"), negative), "fnr": ratio(c("pos") - c("tp"), c("pos"))}


def disparate_impact() -> Column:
    return ratio(_rates("")["selection"], _rates("rest_")["selection"])


def discrimination_score() -> Column:
    return 1 - F.abs(_rates("")["selection"] - _rates("rest_")["selection"])


def true_positive_rate_diff() -> Column:
    return F.abs(1 - (_rates("rest_")["tpr"] - _rates("")["tpr"]))


def false_positive_rate_diff() -> Column:
    return F.abs(1 - (_rates("rest_")["fpr"] - _rates("")["fpr"]))


def false_positive_error_rate_balance_score() -> Column:
    return 1 - F.abs(_rates("")["fpr"] - _rates("rest_")["fpr"])


def false_negative_error_rate_balance_score() -> Column:
    return 1 - F.abs(_rates("")["fnr"] - _rates("rest_")["fnr"])


METRICS = {
    "disparate_impact": disparate_impact,
    "discrimination_score": discrimination_score,
    "true_positive_rate_diff": true_positive_rate_diff,
    "false_positive_rate_diff": false_positive_rate_diff,
    "false_positive_error_rate_balance_score": false_positive_error_rate_balance_score,
    "false_negative_error_rate_balance_score": false_negative_error_rate_balance_score,
}


def fairness(df: DataFrame, group: str, truth: str = "y", prediction: str = "p", within: Sequence[str] = (), metrics: Sequence[str] = tuple(METRICS), key: str | None = None, features: Sequence[str] = ()) -> DataFrame:
    """One row a group (``value``), each against the rest, with ``fairness_<metric>`` columns.

    With features (and an integer key that tells rows apart) there is ``fairness_consistency`` too: three nearest neighbours
    by the features and by being in the group, of the same values of ``within``.
    """
    counts = with_rest(contingency(df, *within, group, truth=truth, prediction=prediction), *within)
    out = counts.select(*within, F.col(group).alias("value"), *(METRICS[m]().alias(f"fairness_{m}") for m in metrics))
    if not features:
        return out
    if key is None:
        raise ValueError("consistency needs a key")
    near = consistency(df, key, group, features, prediction, within=within)
    near = near.select(*(F.col(c).alias(f"_within{i}") for i, c in enumerate(within)), F.col("value").alias("_value"), F.col("consistency").alias("fairness_consistency"))
    same = F.col("value").cast("string").eqNullSafe(F.col("_value"))
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_within{i}"))
    return out.join(near, same, "left").drop("_value", *(f"_within{i}" for i in range(len(within))))


def group_sse(df: DataFrame, group: str, truth: str = "y", prediction: str = "p", within: Sequence[str] = (), key: str | None = None, features: Sequence[str] = ()) -> DataFrame:
    """The squared errors to 1 of each metric, summed over groups: the fitness of a correction."""
    bundle = fairness(df, group, truth, prediction, within, key=key, features=features)
    names = [*METRICS, *(["consistency"] if features else [])]
    sums = [F.sum(squared_error_to_one(f"fairness_{m}")).alias(f"sse_{m}") for m in names]
    return bundle.groupBy(*within).agg(*sums) if within else bundle.agg(*sums)
