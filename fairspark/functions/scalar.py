"""Column functions: safe ratios, label recoding, fixed-format rounding and report colours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def diff(a: Column, b: Column) -> Column:
    return a - b


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def squared_error_to_one(x: Column | str) -> Column:
    """Squared distance from the ideal value of a fairness metric; NaN counts as missing."""
    return F.pow(F.nanvl(_col(x).cast("double"), F.lit(None)) - 1, F.lit(2))


def rounded_text(x: Column | str, decimals: int = 4) -> Column:
    """Rounds half to even and prints with fixed decimals; null stays null."""
    return F.when(_col(x).isNotNull(), F.format_string(f"%.{decimals}f", F.bround(_col(x).cast("double"), decimals)))


def padded_text(x: Column | str, decimals: int = 3) -> Column:
    """Like ``rounded_text``, but null and NaN print as nan."""
    value = _col(x).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit("nan")).otherwise(rounded_text(value, decimals))


def age_in_three(x: Column | str, low: int = 25, high: int = 60) -> Column:
    """Adult strictly between the bounds, Aged from the upper one, else Young."""
    age = _col(x)
    return F.when((age > low) & (age < high), "Adult").when(age >= high, "Aged").otherwise("Young")


def age_in_two(x: Column | str, cutoff: int = 25) -> Column:
    return F.when(_col(x) < cutoff, "Young").otherwise("Aged")


def among(x: Column | str, values: Sequence, inside, outside) -> Column:
    """One label for listed values, another for the rest (null included)."""
    return F.when(_col(x).isin(list(values)), F.lit(inside)).otherwise(F.lit(outside))


def recode_by_pattern(x: Column | str, patterns: Sequence[tuple[str, object]]) -> Column:
    """The value of the first pattern found in the text; null if none is."""
    out = F.when(F.lit(False), F.lit(patterns[0][1]))
    for pattern, value in patterns:
        out = out.when(_col(x).rlike(pattern), F.lit(value))
    return out


def code_to_label(code: Column | str, labels: Mapping[int, str]) -> Column:
    """The label of a code by a literal map; unknown codes give null."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(code))


def replaced_in_order(x: Column | str, replacements: Sequence[tuple[str, str]]) -> Column:
    """Substring replacements, one after another."""
    out = _col(x)
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def flat_genotype(genotype: Column | str) -> Column:
    """The digits of an array of (group, algorithm) structs, joined."""
    return F.array_join(F.flatten(F.transform(_col(genotype), lambda g: F.array(g["group"].cast("string"), g["algorithm"].cast("string")))), "")


#: Limits under which a squared error is good, for disparate impact and for the other metrics.
GOOD_DISPARATE_IMPACT, GOOD_OTHER = 1.2, 0.075


def fairness_colour(value: Column, baseline: Column, is_disparate_impact: Column | bool) -> Column:
    """green within the limit, orange at or over the baseline, else yellow."""
    limit = F.when(F.lit(is_disparate_impact) if isinstance(is_disparate_impact, bool) else is_disparate_impact, GOOD_DISPARATE_IMPACT).otherwise(GOOD_OTHER)
    return F.when(value <= limit, "green").when(value >= baseline, "orange").otherwise("yellow")


def baseline_colour(value: Column, is_disparate_impact: Column | bool) -> Column:
    """red over the limit, else nothing."""
    limit = F.when(F.lit(is_disparate_impact) if isinstance(is_disparate_impact, bool) else is_disparate_impact, GOOD_DISPARATE_IMPACT).otherwise(GOOD_OTHER)
    return F.when(value > limit, "red").otherwise("")


def performance_colour(value: Column, baseline: Column) -> Column:
    return F.when(value > baseline, "green").when(value < baseline, "orange").otherwise("yellow")
