"""Bias corrections of training data: massaging, reweighing with resampling, distribution repair.

Each takes a table with a 0/1 column of the group in question (1: unprivileged) and a 0/1 target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.operators.ranking import hash32, ranked_by_range

#: Fixed value: smoothing of variances, by the largest variance of a feature.
SMOOTHING = 1e-9


def naive_bayes_scores(df: DataFrame, features: Sequence[str], target: str = "y", score: str = "p0") -> DataFrame:
    """Adds P(target = 0) of a Gaussian naive Bayes fitted to the same rows: one aggregation, then expressions."""
    x = [F.col(c).cast("double") for c in features]
    stats = [F.count(F.lit(1)).alias("n")] + [f(c).alias(f"{name}{i}") for i, c in enumerate(x) for name, f in (("m", F.avg), ("v", F.var_pop))]
    by = {r[target]: r for r in df.groupBy(F.col(target).cast("int").alias(target)).agg(*stats).collect()}  # two rows
    if set(by) != {0, 1}:
        raise ValueError("the target needs rows of both classes")
    most = max(df.agg(*(F.var_pop(c) for c in x)).first())
    total = sum(r["n"] for r in by.values())

    def likelihood(k: int) -> Column:
        out = F.log(F.lit(by[k]["n"] / total))
        for i, c in enumerate(x):
            v = by[k][f"v{i}"] + SMOOTHING * most
            out = out - F.lit(0.5) * F.log(F.lit(2.0) * F.pi() * F.lit(v)) - (c - by[k][f"m{i}"]) * (c - by[k][f"m{i}"]) / (2 * v)
        return out

    return df.withColumn(score, 1 / (1 + F.exp(likelihood(1) - likelihood(0))))


def massaging_m(df: DataFrame, group: str, target: str = "y") -> DataFrame:
    """How many labels of either group change: trunc((U P+ - P U+) / (P + U)), where + counts positives."""
    u, y = F.col(group).cast("long"), F.col(target).cast("long")
    sums = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in {"u": u, "uy": u * y, "p": 1 - u, "py": (1 - u) * y}.items()))
    m = (F.col("u") * F.col("py") - F.col("p") * F.col("uy")) / (F.col("u") + F.col("p")).cast("double")
    return sums.select("u", "uy", "p", "py", F.when(F.col("u") + F.col("p") > 0, F.when(m >= 0, F.floor(m)).otherwise(F.ceil(m))).cast("int").alias("m"))


def massaging_candidates(df: DataFrame, group: str, key: str, features: Sequence[str], target: str = "y", intended: bool = False) -> DataFrame:
    """Adds p0 and the rank of each row within (group, target).

    Promotion (group, negative) goes by p0 descending and demotion (rest, positive) ascending, as the published results do;
    ``intended`` turns both round: the most promising negatives and the least promising positives.  Ties go by key.
    """
    scored = naive_bayes_scores(df, features, target)
    sign = F.when(F.col(group) == 1, -1).otherwise(1) * (-1 if intended else 1)
    scored = scored.withColumn("_order", sign * F.col("p0"))
    out = ranked_by_range(scored, [group, target], [F.col("_order"), F.col(key)])
    return out.drop("_order")


def massage(df: DataFrame, group: str, key: str, features: Sequence[str], target: str = "y", out: str | None = None, intended: bool = False) -> DataFrame:
    """Flips the first m candidates of each side; m of 0 or less changes nothing."""
    m = massaging_m(df, group, target).first()["m"]
    if m is None:
        raise ValueError("both groups are empty")
    if m <= 0:
        return df.withColumn(out, F.col(target)) if out else df
    rows = massaging_candidates(df, group, key, features, target, intended)
    first = F.col("rank") <= m
    flipped = F.when((F.col(group) == 1) & (F.col(target) == 0) & first, 1).when((F.col(group) == 0) & (F.col(target) == 1) & first, 0).otherwise(F.col(target))
    return rows.withColumn(out or target, flipped.cast(dict(df.dtypes)[target])).drop("rank", "p0")


def reweigh(df: DataFrame, group: str, target: str = "y", within: Sequence[str] = ()) -> DataFrame:
    """n and weight n_s n_y / (n n_sy) of each (group, target) cell."""
    cells = df.groupBy(*within, group, target).agg(F.count(F.lit(1)).alias("n"))
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*(within or [F.lit(0)]), *keys))
    return cells.withColumn("weight", over(group) * over(target) * F.lit(1.0) / (over() * F.lit(1.0) * F.col("n")))


def weigh_one_vs_rest(df: DataFrame, protected: str, target: str = "y") -> DataFrame:
    """(grp, s, y, n, weight) of every group against the rest, from one aggregation by (protected, target)."""
    y = F.col(target).cast("int")
    groups = df.groupBy(F.col(protected).alias("grp")).agg(F.count_if(y == 0).alias("own0"), F.count_if(y == 1).alias("own1"))
    everyone = Window.partitionBy(F.lit(0))  # one row a group
    rest = {k: F.sum(f"own{k}").over(everyone) - F.col(f"own{k}") for k in (0, 1)}
    cells = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(k).alias("y"), n.alias("n")) for k in (0, 1) for s, n in ((1, F.col(f"own{k}")), (0, F.col(f"rest{k}")))))
    split = groups.withColumns({f"rest{k}": c for k, c in rest.items()}).select("grp", F.inline(cells))
    over = lambda *keys: F.sum("n").over(Window.partitionBy("grp", *keys))
    return split.where("n > 0").select("grp", "s", "y", "n", (over("s") * over("y") * F.lit(1.0) / (over() * F.lit(1.0) * F.col("n"))).alias("weight"))


def resample(df: DataFrame, group: str, key: str, target: str = "y", seed: int = 42) -> DataFrame:
    """Draws, with replacement and by weight, as many rows as the groups differ by: (draw, the columns of df).

    A draw's first hash picks a cell by its mass, the second a place within it: a join by (cell, place).
    """
    cells = reweigh(df, group, target)
    mass = F.col("n") * F.col("weight")
    order = Window.orderBy(group, target)  # four cells
    upto = F.sum(mass).over(order)
    cells = cells.select(group, target, "n", ((upto - mass) / F.sum(mass).over(Window.partitionBy(F.lit(0)))).alias("lo"), (upto / F.sum(mass).over(Window.partitionBy(F.lit(0)))).alias("hi"))
    draws = df.agg(F.abs(F.sum(F.col(group).cast("long")) - F.sum(1 - F.col(group).cast("long")))).first()[0] or 0
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (hash32("id", seed) / F.lit(float(1 << 32))).alias("u1"))
    second = hash32("draw", seed, 2246822519, 97) / F.lit(float(1 << 32))
    drawn = drawn.join(F.broadcast(cells), (F.col("u1") >= F.col("lo")) & (F.col("u1") < F.col("hi")))
    drawn = drawn.select("draw", F.col(group).alias("_s"), F.col(target).alias("_y"), (F.floor(second * F.col("n")) + 1).alias("_place"))
    rows = ranked_by_range(df, [group, target], [F.col(key)], "_rank")
    return drawn.join(rows, (F.col("_s") == F.col(group)) & (F.col("_y") == F.col(target)) & (F.col("_place") == F.col("_rank"))).select("draw", *df.columns)


def reweigh_and_append(df: DataFrame, group: str, key: str, target: str = "y", seed: int = 42) -> DataFrame:
    """The rows and the drawn ones after them."""
    return df.unionByName(resample(df, group, key, target, seed).drop("draw"))


def repair_all(df: DataFrame, group: str, key: str, features: Sequence[str], level: float = 1.0) -> DataFrame:
    """(key, feature, x, repaired) of each row and feature: a feature's distribution in each group moved to the median one.

    Rows of a group are cut by rank into as many quantiles as the smallest group has rows; a quantile's new value is the
    median over groups of its medians.  level 1 replaces values, lower ones mix old and new.  All features are ranked together;
    a quantile's median is read off at its middle ranks, so that no task holds a quantile, however few there are.
    """
    values = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x")) for f in features]
    long = df.select(F.col(key).alias("key"), F.col(group).alias("g"), F.inline(F.array(*values)))
    rows = ranked_by_range(long, ["feature", "g"], [F.col("x"), F.col("key")], "_rank", "_n")
    least = df.groupBy(group).count().agg(F.min("count")).first()[0] or 0
    rank, n = F.col("_rank") - 1, F.col("_n")
    rows = rows.withColumn("_q", F.expr(f"((_rank - 1) * {least}L) div _n"))
    # A quantile's ranks run from ceil(q n / least) to ceil((q + 1) n / least) - 1.
    ceiling = lambda x: F.expr(f"(({x}) * _n + {max(least, 1) - 1}L) div {max(least, 1)}L")
    low, high = ceiling("_q"), ceiling("_q + 1") - 1
    middle = (rank == F.shiftright(low + high, 1)) | (rank == F.shiftright(low + high + 1, 1))
    medians = rows.where(middle).groupBy("feature", "g", "_q").agg(F.avg("x").alias("_m")).groupBy("feature", "_q").agg(F.median("_m").alias("_new"))
    joined = rows.join(medians, ["feature", "_q"])
    return joined.select("key", "feature", "x", ((1 - level) * F.col("x") + level * F.col("_new")).alias("repaired"))


def repair(df: DataFrame, group: str, key: str, feature: str, level: float = 1.0, out: str = "repaired") -> DataFrame:
    """The rows with the repaired values of one feature beside the old ones."""
    new = repair_all(df, group, key, [feature], level).select(F.col("key").alias(f"_{key}"), F.col("repaired").alias(out))
    return df.join(new, F.col(key).eqNullSafe(F.col(f"_{key}"))).drop(f"_{key}")


def repaired(df: DataFrame, group: str, key: str, features: Sequence[str], level: float = 1.0) -> DataFrame:
    """The rows with all features replaced by repaired ones."""
    if not features:
        return df
    new = repair_all(df, group, key, features, level).groupBy("key").agg(*(F.max(F.when(F.col("feature") == f, F.col("repaired"))).alias(f"_new{i}") for i, f in enumerate(features)))
    joined = df.join(new.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({f: F.col(f"_new{i}") for i, f in enumerate(features)}).select(*df.columns)
