"""Rolling-origin folds from sufficient statistics: rows are read once, folds are prefix sums over blocks of time.

A fold trains on all blocks before its origin and tests on the block at it. Counts, sums and sums of squares of each
feature by class and block are enough for the training statistics of every fold, and for a choice of features inside it;
nothing of a fold depends on a row at or after its origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import no_nan, one
from ..spec import TableSpec


def block_statistics(df: DataFrame, spec: TableSpec, block: Column, features: list[str] | None = None) -> DataFrame:
    """(block, feature, n0, s0, q0, n1, s1, q1): rows, sum and sum of squares of each numeric feature of both classes, by block.

    Rows without a block or a label take no part; null and NaN are no values. Sums are of doubles less their column's
    overall mean, so that squares do not cancel.
    """
    names = list(features or spec.numerics)
    y = one(F.col(spec.target))
    rows = df.select(block.alias("block"), y.alias("y"), *[no_nan(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)]).where("block is not null and y is not null")
    centre = rows.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(len(names))]).first()  # one row of means
    long = rows.select("block", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"x{i}") - centre[f"m{i}"]).alias("x")) for i, c in enumerate(names)])))
    of = lambda k, e: F.coalesce(F.sum(F.when((F.col("y") == k) & F.col("x").isNotNull(), e)), F.lit(0.0))
    return long.groupBy("block", "feature").agg(*[a for k in (0, 1) for a in (F.count_if((F.col("y") == k) & F.col("x").isNotNull()).alias(f"n{k}"), of(k, F.col("x")).alias(f"s{k}"), of(k, F.col("x") * F.col("x")).alias(f"q{k}"))])


def rolling_folds(statistics: DataFrame, least: int = 1) -> DataFrame:
    """(origin, blocks, feature, n0, s0, q0, n1, s1, q1, test_rows, test_positive) of each fold: sums over all blocks before its origin.

    Folds have `least` training blocks or more. The windows run over one row a block and feature.
    """
    before = Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", "s0", "q0", "n1", "s1", "q1")}
    seen = F.count(F.lit(1)).over(before)
    return statistics.select(F.col("block").alias("origin"), seen.alias("blocks"), "feature", *sums.values(), (F.col("n0") + F.col("n1")).alias("test_rows"), F.col("n1").alias("test_positive")).where(F.col("blocks") >= least)


def fold_selection(folds: DataFrame, k: int) -> DataFrame:
    """(origin, feature, f_value, place, selected): features of each fold by their F value between the classes, the first k selected.

    The F value is that of a one-way analysis of variance over the fold's training rows; null where a class is empty or
    nothing varies inside the classes; ties and nulls go by name, nulls last.
    """
    n, s = F.col("n0") + F.col("n1"), F.col("s0") + F.col("s1")
    part = lambda i: F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}").cast("double"))
    between = part(0) + part(1) - F.try_divide(s * s, n.cast("double"))
    within = F.col("q0") + F.col("q1") - part(0) - part(1)
    f = F.when(within > 0, F.try_divide(between * (n - 2), within))
    place = F.row_number().over(Window.partitionBy("origin").orderBy(F.col("f_value").desc_nulls_last(), "feature"))  # a row a feature
    return folds.select("origin", "feature", f.alias("f_value")).withColumn("place", place).withColumn("selected", (F.col("place") <= k) & F.col("f_value").isNotNull())
