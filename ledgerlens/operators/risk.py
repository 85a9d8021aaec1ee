"""Rates, lift, stability and correlation of a labelled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import one, percent, rate, week_start, wilson
from ..spec import TableSpec
from .orderstat import bin_of, equal_frequency_edges, quantile_bin
from .profile import unpivot_categories


def _y(spec: TableSpec) -> Column:
    return one(F.col(spec.target))


def quantile_lift(df: DataFrame, spec: TableSpec, column: str, q: int = 20) -> DataFrame:
    """(quantile, low, high, row_count, positive_count, positive_rate, lift) of equal-frequency bins from 1.

    Lift is the bin's rate over that of all rows, those without a bin included; null where that is 0.
    """
    # q + 1 groups at most: the windows run over them
    g = quantile_bin(df, column, q, "_bin").groupBy("_bin").agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("row_count"), F.sum(_y(spec)).alias("positive_count"),
        F.count(_y(spec)).alias("_known"))
    whole = Window.partitionBy()
    g = g.withColumn("_all", rate(F.sum("positive_count").over(whole), F.sum("_known").over(whole))).where("_bin is not null")
    g = g.withColumns({"quantile": F.row_number().over(Window.orderBy("_bin")), "positive_rate": rate(F.col("positive_count"), F.col("row_count"))})
    return g.withColumn("lift", F.try_divide("positive_rate", "_all")).select("quantile", "low", "high", "row_count", "positive_count", "positive_rate", "lift")


def category_rates(df: DataFrame, spec: TableSpec, z: float = 1.96) -> DataFrame:
    """(feature, category, row_count, positive_count, positive_rate, ci_low, ci_high) with Wilson intervals; missing categories are left out."""
    g = unpivot_categories(df, spec, keep_null_group=False).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("row_count"), F.sum("_y").alias("positive_count"))
    low, high = wilson(F.col("positive_count"), F.col("row_count"), z)
    return g.withColumns({"positive_rate": rate(F.col("positive_count"), F.col("row_count")), "ci_low": low, "ci_high": high})


def rate_surface(df: DataFrame, spec: TableSpec, row: Column, col: Column, names: tuple[str, str] = ("row", "col"), *, wide: list | None = None) -> DataFrame:
    """(row, col, row_count, positive_percent) of two keys; rows with a null key are left out. wide: the columns' values, for one row a row key."""
    rows = df.select(row.alias(names[0]), col.alias(names[1]), _y(spec).alias("_y")).where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())
    if wide is not None:
        return rows.groupBy(names[0]).pivot(names[1], wide).agg(F.avg("_y") * 100)
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("row_count"), (F.avg("_y") * 100).alias("positive_percent"))


def bin_surface(df: DataFrame, spec: TableSpec, row: str, col: str, q: int = 10) -> DataFrame:
    """rate_surface over the equal-frequency bins of two columns."""
    edges = equal_frequency_edges(df, [row, col], q)
    at = [bin_of(F.col(c).cast("double"), edges[c]) for c in (row, col)]
    return rate_surface(df, spec, *at, (f"{row}_bin", f"{col}_bin"))


def weekly_stability(df: DataFrame, spec: TableSpec, window: int = 4) -> DataFrame:
    """(week, row_count, positive_count, positive_percent, rolling_percent, is_partial_week).

    Weeks start on Monday; the rolling mean is that of the last `window` weeks that have rows. The first and the last
    week are partial unless the data reach their ends.
    """
    ts = F.col(spec.timestamp)
    rows = df.where(ts.isNotNull()).select(week_start(ts).alias("week"), ts.alias("_t"), _y(spec).alias("_y"))
    g = rows.groupBy("week").agg(F.count(F.lit(1)).alias("row_count"), F.sum("_y").alias("positive_count"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    g = g.withColumn("positive_percent", percent(F.col("positive_count"), F.col("row_count")))
    # one row a week
    rolling = F.avg("positive_percent").over(Window.orderBy("week").rowsBetween(1 - window, 0))
    whole = Window.partitionBy()
    day = F.to_date
    partial = ((F.col("week") == F.min("week").over(whole)) & (day("_lo") > day("week"))) | ((F.col("week") == F.max("week").over(whole)) & (day("_hi") < F.date_add(day("week"), 6)))
    return g.withColumns({"rolling_percent": rolling, "is_partial_week": partial}).drop("_lo", "_hi")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs, each over the rows that have both, in one pass; null where a column is constant.

    Size from the regression's R squared and sign from the covariance, both of which skip incomplete pairs themselves;
    R squared is 1 by definition where one column is constant, and the covariance then 0.
    """
    rows = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = rows.agg(*[e for i, j in pairs for e in (F.regr_r2(columns[i], columns[j]).alias(f"_s{i}_{j}"), F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}"))])

    def r(i: int, j: int) -> Column:
        size, cov = (F.col(f"_{x}{min(i, j)}_{max(i, j)}") for x in "sc")
        return F.when(~((size == 1) & (cov == 0)), F.signum(cov) * F.sqrt(size))

    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i, j).alias("r"))
                                         for i, a in enumerate(columns) for j, b in enumerate(columns)])))


def strongest(corr: DataFrame, target: str) -> DataFrame:
    """The column (a) with the largest absolute correlation with the target; ties go to the first name."""
    return corr.where((F.col("b") == target) & (F.col("a") != target) & F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "a").limit(1).select("a", "r")


def value_range(df: DataFrame, column: str, name: str) -> DataFrame:
    """(metric, value): the largest less the smallest value."""
    return df.agg((F.max(column) - F.min(column)).alias("value")).select(F.lit(name).alias("metric"), "value")


def metric_ranges(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Ranges of lift over the amount's 20 bins, of category rates and of the rolling weekly rate."""
    return (value_range(quantile_lift(df, spec, spec.amount), "lift", "amount_lift_range")
            .unionByName(value_range(category_rates(df, spec), "positive_rate", "category_rate_range"))
            .unionByName(value_range(weekly_stability(df, spec), "rolling_percent", "weekly_rate_range")))
