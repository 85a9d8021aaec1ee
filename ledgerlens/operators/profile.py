"""Profiles of a labelled table; each is one grouped pass, returned as a lazy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import one, parse_iso, percent, rate, weekday
from ..spec import TableSpec
from .orderstat import quantiles
from .schema import check_schema, value_counts


def _y(spec: TableSpec) -> Column:
    return one(F.col(spec.target))


def long_values(row: DataFrame, names: list[str]) -> DataFrame:
    """One row of aggregates as (metric, value) with values as text."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in names])))


def overview(df: DataFrame, spec: TableSpec, *, parsed: bool = False, expected: list[str] | None = None) -> DataFrame:
    """(metric, value): size, time range, unreadable times, duplicates, negative and zero amounts, missing values, positives.

    With `expected` names also the missing and unexpected columns, comma-separated.
    """
    ts = F.col(spec.timestamp) if parsed else parse_iso(F.col(spec.timestamp))
    amount = F.col(spec.amount)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    shape = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    a = df.agg(F.count(F.lit(1)).alias("rows"), shape(F.min(ts)).alias("date_min"), shape(F.max(ts)).alias("date_max"),
               F.count_if(ts.isNull()).alias("invalid_timestamps"), F.count_if(amount < 0).alias("negative_amount_rows"),
               F.count_if(amount == 0).alias("zero_amount_rows"), missing.alias("missing_values_total"), F.coalesce(F.sum(_y(spec)), F.lit(0)).alias("positive_rows"),
               F.format_string("%.4f", F.avg(_y(spec)) * 100).alias("positive_percent"))
    from .clean import duplicate_count

    d = duplicate_count(df).withColumnRenamed("duplicates", "exact_duplicate_rows")
    i = duplicate_count(df, [spec.id]).withColumnRenamed("duplicates", "duplicate_ids")
    row = a.crossJoin(F.broadcast(d)).crossJoin(F.broadcast(i)).withColumn("columns", F.lit(len(df.columns)))  # one row each
    names = ["rows", "columns", "date_min", "date_max", "invalid_timestamps", "exact_duplicate_rows", "duplicate_ids",
             "negative_amount_rows", "zero_amount_rows", "missing_values_total", "positive_rows", "positive_percent"]
    if expected is not None:
        found = check_schema(df.columns, expected, strict=False)
        row = row.withColumns({f"{k}_columns": F.lit(", ".join(v)) for k, v in found.items()})
        names += [f"{k}_columns" for k in found]
    return long_values(row, names)


def class_distribution(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(target, row_count, percentage): null classes are left out, percentages are of all rows."""
    g = df.groupBy(_y(spec).alias(spec.target)).agg(F.count(F.lit(1)).alias("row_count"))
    all_ = F.sum("row_count").over(Window.partitionBy())  # one row a class
    return g.withColumn("percentage", percent(F.col("row_count"), all_)).where(F.col(spec.target).isNotNull())


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_percent)."""
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing_count"),
                                                percent(F.col(f"_m{i}"), F.col("_n")).alias("missing_percent")) for i, c in enumerate(df.columns)])))


def missing_total(df: DataFrame) -> DataFrame:
    return missing_summary(df).agg(F.sum("missing_count").alias("missing_values_total"))


def cardinality(df: DataFrame, columns: list[str], *, approx: bool = False) -> DataFrame:
    """(column, unique_count, cardinality_ratio, repeated_non_missing_values); nulls are no value."""
    if not approx:
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(value_counts(df, columns), "column", "left")  # an empty table has its columns too
        none = F.lit(0).cast("long")
        return every.select("column", F.coalesce("distinct", none).alias("unique_count"), rate(F.col("distinct"), F.col("rows")).alias("cardinality_ratio"),
                            F.coalesce(F.col("rows") - F.col("missing") - F.col("distinct"), none).alias("repeated_non_missing_values"))
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[e for i, c in enumerate(columns) for e in (F.approx_count_distinct(F.col(c)).alias(f"_u{i}"), F.count(F.col(c)).alias(f"_c{i}"))])
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_u{i}").alias("unique_count"), rate(F.col(f"_u{i}"), F.col("_n")).alias("cardinality_ratio"),
                                                (F.col(f"_c{i}") - F.col(f"_u{i}")).alias("repeated_non_missing_values")) for i, c in enumerate(columns)])))


def describe(df: DataFrame, columns: list[str], probabilities: list[float], *, approx: bool = False) -> DataFrame:
    """(feature, count, mean, std, min, pNN..., max) of each column; null and NaN are missing.

    All columns go through one pass of moments and one rank kernel, keyed by feature.
    """
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in columns])))
    rows = rows.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    a = rows.groupBy("feature").agg(F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    q = quantiles(rows, "_v", probabilities, "feature", approx=approx)
    name = [f"p{p * 100:g}".replace(".", "_") for p in probabilities]
    return a.join(q, "feature", "left").select("feature", "count", "mean", "std", "min", *[F.get("quantiles", F.lit(i)).alias(x) for i, x in enumerate(name)], "max")


def missing_by_class(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, target, row_count, missing_count, missing_percent) of the columns that miss any value; null classes are left out."""
    columns = [c for c in df.columns if c != spec.target]
    g = df.groupBy(_y(spec).alias("_y")).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)])
    r = g.select("_y", "_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing_count")) for i, c in enumerate(columns)])))
    any_ = F.sum("missing_count").over(Window.partitionBy("column"))  # one row a class
    return (r.withColumn("_any", any_).where("_any > 0 and _y is not null")
            .select("column", F.col("_y").alias(spec.target), F.col("_n").alias("row_count"), "missing_count", percent(F.col("missing_count"), F.col("_n")).alias("missing_percent")))


def presence_by_class(df: DataFrame, spec: TableSpec, suspects: list[str]) -> DataFrame:
    """(column, target, row_count, present, present_percent): a column that is there for one class only reveals the label."""
    g = df.where(F.col(spec.target).isNotNull()).groupBy(_y(spec).alias(spec.target)).agg(F.count(F.lit(1)).alias("row_count"), *[F.count(F.col(c)).alias(f"_p{i}") for i, c in enumerate(suspects)])
    r = g.select(spec.target, "row_count", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_p{i}").alias("present")) for i, c in enumerate(suspects)])))
    return r.select("column", spec.target, "row_count", "present", percent(F.col("present"), F.col("row_count")).alias("present_percent"))


def unpivot_categories(df: DataFrame, spec: TableSpec, *, keep_null_group: bool) -> DataFrame:
    """(feature, category, _y): one row for each row and categorical column."""
    r = df.select(_y(spec).alias("_y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in spec.categoricals])))
    return r if keep_null_group else r.where(F.col("category").isNotNull())


def category_profile(df: DataFrame, spec: TableSpec, *, keep_null_group: bool = True) -> DataFrame:
    """(feature, category, row_count, positive_count, row_percent, positive_rate) of every category, missing ones included by default."""
    g = unpivot_categories(df, spec, keep_null_group=True).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("_y"), F.lit(0)).alias("positive_count"))
    n = F.sum("row_count").over(Window.partitionBy("feature"))  # the categories of one feature
    g = g.withColumns({"row_percent": percent(F.col("row_count"), n), "positive_rate": rate(F.col("positive_count"), F.col("row_count"))})
    return g if keep_null_group else g.where(F.col("category").isNotNull())


def type_summary(df: DataFrame, spec: TableSpec, by: str) -> DataFrame:
    """(by, row_count, positive_count, amount_mean, amount_median, positive_rate); the null group is left out."""
    rows = df.where(F.col(by).isNotNull())
    a = rows.groupBy(by).agg(F.count(F.lit(1)).alias("row_count"), F.sum(_y(spec)).alias("positive_count"), F.avg(spec.amount).alias("amount_mean"))
    m = quantiles(rows, spec.amount, [0.5], by)
    return a.join(m, by, "left").select(by, "row_count", "positive_count", "amount_mean", F.get("quantiles", F.lit(0)).alias("amount_median"),
                                        rate(F.col("positive_count"), F.col("row_count")).alias("positive_rate"))


def rate_by_time(df: DataFrame, spec: TableSpec, part: str, *, parsed: bool = False) -> DataFrame:
    """(part, row_count, positive_count, positive_rate) by `hour` or `weekday` (Monday 0) of readable times."""
    ts = F.col(spec.timestamp) if parsed else parse_iso(F.col(spec.timestamp))
    rows = df.select(ts.alias("_t"), _y(spec).alias("_y")).where("_t is not null")
    key = {"hour": F.hour("_t"), "weekday": weekday(F.col("_t"))}[part]
    g = rows.groupBy(key.alias(part)).agg(F.count(F.lit(1)).alias("row_count"), F.sum("_y").alias("positive_count"))
    return g.withColumn("positive_rate", rate(F.col("positive_count"), F.col("row_count")))


def missingness_bias(df: DataFrame, spec: TableSpec, column: str) -> DataFrame:
    """(status, row_count, positive_count, row_percent, positive_percent) of rows where the column is missing or observed."""
    status = F.when(F.col(column).isNull(), "missing").otherwise("observed")
    g = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("row_count"), F.sum(_y(spec)).alias("positive_count"))
    n = F.sum("row_count").over(Window.partitionBy())  # two rows
    return g.withColumns({"row_percent": percent(F.col("row_count"), n), "positive_percent": percent(F.col("positive_count"), F.col("row_count"))})
