"""Reports and chart series: thin tables over the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import label, parse_iso, weekday
from ..operators import clean as C
from ..operators import orderstat as O
from ..operators import profile as P
from ..operators import risk as R
from ..operators.observe import CleanCounts, RawCounts
from ..spec import TableSpec
from .modeling import flags


def _section(df: DataFrame, section: str, item: Column, metrics: list[str]) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"),
                     F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def _counted(spark: SparkSession, raw: RawCounts, after: CleanCounts, spec: TableSpec) -> list[DataFrame]:
    """The sections that observed counts hold in full: a few rows each."""
    first = raw.rows - after.distinct_rows
    rows = [("cleaning", "rows", m, v) for m, v in (("initial_rows", raw.rows), ("duplicate_rows_removed", first), ("invalid_amount_rows", after.negative_amounts),
                                                    ("invalid_timestamp_rows", after.unreadable_times), ("final_rows", after.final_rows))]
    rows += [("gold", "rows", "rows_after", after.final_rows), ("gold", "rows", "positive_after", after.positive_rows)]
    for c, n in raw.missing.items():
        if n:
            rows += [("missing", c, "missing_count", n), ("missing", c, "missing_percent", n / raw.rows * 100)]
    for y, n in raw.classes.items():
        rows += [("target", None if y is None else str(y), "row_count", n), ("target", None if y is None else str(y), "percentage", n / raw.rows * 100)]
    rows.append(("decision", f"missing kept: {spec.incomplete}", "rows", after.missing[spec.incomplete]))
    return [spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "section string, item string, metric string, value double")]


def quality_report(raw: DataFrame, gold: DataFrame, spec: TableSpec, *, counts: tuple[RawCounts, CleanCounts] | None = None) -> DataFrame:
    """(section, item, metric, value) of a cleaning run: rows, removals, missing values, classes, top kinds, numeric summary, decisions.

    With counts observed while the tables were written only the kinds and the numeric summary read a table.
    """
    if counts:
        parts = _counted(raw.sparkSession, *counts, spec)
    else:
        after = gold.agg(F.count(F.lit(1)).alias("rows_after"), F.coalesce(F.sum(F.col(spec.target).cast("long")), F.lit(0)).alias("positive_after"),
                         F.count_if(F.col(spec.incomplete).isNull()).alias("rows"))
        parts = [
            _section(C.cleaning_stats(raw, spec), "cleaning", F.lit("rows"), ["initial_rows", "duplicate_rows_removed", "invalid_amount_rows", "invalid_timestamp_rows", "final_rows"]),
            _section(after, "gold", F.lit("rows"), ["rows_after", "positive_after"]),
            _section(after, "decision", F.lit(f"missing kept: {spec.incomplete}"), ["rows"]),
            _section(P.missing_summary(raw).where("missing_count > 0"), "missing", F.col("column"), ["missing_count", "missing_percent"]),
            _section(P.class_distribution(raw, spec), "target", F.col(spec.target), ["row_count", "percentage"]),
        ]
    top = O.top_k(P.type_summary(raw, spec, spec.kind), [F.desc("positive_rate"), F.desc("row_count"), spec.kind], 10)
    parts += [_section(top, "kind", F.col(spec.kind), ["row_count", "positive_rate"]),
              _section(P.describe(raw, list(spec.numerics), [0.5]), "numeric", F.col("feature"), ["mean", "std", "min", "p50", "max"]), _decisions(raw, gold, spec)]
    return reduce(DataFrame.unionByName, parts)


def _decisions(raw: DataFrame, gold: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns that cleaning left out, by their role, and those it added beside the parsed time; read from the tables' columns."""
    gone = [c for c in raw.columns if c not in gold.columns]
    role = {"identifiers dropped": [c for c in gone if c in spec.identifiers], "label-derived dropped": [c for c in gone if c in spec.suspects],
            "columns added": [c for c in gold.columns if c not in raw.columns]}
    rows = [("decision", ": ".join([k, ", ".join(sorted(names))]) if names else k, "columns", float(len(names))) for k, names in role.items()]
    return raw.sparkSession.createDataFrame(rows, "section string, item string, metric string, value double")


def _evidence(df: DataFrame, spec: TableSpec, more: dict[str, Column]) -> dict[tuple[str, str], float]:
    """(topic, metric) -> value of what one aggregate and one selection of the median say."""
    y, gap = F.col(spec.target).cast("int"), F.col(spec.incomplete).isNull()
    metrics = {
        "size.rows": F.count(F.lit(1)), "label.positive_percent": F.avg(y) * 100, "gaps.percent": F.avg(gap.cast("int")) * 100,
        "gaps.positive_percent": F.avg(F.when(gap, y)) * 100, "gaps.observed_positive_percent": F.avg(F.when(~gap, y)) * 100, "amount.mean": F.avg(spec.amount), **more,
    }
    row = df.agg(*[v.cast("double").alias(f"_{i}") for i, v in enumerate(metrics.values())]).first()  # one row of numbers
    out = {tuple(k.split(".", 1)): v for k, v in zip(metrics, row)}
    median = O.column_quantiles(df, [spec.amount], [0.5]).get(spec.amount)
    out["amount", "median"] = median[0] if median else None
    mean = out["amount", "mean"]
    out["amount", "mean_to_median"] = mean / median[0] if median and median[0] and mean is not None else None
    out["size", "columns"] = float(len(df.columns))
    a, b = out["gaps", "positive_percent"], out["gaps", "observed_positive_percent"]
    out["gaps", "positive_difference"] = abs(a - b) if a is not None and b is not None else None
    return out


def _rows(df: DataFrame, found: dict[tuple[str, str], float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(t, m, v) for (t, m), v in found.items()], "topic string, metric string, value double")


def findings(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(topic, metric, value): what a cleaned table shows, in numbers; null where there is none."""
    ranges = R.metric_ranges(df, spec).select(F.lit("risk").alias("topic"), "metric", "value")
    top = R.strongest(R.correlation(df, [*spec.numerics, spec.target]), spec.target).select(F.lit("correlation").alias("topic"), F.concat(F.lit("strongest "), F.col("a")).alias("metric"), F.col("r").alias("value"))
    return _rows(df, _evidence(df, spec, {})).unionByName(ranges).unionByName(top)


def observations(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """(topic, metric, value): what a first look at a raw table counts."""
    y = F.col(spec.target).cast("int")
    found = _evidence(raw, spec, {
        "times.unreadable": F.count_if(parse_iso(F.col(spec.timestamp)).isNull()), "amount.negative": F.count_if(F.col(spec.amount) < 0), "amount.zero": F.count_if(F.col(spec.amount) == 0),
        "gaps.on_positive": F.count_if(F.col(spec.incomplete).isNull() & (y == 1)), **{f"leak.{c} on negative": F.count_if(F.col(c).isNotNull() & (y == 0)) for c in spec.suspects}})
    same = C.duplicate_count(raw).select(F.lit("repeats").alias("topic"), F.lit("rows").alias("metric"), F.col("duplicates").cast("double").alias("value"))
    wide = P.cardinality(raw, list(spec.identifiers))
    ids = wide.select(F.lit("identifiers").alias("topic"), F.concat(F.lit("values of "), F.col("column")).alias("metric"), F.col("unique_count").cast("double").alias("value"))
    twice = wide.where(F.col("column") == spec.id).select(F.lit("repeats").alias("topic"), F.lit("ids").alias("metric"), F.col("repeated_non_missing_values").cast("double").alias("value"))
    return _rows(raw, found).unionByName(same).unionByName(twice).unionByName(ids)


#: (metric, op, bound, action): what to do where evidence passes a bound. Callers give their own.
ADVICE = (
    ("label.positive_percent", "<", 10.0, "weight the classes and watch precision and recall"),
    ("gaps.percent", ">", 0.0, "fit fill values on training rows"),
    ("gaps.positive_difference", ">", 1.0, "check whether gaps give the label away"),
    ("amount.mean_to_median", ">", 1.5, "try the amount on a log scale"),
    ("amount.negative", ">", 0.0, "drop rows with a negative amount"),
    ("repeats.rows", ">", 0.0, "drop repeated rows"),
    ("times.unreadable", ">", 0.0, "drop rows without a readable time"),
    ("risk.weekly_rate_range", ">", 0.5, "cut the splits by time"),
)


def advice(df: DataFrame, spec: TableSpec, rules: tuple[tuple[str, str, float, str], ...] = ADVICE, *, raw: bool = False) -> DataFrame:
    """(metric, value, action) of the rules that the table's evidence (observations of a raw one, else findings) sets off."""
    found = observations(df, spec) if raw else findings(df, spec)
    held = found.select(F.concat_ws(".", "topic", "metric").alias("metric"), "value").where("value is not null")
    table = df.sparkSession.createDataFrame(list(rules), "metric string, op string, bound double, reason string")
    return flags(held, table).where("flagged").select("metric", "value", F.col("reason").alias("action"))


def series_missing(df: DataFrame) -> DataFrame:
    return P.missing_summary(df).where("missing_count > 0").select("column", "missing_percent")


def series_classes(df: DataFrame, spec: TableSpec) -> DataFrame:
    return P.class_distribution(df, spec).select(F.col(spec.target).cast("string").alias("label"), "row_count")


def series_histogram(df: DataFrame, spec: TableSpec, bins: int = 80) -> DataFrame:
    return O.histogram(df, spec.amount, bins)


def series_hours(df: DataFrame, spec: TableSpec, *, parsed: bool = False) -> DataFrame:
    return P.rate_by_time(df, spec, "hour", parsed=parsed).select("hour", (F.col("positive_rate") * 100).alias("positive_percent"))


def series_missingness(df: DataFrame, spec: TableSpec) -> DataFrame:
    b = P.missingness_bias(df, spec, spec.incomplete)
    overall = df.agg((F.avg(F.col(spec.target).cast("int")) * 100).alias("overall_percent"))
    return b.select("status", "row_percent", "positive_percent").crossJoin(F.broadcast(overall))  # one row


def series_ecdf(df: DataFrame, spec: TableSpec, points: int = 1000) -> DataFrame:
    return O.ecdf(df, spec.amount, spec.target, max_points=points).withColumn("log10_value", F.when(F.col("value") > 0, F.log10("value")))


def series_lift(df: DataFrame, spec: TableSpec) -> DataFrame:
    return R.quantile_lift(df, spec, spec.amount).select("quantile", "lift")


def series_errorbars(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(position, label, percent, below, above): categories from the lowest rate up."""
    from pyspark.sql import Window

    at = Window.orderBy("positive_rate", "feature", "category")  # one row a category
    return R.category_rates(df, spec).select((F.row_number().over(at) - 1).alias("position"), label(F.col("feature"), F.col("category")).alias("label"),
                                             (F.col("positive_rate") * 100).alias("percent"), ((F.col("positive_rate") - F.col("ci_low")) * 100).alias("below"),
                                             ((F.col("ci_high") - F.col("positive_rate")) * 100).alias("above"))


def series_hour_weekday(df: DataFrame, spec: TableSpec) -> DataFrame:
    ts = F.col(spec.timestamp)
    return R.rate_surface(df, spec, weekday(ts), F.hour(ts), ("weekday", "hour"))


def series_weekly(df: DataFrame, spec: TableSpec) -> DataFrame:
    return R.weekly_stability(df, spec)


def series_correlation(df: DataFrame, spec: TableSpec) -> DataFrame:
    return R.correlation(df, [*spec.numerics, spec.target])


def series_surface(df: DataFrame, spec: TableSpec) -> DataFrame:
    return R.bin_surface(df, spec, "spending_deviation_score", "geo_anomaly_score")
