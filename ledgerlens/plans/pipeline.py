"""The three workflows as functions from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as P
from ..operators import risk as R
from ..operators.observe import clean_observed, observe_raw
from ..operators.schema import check_schema, schema_differences, schema_profile, select_gold
from ..sources.io import read_transactions, verify, work_dir
from ..sources.snapshots import Snapshot, commit, draft_folder, latest, open_snapshot, publish
from ..spec import GOLD, RAW, RAW_SCHEMA, TableSpec
from . import report


@dataclass(frozen=True)
class Published:
    gold: DataFrame
    report: DataFrame
    checks: DataFrame
    snapshot: Snapshot


def to_gold(raw: DataFrame, spec: TableSpec = RAW) -> DataFrame:
    """Validated, cleaned rows in the published columns."""
    check_schema(raw.columns, RAW_SCHEMA.names)
    return select_gold(C.clean(C.normalise(raw), spec), spec)


def run_cleaning(spark: SparkSession, raw_path: str, gold_path: str, report_path: str, *, fmt: str = "csv", spec: TableSpec = RAW) -> Published:
    """Read, validate, clean, publish the table, then the report, and verify what was written.

    The input is parsed once, into a staged table; counts of both tables are observed while they are written. Table and
    report are published as snapshots: readers of older versions keep them. A Conflict tells of another run in between.
    """
    base = latest(spark, gold_path)
    watched, raw_counts = observe_raw(read_transactions(spark, raw_path, RAW_SCHEMA, fmt=fmt), spec)
    staged = work_dir(spark, "parsed")
    watched.write.parquet(staged)
    raw = spark.read.schema(watched.schema).parquet(staged)
    kept, clean_counts = clean_observed(raw, spec)
    folder, run_id = draft_folder(gold_path)
    select_gold(kept, spec).write.parquet(folder)
    before, after = raw_counts(), clean_counts()
    facts = {"rows": after.final_rows, "columns": len(spec.gold), "missing_values_total": sum(after.missing.values()), "positive_rows": after.positive_rows}
    made = commit(spark, gold_path, folder, run_id, facts, base=base.version if base else 0)
    gold = open_snapshot(spark, gold_path, made.version)
    publish(report.quality_report(raw, gold, spec, counts=(before, after)), report_path, run_id=run_id)
    return Published(gold, open_snapshot(spark, report_path), verify(gold, facts, spec.target), made)


def profile_raw(raw: DataFrame, spec: TableSpec = RAW) -> dict[str, DataFrame]:
    """The first look at a raw table, each part a table; quantiles and edges of bins are selected at once."""
    return {
        "overview": P.overview(raw, spec), "schema": schema_profile(raw), "classes": P.class_distribution(raw, spec),
        "numeric": P.describe(raw, list(spec.numerics), [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), "missing_by_class": P.missing_by_class(raw, spec),
        "identifiers": P.cardinality(raw, list(spec.identifiers)), "leakage": P.presence_by_class(raw, spec, list(spec.suspects)),
        "categories": P.category_profile(raw, spec), "hours": P.rate_by_time(raw, spec, "hour"), "weekdays": P.rate_by_time(raw, spec, "weekday"),
    }


def profile_gold(gold: DataFrame, spec: TableSpec = GOLD) -> dict[str, DataFrame]:
    """The second look, at a cleaned table."""
    return {
        "differences": schema_differences(gold, spec.gold), "overview": P.overview(gold, spec, parsed=True), "schema": schema_profile(gold),
        "missingness": P.missingness_bias(gold, spec, spec.incomplete), "ecdf": report.series_ecdf(gold, spec), "lift": R.quantile_lift(gold, spec, spec.amount),
        "categories": R.category_rates(gold, spec), "hour_weekday": report.series_hour_weekday(gold, spec), "weekly": R.weekly_stability(gold, spec),
        "correlation": R.correlation(gold, [*spec.numerics, spec.target]), "surface": report.series_surface(gold, spec), "findings": report.findings(gold, spec), "advice": report.advice(gold, spec),
    }


def timed(spec: TableSpec, column: str) -> TableSpec:
    return replace(spec, timestamp=column)


def with_event_time(raw: DataFrame, spec: TableSpec = RAW) -> DataFrame:
    """raw with its parsed time as event_timestamp, nothing dropped."""
    from ..functions.columns import parse_iso

    return raw.withColumn("event_timestamp", parse_iso(F.col(spec.timestamp)))
