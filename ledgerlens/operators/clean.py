"""Safe cleaning: exact duplicates, negative amounts, unreadable timestamps; every removal is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import no_nan, parse_iso
from ..spec import TableSpec


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, once, so that no later operator meets it."""
    return df.select(*[no_nan(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def count_where(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each predicate."""
    return df.agg(*[F.count_if(p).alias(k) for k, p in predicates.items()])


def negative(spec: TableSpec) -> Column:
    """Whether the amount is below zero; a missing amount is not."""
    return F.coalesce(F.col(spec.amount) < 0, F.lit(False))


def clean(df: DataFrame, spec: TableSpec, *, strict_iso: bool = True, out: str = "event_timestamp") -> DataFrame:
    """Distinct rows with an amount not below zero (or missing) and a readable timestamp, which is added as `out`."""
    kept = df.dropDuplicates().where(~negative(spec))
    return kept.withColumn(out, parse_iso(F.col(spec.timestamp), strict_iso)).where(F.col(out).isNotNull())


def cleaning_stats(df: DataFrame, spec: TableSpec, *, strict_iso: bool = True) -> DataFrame:
    """One row: rows before, duplicates, then negative amounts, then unreadable timestamps removed, rows after.

    Rows are grouped by two 64-bit hashes, with what the later steps ask of them; only rows whose hashes meet are moved
    and compared in full.
    """
    hashes = _hashes(df, df.columns)
    flags = {"_bad": negative(spec), "_lost": parse_iso(F.col(spec.timestamp), strict_iso).isNull()}
    g = df.select(*[v.alias(k) for k, v in (hashes | flags).items()]).groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_bad").alias("_bad"), F.first("_lost").alias("_lost"))
    met = df.withColumns(hashes).join(g.where("_c > 1").select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    every = g.where("_c = 1").select("_c", "_bad", "_lost").unionByName(met.select("_c", *[v.alias(k) for k, v in flags.items()]))
    zero = F.lit(0).cast("long")
    return every.agg(F.coalesce(F.sum("_c"), zero).alias("initial_rows"), F.coalesce(F.sum(F.col("_c") - 1), zero).alias("duplicate_rows_removed"),
                     F.count_if("_bad").alias("invalid_amount_rows"), F.count_if(~F.col("_bad") & F.col("_lost")).alias("invalid_timestamp_rows"),
                     F.count_if(~F.col("_bad") & ~F.col("_lost")).alias("final_rows"))


def _hashes(df: DataFrame, names: list[str]) -> dict[str, Column]:
    return {"_h1": F.xxhash64(*[F.col(c) for c in names]), "_h2": F.xxhash64(F.lit(1), *[F.col(c) for c in reversed(names)])}


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row, duplicates: rows beyond the first of each group of equal keys (default: all columns); nulls are equal.

    Whole rows are grouped by two 64-bit hashes first; only rows whose hashes meet are moved and compared in full.
    """
    names = keys or df.columns
    rows = df
    if len(names) > 2:
        hashes = _hashes(df, names)
        met = df.select(*[v.alias(k) for k, v in hashes.items()]).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        rows = df.withColumns(hashes).join(met, ["_h1", "_h2"], "left_semi")
    g = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicates"))
