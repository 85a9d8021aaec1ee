"""Schema contract and column listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent
from ..spec import TableSpec


def check_schema(columns: Iterable[str], expected: Iterable[str], *, strict: bool = True) -> dict[str, list[str]]:
    """Missing and unexpected names, sorted; order does not matter. Strict: either raises."""
    have, want = set(columns), set(expected)
    found = {"missing": sorted(want - have), "unexpected": sorted(have - want)}
    if strict:
        if found["missing"]:
            raise ValueError(f"expected columns are missing: {found['missing']}")
        if found["unexpected"]:
            raise ValueError(f"unexpected columns: {found['unexpected']}")
    return found


def schema_differences(df: DataFrame, expected: Iterable[str]) -> DataFrame:
    """(kind, column) of each missing or unexpected column; no row if there is none."""
    found = check_schema(df.columns, expected, strict=False)
    rows = [(k, c) for k, names in found.items() for c in names]
    return df.sparkSession.createDataFrame(rows, "kind string, column string")


def select_gold(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The published columns in their order, the target as a byte."""
    return df.select(*[F.col(c).cast("tinyint").alias(c) if c == spec.target else F.col(c) for c in spec.gold])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, missing, distinct) of each column, exactly, in one pass.

    Rows are unpivoted to (column, value as text) and combined before the one shuffle, so what moves is the distinct
    values. Zeros of either sign are one value.
    """
    zero = {c for c, t in df.dtypes if t in ("double", "float")}
    value = {c: (F.col(c) + F.lit(0.0) if c in zero else F.col(c)).cast("string") for c in columns}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), value[c].alias("_v")) for c in columns])))
    g = long.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy("column").agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("missing"), F.count("_v").alias("distinct"))


def schema_profile(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """(column, dtype, missing_count, missing_percent, unique_count) of each column, in one pass.

    Exact counts move every distinct value once; at scale `approx` moves a sketch a column instead.
    """
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    if not approx:
        found = value_counts(df, df.columns)
        none = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string").join(found, "column", "left")  # an empty table has its columns too
        return none.select("column", F.element_at(kinds, F.col("column")).alias("dtype"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing_count"),
                           percent(F.col("missing"), F.col("rows")).alias("missing_percent"), F.coalesce("distinct", F.lit(0)).cast("long").alias("unique_count"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"m{i}"), F.approx_count_distinct(F.col(c)).alias(f"u{i}")]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"m{i}").alias("missing_count"),
                 percent(F.col(f"m{i}"), F.col("n")).alias("missing_percent"), F.col(f"u{i}").alias("unique_count"))
        for i, (c, t) in enumerate(df.dtypes)])))
