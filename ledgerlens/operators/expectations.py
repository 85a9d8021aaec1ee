"""Expectations of a table, compiled: one aggregate for what holds of the whole, one predicate for what holds of a row.

Row rules (domain, range, order of two columns, presence) are columns that say which rows break them; rows that break any
are written apart with the names of the rules. Table rules (share of nulls, uniqueness) are judged from counts. All counts
of all rules but uniqueness come out of one aggregate without a shuffle of rows; uniqueness adds one grouping of hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import duplicate_count


@dataclass(frozen=True)
class Expectation:
    """A rule by name. `broken` (of rows) or `most_nulls` (percent) or `unique` (columns) says which kind it is."""

    name: str
    broken: Callable[[], Column] | None = None
    column: str | None = None
    most_nulls: float | None = None
    unique: tuple[str, ...] = ()


def in_domain(column: str, values: tuple, *, name: str | None = None) -> Expectation:
    """Values are among these; nulls are no value."""
    return Expectation(name or f"{column} in domain", lambda: F.col(column).isNotNull() & ~F.col(column).isin(*values))


def in_range(column: str, low: float | None = None, high: float | None = None, *, name: str | None = None) -> Expectation:
    """Numbers (and times) are low or more and high or less; NaN is out of range, null is no value."""
    def broken() -> Column:
        x = F.col(column)
        out = F.isnan(x.try_cast("double"))
        if low is not None:
            out = out | (x < F.lit(low))
        if high is not None:
            out = out | (x > F.lit(high))
        return x.isNotNull() & F.coalesce(out, F.lit(False))

    return Expectation(name or f"{column} in range", broken)


def present(column: str, *, name: str | None = None) -> Expectation:
    return Expectation(name or f"{column} present", lambda: F.col(column).isNull())


def in_order(first: str, second: str, *, name: str | None = None) -> Expectation:
    """`first` is not above `second` where both are there."""
    return Expectation(name or f"{first} up to {second}", lambda: F.coalesce(F.col(first) > F.col(second), F.lit(False)))


def matches(column: str, pattern: str, *, name: str | None = None) -> Expectation:
    """Texts match the pattern; null is no text."""
    return Expectation(name or f"{column} matches", lambda: F.coalesce(~F.col(column).rlike(pattern), F.lit(False)))


def nulls_at_most(column: str, percent: float, *, name: str | None = None) -> Expectation:
    return Expectation(name or f"{column} nulls", column=column, most_nulls=percent)


def unique(*columns: str, name: str | None = None) -> Expectation:
    """No two rows share these columns; nulls are equal."""
    return Expectation(name or f"{', '.join(columns)} unique", unique=columns)


def _checked(rules: list[Expectation]) -> list[Expectation]:
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"rules share a name: {sorted({n for n in names if names.count(n) > 1})}")
    for r in rules:
        if (r.broken is not None) + (r.most_nulls is not None) + bool(r.unique) != 1:
            raise ValueError(f"rule {r.name} is not of one kind")
    return rules


def judge(df: DataFrame, rules: list[Expectation]) -> DataFrame:
    """(rule, rows, broken, value, passed) of every rule: rows that break it (repeats beyond the first for unique); value is the percent of such rows.

    A row rule passes if no row breaks it, a share of nulls if it is not above its bound. An empty table passes all.
    """
    _checked(rules)
    plain = [r for r in rules if not r.unique]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(r.broken() if r.broken else F.col(r.column).isNull()).alias(f"_{i}") for i, r in enumerate(plain)])
    for i, r in enumerate(r for r in rules if r.unique):
        row = row.crossJoin(F.broadcast(duplicate_count(df, list(r.unique)).withColumnRenamed("duplicates", f"_u{i}")))  # one row each
    told = [(r, F.col(f"_{i}")) for i, r in enumerate(plain)] + [(r, F.col(f"_u{i}")) for i, r in enumerate(r for r in rules if r.unique)]
    value = lambda n: F.coalesce(F.try_divide(n * 100.0, F.col("_n")), F.lit(0.0))
    return row.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("_n").alias("rows"), n.alias("broken"), value(n).alias("value"),
                                                  (value(n) <= F.lit(float(r.most_nulls or 0.0))).alias("passed")) for r, n in told])))


def _marked(df: DataFrame, rules: list[Expectation]) -> DataFrame:
    rows = [r for r in _checked(rules) if r.broken]
    if not rows:
        return df.withColumn("_broken", F.array().cast("array<string>"))
    return df.withColumn("_broken", F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rows])))


def quarantine(df: DataFrame, rules: list[Expectation], column: str = "broken_rules") -> tuple[DataFrame, DataFrame]:
    """The rows that break no row rule, and the others with the names of those that they break.

    Neither moves a row; together they are the table. Table rules set no row apart. A column of that name is an error.
    """
    if column in df.columns:
        raise ValueError(f"the table has a column {column}")
    marked = _marked(df, rules)
    return marked.where(F.size("_broken") == 0).drop("_broken"), marked.where(F.size("_broken") > 0).withColumnRenamed("_broken", column)
