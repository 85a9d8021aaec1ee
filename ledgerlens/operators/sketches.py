"""Mergeable sketches as columns: distinct counts and distributions by period, united over any periods without the rows.

A sketch is a binary of bounded size: HLL for distinct values (relative error about 1.04 / sqrt(2^lg_k)), KLL for
quantiles and shares (rank error about 1.3 % at k = 200, falling with k). Exact operators stay beside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 400


def sketch_by(df: DataFrame, period: Column, distinct: list[str] = (), numbers: list[str] = (), *, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """(period, rows, d_<column> ..., q_<column> ...): one row a period, sketches of its values; null and NaN are no values."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"d_{c}") for c in distinct]
    aggs += [F.kll_sketch_agg_double(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(k)).alias(f"q_{c}") for c in numbers]
    return df.groupBy(period.alias("period")).agg(*aggs)


def united(sketches: DataFrame, distinct: list[str] = (), numbers: list[str] = (), by: Column | None = None) -> DataFrame:
    """The sketches of several periods as one row, or one a group: the same as a sketch of all their rows, within its error."""
    g = sketches.groupBy(*([by.alias("period")] if by is not None else []))
    return g.agg(F.sum("rows").alias("rows"), *[F.hll_union_agg(f"d_{c}").alias(f"d_{c}") for c in distinct], *[F.kll_merge_agg_double(f"q_{c}").alias(f"q_{c}") for c in numbers])


def distinct_estimates(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """(period, column, estimate)."""
    return sketches.select("period", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.hll_sketch_estimate(f"d_{c}").alias("estimate")) for c in columns])))


def quantile_estimates(sketches: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(period, column, probability, value)."""
    rows = [F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double(F.col(f"q_{c}"), F.lit(float(p))).alias("value"))
            for c in columns for p in probabilities]
    return sketches.select("period", F.inline(F.array(*rows)))


def sketch_drift(reference: DataFrame, current: DataFrame, columns: list[str], q: int = 10) -> DataFrame:
    """(column, psi, ecdf_gap) of two one-row tables of sketches, by the reference's quantiles: no row of either table is read.

    Shares come from the sketches' ranks, so psi and gap carry their rank errors. A column without values on one side has
    null for both. q numbers of each column come to the driver, when this is called.
    """
    def numbers(df: DataFrame, exprs: list[Column]) -> list[float]:
        row = df.select(*[e.alias(f"_{i}") for i, e in enumerate(exprs)]).first()
        return list(row) if row else [None] * len(exprs)

    rows = []
    for c in columns:
        s = F.col(f"q_{c}")
        if not all(numbers(df, [F.kll_sketch_get_n_double(s)])[0] for df in (reference, current)):
            rows.append((c, None, None))
            continue
        cuts = sorted(set(numbers(reference, [F.kll_sketch_get_quantile_double(s, F.lit(i / q)) for i in range(1, q)])))
        a, b = (numbers(df, [F.kll_sketch_get_rank_double(s, F.lit(x)) for x in cuts]) for df in (reference, current))
        shares = [[max(y - x, 1e-6) for x, y in zip([0.0, *r], [*r, 1.0])] for r in (a, b)]
        rows.append((c, sum((y - x) * math.log(y / x) for x, y in zip(*shares)), max(abs(x - y) for x, y in zip(a, b))))
    return reference.sparkSession.createDataFrame(rows, "column string, psi double, ecdf_gap double")
