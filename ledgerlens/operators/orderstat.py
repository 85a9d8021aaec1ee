"""Order statistics without a single-task sort.

Single ranks (quantiles, edges of bins, cuts of samples) are selected by radix histograms, see select.py. Where every value
gets its rank, the rank kernel counts equal values, cuts the value range into buckets by approximate quantiles, and adds the
buckets' offsets to running sums inside each bucket. The bounds only balance the work: ranks are exact whatever they are, but
they must be the same ones for offsets and running sums. Approximate quantiles depend on the order in which partitions meet, so
they are computed once, when the kernel is called, and kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash52
from ..sources.io import staged
from .select import keyed, select_quantiles, select_ranks

BUCKETS = 64


def ranked(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(_g, _x, _n, _upto, _total): each distinct non-null value of a group, its rows, those up to it, those in all.

    NaN counts as missing. Groups are few (classes, categories): one row of bounds for each is staged at the call, and
    broadcast where small.
    """
    x = F.col(column).cast("double")
    rows = df.select((F.col(by) if by else F.lit(0)).alias("_g"), F.when(~F.isnan(x), x).alias("_x")).where("_x is not null")
    counts = rows.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    bounds = staged(rows.groupBy("_g").agg(F.percentile_approx("_x", cuts, F.lit(1000)).alias("_b"), F.count(F.lit(1)).alias("_total")), "rank-bounds")
    placed = counts.join(bounds.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).select(
        "_g", "_x", "_n", "_total", F.size(F.filter("_b", lambda b: b < F.col("_x"))).alias("_k"))
    sums = placed.groupBy("_g", "_k").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a group
    sums = sums.select(F.col("_g").alias("_h"), F.col("_k").alias("_l"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_g", "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(sums, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_k") == F.col("_l")))
            .select("_g", "_x", "_n", (F.col("_off") + F.sum("_n").over(inside)).alias("_upto"), "_total"))


def ecdf(df: DataFrame, column: str, by: str | None = None, *, max_points: int | None = None) -> DataFrame:
    """([by], value, cumulative): the share of a group's values that are at most `value`, for each distinct value.

    With max_points every group is thinned by rank to about that many points; its last point stays. Null values are left
    out, and so are null groups.
    """
    r = ranked(df.where(F.col(by).isNotNull()) if by else df, column, by)
    if max_points:
        step = F.greatest(F.lit(1), F.floor(F.col("_total") / max_points))
        r = r.where((F.floor(F.col("_upto") / step) > F.floor((F.col("_upto") - F.col("_n")) / step)) | (F.col("_upto") == F.col("_total")))
    return r.select(*([F.col("_g").alias(by)] if by else []), F.col("_x").alias("value"), (F.col("_upto") / F.col("_total")).alias("cumulative"))


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: str | None = None, *, approx: bool = False) -> DataFrame:
    """([by], quantiles): exact quantiles with linear interpolation, one array a group; approximate ones on request.

    Exact ones are selected when this is called, by a few passes over the column; of more than select.GROUPS groups by the
    rank kernel. Null and NaN are left out; a group of nothing else has no row.
    """
    name = [F.col("_g").alias(by)] if by else []
    x = F.col(column).cast("double")
    if approx:
        rows = df.select((F.col(by) if by else F.lit(0)).alias("_g"), x.alias("_x")).where("_x is not null and not isnan(_x)")
        return rows.groupBy("_g").agg(F.percentile_approx("_x", F.array(*map(F.lit, probabilities))).alias("quantiles")).select(*name, "quantiles")
    rows = keyed(df.select((F.col(by) if by else F.lit(0)).alias("_g"), x.alias("_x")))
    found = select_quantiles(rows, probabilities)
    if found is None:
        return _ranked_quantiles(df, column, probabilities, by).select(*name, "quantiles")
    schema = T.StructType([T.StructField("_g", rows.schema["_g"].dataType), T.StructField("quantiles", T.ArrayType(T.DoubleType()))])
    return df.sparkSession.createDataFrame(list(found.items()), schema).select(*name, "quantiles")


def _ranked_quantiles(df: DataFrame, column: str, probabilities: list[float], by: str | None) -> DataFrame:
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in probabilities]
    aggs = []
    for i, h in enumerate(at):
        aggs += [F.min(F.when(F.col("_upto") >= F.floor(h) + 1, F.col("_x"))).alias(f"lo{i}"),
                 F.min(F.when(F.col("_upto") >= F.ceil(h) + 1, F.col("_x"))).alias(f"hi{i}"), F.max(h - F.floor(h)).alias(f"f{i}")]
    r = ranked(df, column, by).groupBy("_g").agg(*aggs)
    return r.select("_g", F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}") for i in range(len(at))]).alias("quantiles"))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns, all in the same passes; a column without values is left out."""
    long = F.array(*[F.struct(F.lit(c).alias("_g"), F.col(c).cast("double").alias("_x")) for c in columns])
    return select_quantiles(keyed(df.select(F.inline(long))), probabilities)


def equal_frequency_edges(df: DataFrame, columns: list[str], q: int) -> dict[str, list[float]]:
    """Of each column the distinct edges of q equal-frequency bins, in order; none without values."""
    found = column_quantiles(df, columns, [i / q for i in range(q + 1)])
    return {c: sorted(set(found.get(c, []))) for c in columns}


def bin_of(x: Column, edges: list[float]) -> Column:
    """Number from 0 of the right-closed bin, the lowest edge in the first; null for null, NaN, and where there are no two edges."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    return F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(inner, lambda v: v < x)))


def quantile_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """One row: the distinct edges of q equal-frequency bins, in order."""
    return df.sparkSession.createDataFrame([(equal_frequency_edges(df, [column], q)[column],)], "edges array<double>")


def quantile_bin(df: DataFrame, column: str, q: int, out: str) -> DataFrame:
    """df with `out`, the equal-frequency bin of the column from 0.

    Bins are right-closed on interpolated edges, the lowest edge is in the first bin, equal edges are one; null stays
    null, and so does everything if the column is constant.
    """
    return df.withColumn(out, bin_of(F.col(column).cast("double"), equal_frequency_edges(df, [column], q)[column]))


def histogram(df: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """(bin, low, high, n) of equal-width bins from 1; the maximum is in the last; a constant column has one bin; empty bins are left out."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("_x"))
    ends = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)).cast("int") + 1)
    return (rows.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("_lo") + width * F.col("bin")).alias("high"), "n"))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows in an order whose last key should break ties."""
    return df.orderBy(*order).limit(k)


def sample_n(df: DataFrame, n: int, seed: int, id_col: str, *, by: str | None = None, clamp: bool = False) -> DataFrame:
    """Exactly n rows (of each group), those with the least hash of seed and id: the same rows for any partitioning.

    Too few rows raise unless clamp. The cut is selected on the hash, so no task sorts a whole group and no row moves;
    rows that tie at the cut are taken by id.
    """
    h = hash52(seed, F.col(id_col))
    g = F.col(by) if by else F.lit(0)
    rows = df.select(g.alias("_g"), h.alias("_k"))
    got = select_ranks(rows, lambda total: [min(n, total) - 1])
    if got is None:
        raise ValueError("too many groups to sample each of them")
    if not clamp and n > 0 and (any(total < n for total in got.total.values()) or not (got.total or by)):
        raise ValueError(f"fewer than {n} rows")
    cuts = [(group, *got.at[group][min(n, total) - 1][:2]) for group, total in got.total.items() if n > 0]
    schema = T.StructType([T.StructField("_cg", rows.schema["_g"].dataType), T.StructField("_cut", T.LongType()), T.StructField("_below", T.LongType())])
    cut = df.sparkSession.createDataFrame(cuts, schema)
    j = df.withColumn("_h", h).join(F.broadcast(cut), g.eqNullSafe(F.col("_cg")))  # a row a group
    sure = j.where(F.col("_h") < F.col("_cut"))
    tie = Window.partitionBy("_cg").orderBy(F.col(id_col))  # rows of one hash value
    edge = j.where(F.col("_h") == F.col("_cut")).withColumn("_r", F.row_number().over(tie)).where(F.col("_r") <= n - F.col("_below")).drop("_r")
    return sure.unionByName(edge).select(*df.columns)
