"""As-of retrieval: to each row of one table the latest row of another at or before its time, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstat import bin_of, equal_frequency_edges

#: Ranges of time that the rows of a key are cut into.
RANGES = 64


def _seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")).cast("double")


def retrieve_as_of(labels: DataFrame, features: DataFrame, key: str, time: str, names: list[str], *, feature_time: str | None = None,
                   tie: str | None = None, max_age: str | None = None, ranges: int = RANGES) -> DataFrame:
    """labels with the named columns of the latest feature row of the same key at or before the label's time, and `feature_time` of that row.

    Of feature rows with one key and time the one with the largest `tie` counts (without it, the one whose named columns
    are largest). Rows without a key or a time take no part: such labels have null features. With max_age (an interval,
    '30 days') older feature rows are null. A feature row that is taken is taken whole, its nulls too. Labels keep their
    columns and repeats; a named column that labels have already is an error.

    Both tables move once by key and range of time, so that a key with a large share of all rows is many groups; each
    group's last feature row is carried on to the ranges after it, over a table of one row a key and range. No row meets
    more than the features of its own range.
    """
    out_time = feature_time or f"{time}_feature"
    taken = [c for c in [*names, out_time] if c in labels.columns]
    if taken:
        raise ValueError(f"labels have columns of these names: {taken}")
    source_time = feature_time if feature_time and feature_time in features.columns else time
    # one edge list for both: equal shares of the labels, the features that no label can see included in the first range
    edges = equal_frequency_edges(labels.select(_seconds(F.col(time)).alias("t")), ["t"], ranges)["t"]
    place = lambda t: F.coalesce(bin_of(_seconds(t), edges), F.lit(0))
    feature = F.struct(F.col(source_time).alias("_at"), *([F.col(tie).alias("_tie")] if tie else []), *[F.col(n).alias(f"_v{i}") for i, n in enumerate(names)])
    left = labels.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    right = features.where(F.col(key).isNotNull() & F.col(source_time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(source_time).alias("_t"), F.lit(0).alias("_side"), feature.alias("_f"))
    known = left.where(F.col("_key").isNotNull() & F.col("_t").isNotNull())
    both = known.unionByName(right, allowMissingColumns=True).withColumn("_range", place(F.col("_t")))
    upto = Window.partitionBy("_key", "_range").orderBy("_t", "_side", "_f").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_inside", F.last("_f", ignorenulls=True).over(upto)).where("_side = 1")
    # at most `ranges` rows a key
    ends = both.groupBy("_key", "_range").agg(F.max("_f").alias("_end"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = within.join(carried, ["_key", "_range"], "left").select("_row", F.coalesce("_inside", "_carried").alias("_f"))
    lost = left.where(F.col("_key").isNull() | F.col("_t").isNull()).select("_row", F.lit(None).cast(found.schema["_f"].dataType).alias("_f"))
    out = found.unionByName(lost)
    if max_age:
        out = out.withColumn("_f", F.when(F.col("_f._at") >= F.col(f"_row.`{time}`") - F.expr(f"interval {max_age}"), F.col("_f")))
    return out.select("_row.*", *[F.col(f"_f._v{i}").alias(n) for i, n in enumerate(names)], F.col("_f._at").alias(out_time))
