"""Mixing sources to target weights by hash-threshold histograms [DataFrame operations only].

Every document gets a 60-bit hash. Sizes are summed by (source, hash bucket); per source the bucket in which the
running sum crosses the budget is refined, twelve bits at a time, until one hash value is left. Documents below the
final threshold get one repeat more than the rest. Nothing is sorted but the bucket sums and the list of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(id_col: Column) -> Column:
    """First 60 bits of the MD5 of the id's text; a null id hashes as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source (_source, _size) its target.

    Sources in code-point order, null last, take the weights in turn; together they share `share` of all sizes. A
    target stops at `most` times its source's size; the excess is shared anew by weight until none is above. One row a
    source, so the windows here run over the list of sources only.
    """
    listed = Window.orderBy(F.col("_source").isNull(), "_source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(listed) - 1) % len(weights) + 1)
    t = sizes.withColumn("_w", w).withColumn("_cap", most * F.col("_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"_all": F.sum("_size").over(whole), "_all_w": F.sum("_w").over(whole),
                       "_cap_b": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_w_b": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    t = t.withColumn("_full", F.col("_cap") * (F.col("_all_w") - F.col("_w_b")) <= (share * F.col("_all") - F.col("_cap_b")) * F.col("_w"))
    t = t.withColumns({"_cap_f": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole),
                       "_w_f": F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0)).over(whole)})
    free = (share * F.col("_all") - F.col("_cap_f")) / (F.col("_all_w") - F.col("_w_f"))
    return t.select("_source", "_size", F.when(F.col("_full"), F.col("_cap")).otherwise(free * F.col("_w")).alias("_target"))


def _thresholds(base: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repeats, and the hash up to which (inclusive) documents get one more; -1 for none."""
    state = targets.select("_source", "_size", "_target",
                           F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(F.lit(0)).cast("long").alias("_times"))
    state = state.withColumns({"_need": F.col("_target") - F.col("_times") * F.col("_size"), "_at": F.lit(0).cast("long")})
    state = stage(state, "mix-state")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = state.select(F.col("_source").alias("_s"), "_at", "_need")
        mine = base.join(at, base["_source"].eqNullSafe(F.col("_s"))).select("_source", "_w", "_h", "_at", "_need")
        if level:
            mine = mine.where(F.shiftright("_h", shift + BITS) == F.shiftright("_at", shift + BITS))
        sums = mine.groupBy("_source", "_need", F.shiftright("_h", shift).alias("_b")).agg(F.sum("_w").alias("_sum"))
        upto = Window.partitionBy("_source").orderBy("_b")  # at most 2^BITS rows a source
        cross = (sums.withColumn("_upto", F.sum("_sum").over(upto)).where(F.col("_upto") >= F.col("_need"))
                 .groupBy(F.col("_source").alias("_s")).agg(F.min_by(F.struct("_b", "_upto", "_sum"), F.col("_b")).alias("_x")))
        none = F.col("_x").isNull()
        # what the buckets below take is settled; the rest is sought inside the crossing bucket
        state = stage(state.join(cross, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
            "_source", "_size", "_target", "_times",
            F.when(none, F.col("_need")).otherwise(F.col("_need") - (F.col("_x._upto") - F.col("_x._sum"))).alias("_need"),
            F.when(none, F.col("_at")).otherwise(F.shiftleft(F.col("_x._b"), shift)).alias("_at"),
            F.coalesce(F.col("_x._sum"), F.lit(0)).alias("_last")), "mix-state")
    # the last bucket is one hash value: it is taken if that brings the sum nearer
    return state.select("_source", "_size", "_target", "_times",
                        F.when(F.col("_last") / 2 <= F.col("_need"), F.col("_at")).otherwise(F.col("_at") - 1).alias("_upto"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    A document is taken a whole number of times: floor(target / source size) or one more, so never above `most` times
    its size for whole `most`. A source's taken words are within half of its largest single hash group of its target.
    The hash is of the id, so rows that repeat an id go together; null ids share one hash, a null source is a source of
    its own, null text has size 0, empty tables give no rows, other columns are ignored, and a text of any length is
    counted whole. The same rows give the same mix, in any order and partitioning.
    """
    base, cut = _plan(docs, id_col, text_col, source_col, weights, share, most)
    return base.join(cut, F.col("_source").eqNullSafe(F.col("_s"))).select(
        F.col("_id").alias(id_col), F.col("_w").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), _taken().alias("taken"))


def _taken() -> Column:
    return F.col("_w") * (F.col("_times") + (F.col("_h") <= F.col("_upto")).cast("long"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    base = stage(docs.select(docs[id_col].alias("_id"), docs[source_col].alias("_source"), word_count(docs[text_col]).alias("_w"),
                             doc_hash(docs[id_col]).alias("_h")), "mix-base")
    sizes = base.groupBy("_source").agg(F.sum("_w").alias("_size"))
    return base, _thresholds(base, source_targets(sizes, weights, share, most)).withColumnRenamed("_source", "_s")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents that the mix takes, all columns as they were, then mix_size, mix_target and mix_taken; see mix_sources."""
    _, cut = _plan(docs, id_col, text_col, source_col, weights, share, most)
    packed = docs.select(F.struct("*").alias("_row"), docs[source_col].alias("_source"), word_count(docs[text_col]).alias("_w"), doc_hash(docs[id_col]).alias("_h"))
    out = packed.join(cut, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_taken", _taken()).where("_taken > 0")
    return out.select("_row.*", F.col("_w").alias("mix_size"), F.col("_target").alias("mix_target"), F.col("_taken").alias("mix_taken"))
