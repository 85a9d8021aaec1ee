"""Exact de-duplication by content hash [DataFrame operations only].

Rows are grouped by the 128-bit MD5 of the normalised text; byte comparison inside the groups (grouping by hash and
text together, collapsed before the shuffle) finds hash collisions, whose rows are then grouped by the text itself.
Only hashes, lengths and ids travel otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    norm = normalised(docs[text_col])
    return docs.select(docs[id_col].alias("_id"), F.coalesce(F.length(docs[text_col]), F.lit(0)).alias("_n"),
                       digest(norm).alias("_h"), F.sha2(norm, 256).alias("_sha"), norm.alias("_norm"))


def _collided(keyed: DataFrame) -> DataFrame:
    """Hashes that two different texts share: bytes are compared inside each group."""
    return (keyed.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_h"))


def _ranked(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """One row per distinct (text class, id, length), with its number of repeated rows and its class's winner."""
    keyed = _keyed(docs, id_col, text_col, digest)
    base = stage(keyed.select("_id", "_n", "_h", "_sha"), "exact-base")
    collided = stage(_collided(keyed), "exact-collided")
    if collided.isEmpty():
        base = base.withColumn("_key", F.col("_h"))
    else:
        hit = keyed.join(collided, "_h", "left_semi").withColumn("_key", F.concat("_h", F.encode("_norm", "utf-8")))
        base = (base.join(collided, "_h", "left_anti").withColumn("_key", F.col("_h"))
                .unionByName(hit.select("_id", "_n", "_h", "_sha", "_key")))
    rows = base.groupBy("_key", "_h", "_id", "_n", "_sha").agg(F.count(F.lit(1)).alias("_same"))
    order = F.struct((-F.col("_n")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"))
    # staged, so that the join is of plain exchanges and a hot class can be split
    best = stage(rows.groupBy("_key").agg(F.sum("_same").alias("_size"), F.min(order).alias("_best")).where("_size > 1"), "exact-best")
    out = rows.join(best, "_key", "left")
    alone = F.col("_size").isNull()
    return out.select("_key", "_h", "_id", "_n", "_sha", "_same",
                      F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
                      F.when(alone, F.col("_id")).otherwise(F.col("_best.c")).alias("_keep_id"),
                      (alone | ((F.col("_best.a") == -F.col("_n")) & F.col("_best.c").eqNullSafe(F.col("_id")))).alias("_kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = md5_128) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of equal texts the row with the most code points in the original
    text stays, then the smallest id. Null text counts as empty; a null id loses to any other; of rows that repeat the
    winner's id and length, one is flagged kept. Empty tables give empty results; further columns are ignored; a text of
    any length is hashed whole and moves once at most, combined with its copies in each task.
    """
    r = _ranked(docs, id_col, text_col, digest)
    return (r.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))))
            .select(F.col("_id").alias(id_col), F.col("_keep_id").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
                    (F.col("_kept") & (F.col("_i") == 1)).alias("kept"), F.col("_sha").alias("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = md5_128) -> DataFrame:
    """The rows that stay, all columns as they were; see exact_groups for which. Of repeated winners one row stays."""
    keep = stage(_ranked(docs, id_col, text_col, digest).where("_kept").select("_key", "_h", "_id", "_n", "_sha", "_same"), "exact-keep")
    norm = normalised(docs[text_col])
    marked = docs.select(F.struct("*").alias("_row"), docs[id_col].alias("_k_id"), digest(norm).alias("_k_h"), F.sha2(norm, 256).alias("_k_sha"),
                         F.coalesce(F.length(docs[text_col]), F.lit(0)).alias("_k_n"))

    def chosen(which: DataFrame) -> DataFrame:
        return marked.join(which, (marked["_k_h"] == which["_h"]) & (marked["_k_sha"] == which["_sha"]) & (marked["_k_n"] == which["_n"])
                           & marked["_k_id"].eqNullSafe(which["_id"]), "left_semi")

    out, again = chosen(keep.where("_same = 1")), keep.where("_same > 1")
    if not again.isEmpty():
        out = out.unionByName(chosen(again).dropDuplicates(["_k_id", "_k_h", "_k_sha", "_k_n"]))
    return out.select("_row.*")
