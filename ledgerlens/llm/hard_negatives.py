"""Hard negatives of anchor vectors by exact integer scores, with the method of the Four Russians.

A score is the inner product of an anchor and a candidate. Dimensions are taken eight at a time: for each group of eight
an anchor has a table of its 256 subset sums. A candidate is kept as bit planes of its two's-complement components, so
that one byte holds one bit of eight components: the byte is the index into the anchors' table, and the sums that it
finds, shifted by the plane's weight, add up to the exact score of the candidate with every anchor of the chunk.

Anchors are a stated query set against all rows: both are cut into blocks by a hash of the row, and a task holds one
block of candidates against one chunk of anchors. What leaves a task are the best few rows of each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import extent, matrix, scaled, whole

#: Rows of a candidate block and of an anchor chunk; subset sums held at once; candidates scored at once.
BLOCK, CHUNK, SUMS, AT_ONCE = 2048, 4096, 1 << 21, 128
_LAST = np.iinfo(np.int64).max


def planes(ints: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes: bit i of byte (b, g) is bit b of component 8g + i in two's complement."""
    groups = -(-ints.shape[1] // 8)
    padded = np.zeros((len(ints), groups * 8), np.int64)
    padded[:, : ints.shape[1]] = ints
    return np.stack([np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def subset_sums(anchors: np.ndarray, groups: int, dtype) -> np.ndarray:
    """(groups, 256, anchors): the sum of an anchor's components in each subset of each eight dimensions."""
    padded = np.zeros((len(anchors), groups * 8), dtype)
    padded[:, : anchors.shape[1]] = anchors
    out = np.zeros((groups, 256, len(anchors)), dtype)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + padded[:, i::8].T[:, None, :]
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(candidates, anchors) exact inner products: shift, look up, add, from the plane of the sign downwards."""
    n, bits, groups = packed.shape
    acc = np.zeros((n, tables.shape[2]), tables.dtype)
    found = np.empty_like(acc)
    for b in range(bits - 1, -1, -1):
        acc <<= 1
        for g in range(groups):
            np.take(tables[g], packed[:, b, g], axis=0, out=found, mode="clip")
            acc += found
        if b == bits - 1:
            np.negative(acc, out=acc)  # the sign's plane weighs -2^(bits-1)
    return acc


def _best(masked: np.ndarray, k: int, lowest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """k times (row, value) of each column's largest value above `lowest`, the first row of equal ones; masked is used up."""
    out, columns = [], np.arange(masked.shape[1])
    for _ in range(min(k, len(masked))):
        row = masked.argmax(axis=0)
        value = masked[row, columns]
        if not (value > lowest).any():
            break
        out.append((row, value))
        masked[row, columns] = lowest
    return out


def _scored(candidates: pa.Table, anchors: pa.Table, bits: int, width: int, dtype):
    """For each part of the anchors: rows and label codes of anchors and candidates, these by id (nulls last); ids; all scores."""
    ids = candidates["id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
    order = np.lexsort((candidates["_row"].to_numpy(), ids))
    candidates = candidates.take(pa.array(order))
    groups = -(-width // 8)
    packed = np.frombuffer(b"".join(candidates["packed"].to_pylist()), np.uint8).reshape(len(order), bits, groups)
    ints = matrix(anchors["q"], width, dtype)
    labels = pa.chunked_array([*anchors["label"].chunks, *candidates["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    a_row, c_row, c_id = anchors["_row"].to_numpy(), candidates["_row"].to_numpy(), candidates["id"].combine_chunks()
    step = max(32, SUMS // (groups * 256))
    for a in range(0, len(ints), step):
        some = slice(a, min(a + step, len(ints)))
        tables = subset_sums(ints[some], groups, dtype)
        found = np.concatenate([scores(tables, packed[i : i + AT_ONCE]) for i in range(0, len(packed), AT_ONCE)])
        yield some, a_row[some], labels[some], c_row, labels[len(ints) :], c_id, found


def _table(found: list[dict], names: list[str]) -> pa.Table:
    return pa.table({n: pa.concat_arrays([pa.array(x[n], pa.int64()) for x in found]) if found else pa.array([], pa.int64()) for n in names})


def mine_hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                        scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each anchor's best other-label rows below its positives.

    Components become floor(scale * x); a score is the integer inner product. An anchor (a row where `anchor` holds) has
    its first `positives` other rows of its label, higher scores first, ties by smaller id. For each of them the first
    `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive come out, ranked from 1.

    Rows with a null label, a null vector or a null or non-finite component take no part. Ids are longs; a null id sorts
    last and is null in the result. Repeated rows are rows of their own: copies of an anchor are anchors and positives.
    Vectors of unequal lengths are scored as if padded with zeros; empty ones score 0. A positive below zero has no
    negatives, one without rows in range neither, an anchor alone in its label no rows. Empty tables give empty results;
    further columns are ignored, whatever their names. A component of 2^24 or more after scaling raises an error.
    """
    v = vectors
    rows = stage(v.where(v[label_col].isNotNull() & whole(v[vector_col]))
                 .select(F.monotonically_increasing_id().alias("_row"), v[id_col].cast("long").alias("id"), v[label_col].alias("label"),
                         F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled(v[vector_col], scale).alias("q")), "negatives-rows")
    n, width, most = extent(rows)
    n_anchors = rows.where("anchor").count()
    bits = most.bit_length() + 1
    dtype = np.int32 if (most + 1) * (most + 1) * width * 2 < 1 << 31 else np.int64
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_anchors // CHUNK))

    def pack(batches):
        for b in batches:
            p = planes(matrix(b.column("q"), width, np.int64), bits).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("id"), b.column("label"), pa.array([x.tobytes() for x in p], pa.binary())],
                                             names=["_row", "id", "label", "packed"])

    label = rows.schema["label"].dataType.simpleString()
    packed = (rows.select("_row", "id", "label", "q").mapInArrow(pack, f"_row long, id long, label {label}, packed binary")
              .withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("long"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))))
    asked = (rows.where("anchor").select("_row", "id", "label", "q")
             .withColumn("chunk", F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(chunks)).cast("long")))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    lowest = int(np.iinfo(dtype).min)

    def near(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(candidates) and len(anchors):
            for _, a_row, a_label, c_row, c_label, c_id, s in _scored(candidates, anchors, bits, width, dtype):
                s[(c_label[:, None] != a_label[None, :]) | (c_row[:, None] == a_row[None, :])] = lowest
                for row, value in _best(s, positives, lowest):
                    ok = value > lowest
                    out.append({"a_row": a_row[ok], "c_row": c_row[row[ok]], "score": value[ok], "id": c_id.take(pa.array(row[ok]))})
        return _table(out, ["a_row", "c_row", "score", "id"])

    def first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("c_row")]
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)

    close = (packed.groupBy("block", "chunk").cogroup(asked.withColumn("block", everywhere).groupBy("block", "chunk"))
             .applyInArrow(near, "a_row long, c_row long, score long, id long"))
    pairs = stage(first(close, ["a_row"], positives).select("a_row", "place", "score", "id"), "negatives-positives")
    wanted = pairs.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("p"))
    ranged = (asked.join(wanted, asked["_row"] == wanted["a_row"]).drop("a_row")
              .withColumn("p_score", F.col("p.score")).withColumn("p_id", F.col("p.id")).drop("p"))

    def below(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(candidates) and len(anchors):
            wants = anchors["p_score"].to_pylist()
            for some, a_row, a_label, c_row, c_label, c_id, s in _scored(candidates, anchors, bits, width, dtype):
                s[c_label[:, None] == a_label[None, :]] = lowest
                for k in range(positives):
                    # an anchor without a positive in this place gets a range that nothing is in
                    at_least = np.array([-(-low * w[k] // 100) if k < len(w) else 1 for w in wants[some]], np.int64)
                    at_most = np.array([high * w[k] // 100 if k < len(w) else 0 for w in wants[some]], np.int64)
                    for row, value in _best(np.where((s >= at_least) & (s <= at_most), s, lowest), negatives, lowest):
                        ok = value > lowest
                        out.append({"a_row": a_row[ok], "k": np.full(int(ok.sum()), k), "c_row": c_row[row[ok]], "score": value[ok], "id": c_id.take(pa.array(row[ok]))})
        return _table(out, ["a_row", "k", "c_row", "score", "id"])

    hard = (packed.groupBy("block", "chunk").cogroup(ranged.withColumn("block", everywhere).groupBy("block", "chunk"))
            .applyInArrow(below, "a_row long, k long, c_row long, score long, id long"))
    best = stage(first(hard, ["a_row", "k"], negatives).select("a_row", "k", "place", "score", "id"), "negatives-best")
    about = ranged.select(F.col("_row").alias("a_row"), F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("p_id", "p_score")).alias("k", "p"))
    return (best.join(about.withColumn("k", F.col("k").cast("long")), ["a_row", "k"])
            .select("anchor_id", F.col("p.p_id").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    F.col("p.p_score").alias("positive_score"), F.col("score").alias("negative_score")))
