"""Compression of vectors to codes: each part of a vector becomes the number of the nearest entry of its part's codebook.

All arithmetic is on integers. Parts and entries are padded with zeros to a power of two and taken through the
Walsh-Hadamard transform, which keeps squared distances up to the factor of its length. Coefficients are compared in
sequency order, slow ones first, where most of a distance lies: an entry leaves the race as soon as its partial sum is
above the full distance of a known one, and only entries that are left get further coefficients.

Codebooks are a model of bounded size (entries x dimensions numbers, whatever the number of rows): their sums are added
up in each task, then by key, and only they reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import extent, matrix, scaled, whole

#: Rows of a batch whose distances are held at once.
AT_ONCE = 2048


def walsh(n: int) -> np.ndarray:
    """The n x n Walsh-Hadamard matrix, n a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def nearest(parts: np.ndarray, entries: np.ndarray, transform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (the lower one of ties) and the squared distance, exactly."""
    padded = len(transform)
    x = np.zeros((len(parts), padded), np.int64)
    x[:, : parts.shape[1]] = parts
    e = np.zeros((len(entries), padded), np.int64)
    e[:, : entries.shape[1]] = entries
    x, e = x @ transform.T, e @ transform.T
    first = x[:, :1] - e[None, :, 0]
    first *= first
    guess = first.argmin(axis=1)
    bound = ((x - e[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    left = first[row, entry]
    for c in range(1, padded):
        d = x[row, c] - e[entry, c]
        left = left + d * d
        stays = left <= bound[row]
        if not stays.all():
            row, entry, left = row[stays], entry[stays], left[stays]
    # every row has its guess left at least, and rows are in order: the least (distance, index) of each run
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    best = np.minimum.reduceat(left, starts) if len(row) else left
    at_best = np.where(left == np.repeat(best, np.diff(np.r_[starts, len(row)])), entry, len(entries))
    return (np.minimum.reduceat(at_best, starts) if len(row) else entry), best // padded


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(parts, rows, width) integers."""
    return matrix(column, parts * width, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)


def _refined(rows: DataFrame, books: np.ndarray, transform: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries replaced by the floors of their parts' means, unused ones as they were."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                for p, x in enumerate(_parts(b.column(0).slice(i, AT_ONCE), parts, width)):
                    entry, _ = nearest(x, books[p], transform)
                    np.add.at(count[p], entry, 1)
                    np.add.at(total[p], entry, x)
        p, e = np.nonzero(count)
        n = len(p) * width
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width)), pa.array(np.repeat(e, width)), pa.array(np.tile(np.arange(width), len(p)) if n else np.zeros(0, np.int64)),
                                          pa.array(total[p, e].reshape(-1)), pa.array(np.repeat(count[p, e], width))], names=["p", "e", "i", "s", "n"])

    out = books.copy()
    added = (rows.select("q").mapInArrow(sums, "p long, e long, i long, s long, n long").groupBy("p", "e", "i")
             .agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    for r in added.collect():  # entries x dimensions rows at most
        out[r.p, r.e, r.i] = r.s // r.n
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256,
                   parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per whole vector: id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x). Vectors are cut into `parts` equal consecutive parts. Each part's codebook starts
    as that part of the `entries` smallest ids' vectors; each round assigns all parts to their nearest entries (squared
    Euclidean distance, lower index of ties) and sets each used entry to its parts' componentwise floor(sum / count).
    The code holds the final indices in part order, two hex digits each (`entries` <= 256); error is the sum of the final
    squared distances; label_error is the sum of errors over rows of the same label, nulls together.

    Vectors that are null or hold a null or non-finite component are dropped. Null ids sort last and are kept; repeated
    ids are ordered by their components. With fewer vectors than `entries` the codebooks are shorter; without any the
    result is empty. Vectors that are shorter than the longest, or whose length is no multiple of `parts`, are scored as
    if padded with zeros at the end. Further columns are ignored, whatever their names. A component of 2^24 or more after
    scaling raises an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    v = vectors
    rows = stage(v.where(whole(v[vector_col])).select(v[id_col].alias("id"), v[label_col].alias("label"), scaled(v[vector_col], scale).alias("q")), "codes-rows")
    _, longest, _ = extent(rows)
    width = -(-longest // parts)
    transform = walsh(1 << (width - 1).bit_length())
    start = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()
    books = np.ascontiguousarray(_parts(start["q"], parts, width))
    for _ in range(rounds if books.shape[1] else 0):
        books = _refined(rows, books, transform)

    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def codes(batches):
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                some = b.slice(i, AT_ONCE)
                code, error = np.zeros((some.num_rows, parts), np.uint8), np.zeros(some.num_rows, np.int64)
                for p, x in enumerate(_parts(some.column(2), parts, width)):
                    entry, far = nearest(x, books[p], transform)
                    code[:, p] = entry
                    error += far
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array(error)],
                                                 names=["id", "label", "code", "error"])

    coded = stage(rows.select("id", "label", "q").mapInArrow(codes, f"id {id_type}, label {label_type}, code string, error long"), "codes")
    # staged, so that the join of a hot label is of plain exchanges and can be split, or is a broadcast of known size
    by_label = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return (coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
