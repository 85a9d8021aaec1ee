"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3 characters) over all its training documents. A
document's own list is held against every profile: each n-gram costs the distance between its two ranks, or the list's
length where the profile lacks it, and the language with the least sum is predicted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage

#: n-grams of a profile, and of a document, that are ranked.
RANKED = 400
#: Languages whose profiles one pass holds in each worker (RANKED rows each); more are matched in further passes.
LANGUAGES_AT_ONCE = 500
UNKNOWN = "und"
#: A document below this score is in no learned language, see keep_identified.
LEAST = 0.3
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CODE = np.uint64(21)


def letters(text: str | None) -> str:
    """Lower-cased, each run of other characters one space, a space at both ends; empty if there is no letter."""
    s = _NOT_LETTERS.sub(" ", (text or "").lower())
    return f" {s.strip()} " if any(map(str.isalpha, s)) else ""


def counted(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers (code points, 21 bits each), ascending by length and code points, and their counts."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, dense = np.unique(codes, return_inverse=True)
    wide, a, dense = alphabet.astype(np.uint64), len(alphabet), dense.astype(np.int64)
    keys, counts = [], []
    for n in (1, 2, 3):
        if len(dense) < n:
            break
        grams = dense[: len(dense) - n + 1]
        for k in range(1, n):
            grams = grams * a + dense[k : len(dense) - n + 1 + k]
        if a**n <= 4 * len(dense) + 1024:
            c = np.bincount(grams, minlength=1)
            u = np.flatnonzero(c)
            c = c[u]
        else:
            u, c = np.unique(grams.astype(np.int32) if a**n < 2**31 else grams, return_counts=True)
        key = np.zeros(len(u), np.uint64)
        rest = u.astype(np.int64)
        for k in range(n):
            key |= wide[rest % a] << (_CODE * np.uint64(k))
            rest = rest // a
        # a lone space says nothing, and two are where texts that are counted together meet
        one, two = key & np.uint64(0x1FFFFF), (key >> _CODE) & np.uint64(0x1FFFFF)
        keep = (key != 32) & ~((one == 32) & (two == 32)) & ~((two == 32) & (key >> (_CODE * np.uint64(2)) == 32))
        keys.append(key[keep])
        counts.append(c[keep])
    return np.concatenate(keys).astype(np.int64), np.concatenate(counts).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        for lang, (k, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(c)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(letters(text))
        for lang, texts in by.items():
            s = "".join(texts)
            if not s:
                continue
            k, c = counted(s)
            if lang in held:
                k, at = np.unique(np.concatenate([held[lang][0], k]), return_inverse=True)
                c = np.bincount(at, np.concatenate([held[lang][1], c]), len(k)).astype(np.int64)
            held[lang] = k, c
        if sum(len(k) for k, _ in held.values()) > 2_000_000:
            yield from flush()
    yield from flush()


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranked: int = RANKED) -> DataFrame:
    """(lang, gram, rank) of the `ranked` most frequent n-grams of each language, over all rows given.

    Ties go to the smaller n-gram number. Rows with a null language or without letters teach nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(docs[lang_col].isNotNull()).select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # cut to `ranked` rows before the shuffle
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranked).select("lang", "gram", "rank")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], ranked: int):
        self.ranked, self.langs = ranked, sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), 2 * ranked, np.int32)
        where = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), where[lang]] = rank - 1

    def nearest(self, text: str | None) -> tuple[str | None, float]:
        """The language (the first by name among equals) and the out-of-place distance as a share of the largest one."""
        s = letters(text)
        if not s or not self.langs:
            return None, 1.0
        keys, counts = counted(s)
        top = keys[np.argsort(-counts, kind="stable")[: self.ranked]]
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        off = np.minimum(np.abs(self.ranks[at] - np.arange(len(top))[:, None]), self.ranked).sum(axis=0)
        k = int(np.argmin(off))
        return self.langs[k], float(off[k]) / (self.ranked * len(top))


#: The profiles of the last broadcast that this worker process met.
_profiles: dict[str, Profiles] = {}


def _nearest(shared, key: str, ranked: int):
    def nearest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _profiles:
            _profiles.clear()
            _profiles[key] = Profiles(shared.value, ranked)
        for column in texts:
            found = [_profiles[key].nearest(x) for x in column.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "off"])

    # not repeated by the optimiser, whatever is selected later
    return F.arrow_udf(nearest, "lang string, off double").asNondeterministic()


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", ranked: int = RANKED, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """docs with lang_pred and score (0 to 1: one less the distance as a share of the largest possible one).

    Null texts and texts without a letter are `und` with score 0, as is everything when no profile was learned. Equal
    distances go to the first language by name. Each row is judged by its whole text alone, which is read whole by one
    task. Only texts go to Python. More than `at_once` languages are matched in passes, staged in between, so that one
    pass's profiles are in memory at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [F.col(c) for c in docs.columns]
    out = docs.select(F.struct(*columns).alias("_row"), docs[text_col].alias("_text"), F.lit(None).cast("struct<off:double,lang:string>").alias("_best"))
    passes = -(-profiles.select("lang").distinct().count() // at_once)
    for k in range(passes):
        if k:
            out = stage(out, "lang-pass")
        part = profiles if passes == 1 else profiles.where(F.pmod(F.xxhash64("lang"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.select("lang", "gram", "rank").collect()])  # about at_once * ranked rows
        out = out.withColumn("_p", _nearest(shared, uuid.uuid4().hex, ranked)("_text"))
        mine = F.when(F.col("_p.lang").isNotNull(), F.struct(F.col("_p.off").alias("off"), F.col("_p.lang").alias("lang")))
        out = out.select("_row", "_text", F.least("_best", mine).alias("_best") if k else mine.alias("_best"))
    return out.select("_row.*", F.coalesce("_best.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1.0 - F.col("_best.off"), F.lit(0.0)).alias("score"))


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id's text leaves `fold` modulo `folds`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; profiles come from the rows that are not held out.

    Other columns are ignored; repeated rows and ids are judged row by row; empty tables give no rows. For odd texts see
    predict.
    """
    profiles = stage(train_profiles(docs.where(~held_out(docs[id_col])), text_col, lang_col), "lang-profiles")
    found = predict(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_doc")), profiles, "_doc")
    return found.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST,
                    languages: tuple[str, ...] | None = None) -> DataFrame:
    """The documents in a learned language (one of `languages` if given) with score `least` or more, columns as they were.

    A text in a language that was not learned shares few n-grams with any profile and is far from all of them, in the same
    letters too. Null and empty texts and texts without letters go; repeated rows and ids are judged row by row; columns
    may have any names; an empty table, or one without labels to learn from, keeps nothing.
    """
    profiles = stage(train_profiles(docs.where(~held_out(docs[id_col])), text_col, lang_col), "lang-profiles")
    found = predict(docs.select(F.struct("*").alias("_row"), docs[text_col].alias("_doc")), profiles, "_doc")
    wanted = F.col("lang_pred").isin(*languages) if languages is not None else F.col("lang_pred") != UNKNOWN
    return found.where(wanted & (F.col("score") >= least)).select("_row.*")
