"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For each pattern length a table gives, for the block of the last
two words of the current position, how far the search can jump; where the jump is zero the block's bucket names the
patterns to test, and a direct comparison of the words confirms an occurrence.

Only ids and texts go to Python, and only findings come back. A benchmark beyond `at_once` characters is searched in
passes, each a job of its own whose findings are staged, so that one pass's tables are in memory at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, find_words, hash_runs, hash_spans, mix, powers, small_batches, stage, text_slices

#: Characters of benchmark text that one pass holds in each worker; a larger benchmark is searched in further passes.
BENCHMARK_AT_ONCE = 8_000_000


#: Words at a window's start whose hash tells windows of one suffix bucket apart before their words are compared.
HEAD = 16


def _bucket(suffix: np.ndarray, head: np.ndarray) -> np.ndarray:
    return mix(suffix ^ (head >> np.uint64(1)))


class WuManber:
    """All windows of the items, by length; items with fewer words than `window` are one shorter window.

    The items' words are held once, joined by single spaces, and a window is a slice of that text.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        data = LOWER[np.frombuffer(b"\0".join((text or "").encode() for _, text in items), np.uint8)]
        sizes = np.array([len((text or "").encode()) + 1 for _, text in items], np.int64)
        starts, ends, text = find_words(data, np.r_[0, np.cumsum(sizes)[:-1], len(data)].astype(np.int64) if items else np.zeros(1, np.int64), ALNUM)
        hashes = hash_spans(data, starts, ends)
        self.text = b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        after = np.cumsum(ends - starts + 1)
        self.begin, self.end = after - (ends - starts + 1), after - 1
        words = np.bincount(text, minlength=len(items))
        first = np.cumsum(words) - words
        owner = np.array([number[name] for name, _ in items], np.int64)
        #: length -> (block words, bits, jumps, which bucket keys there may be, those of the windows in order, their first words, their items)
        self.by_length = {}
        length = np.minimum(words, window)
        for n in sorted(set(length[length > 0].tolist())):
            mine = np.flatnonzero(length == n)
            count = words[mine] - n + 1
            at = np.repeat(first[mine] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            size = min(2, n)
            blocks = hash_runs(hashes, size)
            bits = int(np.clip(np.ceil(np.log2(16 * len(at) * n + 1)), 16, 27))
            most = n - size + 1
            jump = np.full(1 << bits, most, np.uint8 if n < 250 else np.int64)
            for k in range(most):
                np.minimum.at(jump, (blocks[at + k] >> np.uint64(64 - bits)).astype(np.int64), jump.dtype.type(most - 1 - k))
            bucket = _bucket(blocks[at + most - 1], hash_runs(hashes, min(n, HEAD))[at])
            order = np.argsort(bucket, kind="stable")
            there = np.zeros(1 << bits, bool)
            there[(bucket >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[n] = size, bits, jump, there, bucket[order], at[order], np.repeat(owner[mine], count)[order]

    def _window(self, first: int, n: int) -> bytes:
        return self.text[self.begin[first] : self.end[first + n - 1]]

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, words, items) of each occurrence, over the words of several texts; none crosses a text's end."""
        for n, (size, bits, jump, there, buckets, first_of, owner_of) in self.by_length.items():
            blocks = hash_runs(hashes, size)
            if len(blocks) < n - size + 1:
                continue
            jumps = jump[(blocks >> np.uint64(64 - bits)).astype(np.int64)].tolist()
            keys = _bucket(blocks[n - size :], hash_runs(hashes, min(n, HEAD))[: len(blocks) - (n - size)])
            maybe = there[(keys >> np.uint64(64 - bits)).astype(np.int64)].tolist()
            i, last = n - size, len(blocks)
            while i < last:
                if jumps[i]:
                    i += jumps[i]
                    continue
                first = i - (n - size)
                if maybe[first] and text[first] == text[first + n - 1]:
                    lo, hi = np.searchsorted(buckets, keys[first]), np.searchsorted(buckets, keys[first], "right")
                    if lo < hi:
                        span = b" ".join(data[a:b].tobytes() for a, b in zip(starts[first : first + n].tolist(), ends[first : first + n].tolist(), strict=True))
                        who = {int(owner_of[k]) for k in range(lo, hi) if self._window(int(first_of[k]), n) == span}
                        if who:
                            yield first, n, who
                i += 1


#: The matcher of the last broadcast that this worker process met.
_machine: dict[str, WuManber] = {}


def _matcher(shared, key: str, window: int) -> WuManber:
    if key not in _machine:
        _machine.clear()
        _machine[key] = WuManber(shared.value, window)
    return _machine[key]


def _spans_of(column: pa.Array, machine: WuManber) -> Iterator[tuple[int, list[int], set[int]]]:
    """Words, disjoint ranges of hit words (first, after the last, ...) and items of each text."""
    for a, b, raw, offsets in text_slices(column):
        data = LOWER[raw]
        powers(len(data))
        starts, ends, text = find_words(data, offsets, ALNUM)
        bounds = np.searchsorted(text, np.arange(b - a + 1))
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for first, n, who in machine.search(data, starts, ends, hash_spans(data, starts, ends), text):
            k = int(text[first])
            ranges, items = found.setdefault(k, ([], set()))
            ranges.append((int(first - bounds[k]), int(first - bounds[k]) + n))
            items |= who
        for k in range(b - a):
            ranges, items = found.get(k, ((), set()))
            flat: list[int] = []
            for lo, hi in sorted(ranges):
                if flat and lo <= flat[-1]:
                    flat[-1] = max(flat[-1], hi)
                else:
                    flat += [lo, hi]
            yield int(bounds[k + 1] - bounds[k]), flat, items


_FOUND = "n_words long, hit_spans array<int>, hit_items array<string>"


def _search_batches(batches: Iterator[pa.RecordBatch], shared, key: str, window: int, only_hits: bool) -> Iterator[pa.RecordBatch]:
    machine = _matcher(shared, key, window)
    for batch in batches:
        rows = list(_spans_of(batch.column(1), machine))
        out = pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            pa.array([sorted(machine.names[i] for i in r[2]) for r in rows], pa.list_(pa.string()))], names=["_id", "n_words", "hit_spans", "hit_items"])
        yield out.filter(pa.array([bool(r[1]) for r in rows], pa.bool_())) if only_hits else out


def _text_id(text) -> "F.Column":
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _passes(benchmark: DataFrame, item_col: str, item_text: str, at_once: int) -> list[DataFrame]:
    """The benchmark as (name, text) tables of about at_once characters."""
    named = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("_item"), F.coalesce(benchmark[item_text], F.lit("")).alias("_item_text"))
    size = named.agg(F.sum(F.length("_item_text"))).first()[0] or 0
    passes = max(1, -(-size // at_once))
    return [named] if passes == 1 else [named.where(F.pmod(F.xxhash64("_item", "_item_text"), F.lit(passes)) == k) for k in range(passes)]


def _search(rows: DataFrame, part: DataFrame, window: int, only_hits: bool) -> DataFrame:
    """rows (_id, text) searched for one pass of the benchmark."""
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about at_once characters, see _passes
    key, kind = uuid.uuid4().hex, rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _search_batches(b, shared, key, window, only_hits), f"_id {kind}, {_FOUND}")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                   window: int = 10, at_once: int = BENCHMARK_AT_ONCE) -> DataFrame:
    """One row per document: _id, n_words, hit_spans (first hit word, word after the last, ...; disjoint) and hit_items (ids as text).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is `window` consecutive words of an
    item; an item of fewer words, but not none, is one window. Null texts have no words; a null item id counts as an
    empty name; repeated items, documents and ids are fine; an empty benchmark hits nothing and empty documents give no
    rows. Other columns are ignored. A text is searched whole in one task, about 1 MB of texts at a time or one longer
    text alone, in memory of about 60 bytes for each of its bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = _passes(benchmark, item_col, item_text, at_once)
    text = F.coalesce(docs[text_col], F.lit(""))
    if len(parts) == 1:
        return _search(docs.select(docs[id_col].alias("_id"), text.alias("_text")), parts[0], window, False)
    rows = docs.select(F.struct(docs[id_col].alias("id"), _text_id(docs[text_col]).alias("tid")).alias("_id"), text.alias("_text"))
    base = stage(_search(rows, parts[0], window, False), "leak-first").select("_id.*", "n_words", "hit_spans", "hit_items")
    # findings of the further passes by text, of which equal ones have the same
    more = [stage(_search(rows.select(F.col("_id.tid").alias("_id"), "_text"), p, window, True), "leak-pass") for p in parts[1:]]
    each = reduce(DataFrame.unionByName, [m.groupBy("_id").agg(F.first("hit_spans").alias("s"), F.first("hit_items").alias("i")) for m in more])
    by_text = stage(each.groupBy(F.col("_id").alias("tid")).agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("i")).alias("i")), "leak-texts")
    both = base.join(by_text, "tid", "left")
    return both.select(F.col("id").alias("_id"), "n_words", _united(F.concat("hit_spans", F.coalesce("s", F.array().cast("array<int>")))).alias("hit_spans"),
                       F.array_sort(F.array_union("hit_items", F.coalesce("i", F.array().cast("array<string>")))).alias("hit_items"))


def _united(spans) -> "F.Column":
    """The disjoint ranges of a flat list of ranges."""
    i = F.sequence(F.lit(0), F.greatest(F.size(spans) - 2, F.lit(0)), F.lit(2))
    pairs = F.array_sort(F.transform(i, lambda k: F.struct(F.get(spans, k).alias("a"), F.get(spans, k + 1).alias("b"))))
    empty = F.array().cast("array<int>")

    def add(s, p):
        end = F.element_at(s, -1)
        inner = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.greatest(end, p["b"])))
        return F.when((F.size(s) > 0) & (p["a"] <= F.try_element_at(s, F.lit(-1))), inner).otherwise(F.concat(s, F.array(p["a"], p["b"])))

    return F.when(F.size(spans) == 0, empty).otherwise(F.aggregate(pairs, empty, add))


def _length(spans) -> "F.Column":
    return F.aggregate(F.transform(spans, lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated; see find_benchmark for odd inputs."""
    found = find_benchmark(docs, benchmark, id_col, **options)
    return found.select(F.col("_id").alias(id_col), "n_words", _length(F.col("hit_spans")).alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def _is_clean(shared, key: str, window: int):
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _matcher(shared, key, window)
        for column in columns:
            yield pa.array([not spans for _, spans, _ in _spans_of(column, machine)], pa.bool_())

    # not repeated by the optimiser, whatever is selected later
    return F.arrow_udf(clean, "boolean").asNondeterministic()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = 10, at_once: int = BENCHMARK_AT_ONCE) -> DataFrame:
    """The documents without any occurrence of a benchmark window, all columns as they were, whatever their names.

    Only texts go to Python: the rows wait in Spark for a yes or no. For odd inputs see find_benchmark.
    """
    small_batches(docs.sparkSession)
    for k, part in enumerate(_passes(benchmark, item_col, item_text, at_once)):
        if k:
            docs = stage(docs, "leak-pass")  # one pass's tables are in memory at a time
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about at_once characters, see _passes
        docs = docs.where(_is_clean(shared, uuid.uuid4().hex, window)(docs[text_col]))
    return docs
