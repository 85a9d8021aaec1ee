"""Removal of repeated byte strings by a distributed, common-prefix-aware merge of sorted suffixes.

Every window of `length` bytes has an anchor: the gram of a quarter of that length with the least hash in it. Windows
that share an anchor are neighbours, and equal windows have equal anchors at equal offsets, so windows only need to be
held against those with an equal anchor gram. Anchors whose gram occurs once in the whole corpus are out. For the rest,
each task sorts the suffixes that start at its anchors and sends front-coded runs (shared prefix length and tail) to
the part of their gram; there a loser tree merges the runs, comparing from the known common prefix on, and the common
prefixes of neighbours, to the right and to the left of the anchor, say which windows are equal.

Grams with very many anchors would make one part large. Their windows are split by the bytes around the gram: windows
whose offsets are near have most of their bytes in common (their core), which names the part. Windows that are equal have
equal cores, so they still meet, and are merged and compared as bytes like all others. Equal contents are one entry of a
task's run, with a count: places stay in rows of their own and learn by a join with the content's name what was found. So
a passage that very many texts share costs a part the contents at its edges, which differ, and not each text's places.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, mix, pack, powers, small_batches, stage, text_slices, unpack

LENGTH = 400
#: Shorter strings whose repeats are counted, not removed: a passage of fifty words has about 250 bytes or more.
SHORT = 200
#: Anchors of one gram that meet in one part; windows of more frequent grams are split by their cores.
FREQUENT = 2000
#: Offsets whose windows share a core: a share of the window's length.
CORE_STEP = 1 / 16
#: Anchors of one part of a counting round, and bytes of suffixes of one merging part, about.
ANCHORS, SUFFIXES = 500_000, 4_000_000
_PIECE = 1 << 22
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _sums(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out, down


def _window_hashes(data: np.ndarray, starts: np.ndarray, length: int, values: np.ndarray = _BYTE) -> np.ndarray:
    sums, down = _sums(data, values)
    return mix((sums[starts + length] - sums[starts]) * down[starts])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = LENGTH // 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first window, last window) of each anchor of one text, windows by their starts.

    The anchor of a window is the leftmost of its grams with the least hash, so it depends on the window's bytes alone,
    and an anchor of longer windows is one of shorter windows too.
    """
    span = length - gram + 1
    out = []
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[at : at + _PIECE + length - 1]
        keys = _window_hashes(piece, np.arange(len(piece) - gram + 1), gram)
        low = (keys & ~np.uint64((1 << 23) - 1)) | np.arange(len(keys), dtype=np.uint64)
        low = np.concatenate([low, np.full(-len(low) % span, ~np.uint64(0))]).reshape(-1, span)
        left = np.minimum.accumulate(low, axis=1).reshape(-1)
        right = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = len(piece) - length + 1
        place = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], windows] - 1
        # least hashes are small: mixed again, they spread evenly over parts
        out.append((mix(keys[place[first]] ^ _OTHER), place[first] + at, first + at, last + at))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cuts(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    step = 2**64 // parts + 1
    cut = np.searchsorted(keys, np.array([min(i * step, 2**64 - 1) for i in range(parts)], np.uint64)).tolist() + [len(keys)]
    return [(i, slice(cut[i], cut[i + 1])) for i in range(parts) if cut[i] < cut[i + 1]]


_ASK = "part int, keys binary, who binary, texts binary, many binary, counts binary"


def _ask_batches(batches: Iterator[pa.RecordBatch], parts: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchor grams that one place of this task has, with its text, and those that several have, with their number.

    The texts of the latter are named at once, in rows of parts below zero.
    """
    from pyspark import TaskContext

    negative = -1 - TaskContext.get().partitionId() % parts
    keys, who, tids, seen = [], [], [], set()
    held = 0

    def flush() -> pa.RecordBatch:
        k, w = np.concatenate(keys), np.concatenate(who)
        at = np.argsort(k, kind="stable")
        k, w = k[at], w[at]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(k)])
        table = np.array(tids, "S16")
        rows = []
        twice = np.repeat(size > 1, size)
        if twice.any():
            rows.append((negative, pack(k[twice]), pack(w[twice]), table.tobytes(), None, None))
        many, counts = k[first[size > 1]], size[size > 1]
        of = {i: (many[s], counts[s]) for i, s in _cuts(many, parts)}
        ones, owner = k[first[size == 1]], w[first[size == 1]]
        for i, s in _cuts(ones, parts):
            used, short = np.unique(owner[s], return_inverse=True)
            m, c = of.pop(i, (many[:0], counts[:0]))
            rows.append((i, pack(ones[s]), pack(short.astype(np.uint32)), table[used].tobytes(), pack(m), pack(c)))
        rows += [(i, b"", b"", b"", pack(m), pack(c)) for i, (m, c) in of.items()]
        types = [pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else
                                          [pa.array([], t) for t in types], names=[c.split()[0] for c in _ASK.split(", ")])

    for batch in batches:
        names = batch.column(1).to_pylist()
        for a, b, data, offsets in text_slices(batch.column(0)):
            for k in range(b - a):
                tid, text = names[a + k], data[offsets[k] : offsets[k + 1]]
                if len(text) < length or tid in seen:
                    continue
                seen.add(tid)
                found = anchors(text, length, gram)[0]
                keys.append(found)
                who.append(np.full(len(found), len(tids), np.uint32))
                tids.append(tid)
                held += len(found)
        if held > 2 * ANCHORS:
            yield flush()
            keys, who, tids, held = [], [], [], 0
    if tids:
        yield flush()


def _texts(raw: bytes) -> np.ndarray:
    """16-byte names as rows of bytes (a fixed-width string array would lose trailing zeros)."""
    return np.frombuffer(raw, np.uint8).reshape(-1, 16)


def _answer(pdf: pd.DataFrame, frequent: int) -> pd.DataFrame:
    """(tid, key, often) for places whose gram occurs elsewhere too; rows without a tid only say how frequent a gram is."""
    if pdf["part"].iloc[0] < 0:
        out = []
        for r in pdf.itertuples():
            k, w, t = unpack(r.keys, np.uint64), unpack(r.who, np.uint32), _texts(r.texts)
            out.append(pd.DataFrame({"tid": [x.tobytes() for x in t[w]], "key": k.view(np.int64), "often": False}).drop_duplicates())
        return pd.concat(out)
    keys, texts, many, counts = [], [], [], []
    for r in pdf.itertuples():
        keys.append(unpack(r.keys, np.uint64)), texts.append(_texts(r.texts)[unpack(r.who, np.uint32)] if r.keys else np.zeros((0, 16), np.uint8))
        many.append(unpack(r.many, np.uint64)), counts.append(unpack(r.counts, np.int64))
    keys, texts, many, counts = map(np.concatenate, (keys, texts, many, counts))
    name = np.ascontiguousarray(texts).view(np.uint64).reshape(-1, 2)
    order = np.lexsort((name[:, 1], name[:, 0], keys))
    keys, texts, name = keys[order], texts[order], name[order]
    # a text that several tasks met is one
    new = np.r_[True, (keys[1:] != keys[:-1]) | (name[1:] != name[:-1]).any(axis=1)] if len(keys) else np.zeros(0, bool)
    keys, texts = keys[new], texts[new]
    every, at = np.unique(np.concatenate([keys, many]), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.ones(len(keys), np.int64), counts]), len(every)).astype(np.int64)
    mine = total[at[: len(keys)]] > 1
    often = every[total > frequent].view(np.int64)
    return pd.concat([pd.DataFrame({"tid": [x.tobytes() for x in texts[mine]], "key": keys[mine].view(np.int64), "often": False}),
                      pd.DataFrame({"tid": [None] * len(often), "key": often, "often": True})])


#: Runs (part 0 and up: their contents' names joined), and rows of one content's places in one task (part -1).
_RUN = "part int, run binary, tails binary, lefts binary, names binary, content binary, texts binary, starts binary"
_NAME = 16
#: Bytes before a suffix that hold its key, so that runs are in order of keys first.
_KEY = 8


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be at least `at`."""
    most = min(len(a), len(b))
    step = 16
    while at < most:
        if a[at : at + step] == b[at : at + step]:
            at += step
            step *= 2
        elif step == 1:
            return at
        else:
            step = max(1, step // 4)
    return min(at, most)


def _cores(text: np.ndarray, keys: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(key, place, first window, last window) of frequent anchors, split by offset and named by what all windows of a piece share."""
    step = max(1, int(length * CORE_STEP))
    low, high = place - last, place - first
    n = high // step - low // step + 1
    of = np.repeat(np.arange(len(place)), n)
    c = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (low // step)[of]
    a, b = np.maximum(low[of], c * step), np.minimum(high[of], c * step + step - 1)
    sums, down = _sums(text, _BYTE)
    begin, end = place[of] - c * step, place[of] - (c * step + step - 1) + length
    key = mix(mix((sums[end] - sums[begin]) * down[begin]) ^ mix(c.astype(np.uint64) + _OTHER) ^ keys[of])
    return list(zip(key.tolist(), place[of].tolist(), (place[of] - b).tolist(), (place[of] - a).tolist(), strict=True))


def _run_batches(batches: Iterator[pa.RecordBatch], parts: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs of the suffixes at wanted anchors, each behind its key."""
    entries: dict[tuple[int, bytes, int], list[tuple[int, int]]] = {}
    tids: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        rows = []
        by: dict[int, list] = {}
        for (key, content, left), places in entries.items():
            name = blake2b(key.to_bytes(_KEY, "big") + left.to_bytes(8, "big") + content, digest_size=_NAME).digest()
            by.setdefault((key * parts) >> 64, []).append((key.to_bytes(_KEY, "big") + content[left:], content[:left][::-1], name, len(places)))
            rows.append((-1, None, None, None, None, name, b"".join(tids[i] for i, _ in places), np.array([lo for _, lo in places], np.int64).tobytes()))
        for part, found in by.items():
            found.sort(key=lambda e: e[:2])
            head, tails, before = [], [], b""
            for right, left, _, count in found:
                n = _common(before, right, 0)
                head.append((n, len(right), len(left), count))
                tails.append(right[n:])
                before = right
            rows.append((part, np.array(head, np.uint32).tobytes(), b"".join(tails), b"".join(e[1] for e in found), b"".join(e[2] for e in found), None, None, None))
        types = [pa.int32()] + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else
                                          [pa.array([], t) for t in types], names=[c.split()[0] for c in _RUN.split(", ")])

    for batch in batches:
        names, wants, oftens = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        for a, b, data, offsets in text_slices(batch.column(0)):
            for k in range(b - a):
                text = data[offsets[k] : offsets[k + 1]]
                want = np.sort(wants[a + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                often = np.sort(oftens[a + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                found = anchors(text, length, gram)
                chosen = np.flatnonzero(np.isin(found[0], want))
                if not len(chosen):
                    continue
                me = len(tids)
                tids.append(names[a + k])
                hot = np.isin(found[0][chosen], often)
                raw = text.tobytes()
                pieces = list(zip(*(x[chosen[~hot]].tolist() for x in found), strict=True))
                if hot.any():
                    pieces += _cores(text, *(x[chosen[hot]] for x in found), length)
                for key, place, lo, last in pieces:
                    hi = last + length
                    entry = entries.setdefault((key, raw[lo:hi], place - lo), [])
                    held += 24 if entry else hi - lo + 150
                    entry.append((me, lo))
                if held > 4 * SUFFIXES:
                    yield flush()
                    entries, held = {}, 0
                    tids = []
    if entries:
        yield flush()


class LoserTree:
    """Merge of sorted runs of (common prefix with the one before, bytes, payload).

    Each loser keeps its common prefix with the winner that beat it. Of two that are held against the same last output,
    the one that shares more with it comes first; only equal common prefixes are compared, from there on.
    """

    def __init__(self, runs: list[list[tuple[int, bytes, object]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.loser: list[tuple[int, int]] = [(-1, 0)] * (2 * self.size)
        self.top = self._build(1)

    def _head(self, run: int) -> bytes:
        return self.runs[run][self.at[run]][1]

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            run = node - self.size
            return (run, 0) if run < len(self.runs) and self.runs[run] else (-1, 0)
        winner, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser): each a run and its common prefix with the last output; the loser's becomes that with the winner."""
        if a[0] < 0:
            return b, a
        if b[0] < 0:
            return a, b
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = self._head(a[0]), self._head(b[0])
        n = _common(x, y, a[1])
        if x[n : n + 1] <= y[n : n + 1]:
            return a, (b[0], n)
        return b, (a[0], n)

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.top[0] >= 0:
            run, common = self.top
            _, word, payload = self.runs[run][self.at[run]]
            yield common, word, payload
            self.at[run] += 1
            now = (run, self.runs[run][self.at[run]][0]) if self.at[run] < len(self.runs[run]) else (-1, 0)
            node = (run + self.size) // 2
            while node >= 1:
                now, self.loser[node] = self._play(now, self.loser[node])
                node //= 2
            self.top = now


def equal_windows(rights: list[int], lefts: list[bytes], lengths: list[int], repeats: list[int], length: int) -> list[np.ndarray]:
    """For each distinct content around one anchor gram, whether each of its windows occurs twice; first window first.

    Contents come in the order of their right sides; rights: common prefix of each with the one before; lengths: of the
    right sides; repeats: places of the content. A window at offset o before the anchor is o bytes to the left and
    length - o to the right, so it falls into a class by the common prefixes on either side.
    """
    u = len(lefts)
    far = np.array([len(x) for x in lefts])
    near = length - np.array(lengths)
    if u == 1 or min(repeats) > 1:
        return [np.full(far[i] - near[i] + 1, repeats[i] > 1) for i in range(u)]
    o = np.arange(near.min(), far.max() + 1)
    right = np.cumsum(np.array(rights)[None, :] < (length - o)[:, None], axis=1)
    order = sorted(range(u), key=lefts.__getitem__)
    shared = np.array([0] + [_common(lefts[a], lefts[b], 0) for a, b in zip(order, order[1:], strict=False)])
    left = np.empty_like(right)
    left[:, order] = np.cumsum(shared[None, :] < o[:, None], axis=1)
    code = left * (u + 1) + right
    inside = (o[:, None] >= near) & (o[:, None] <= far)
    code = np.where(inside, code, -1 - np.arange(u))
    by = np.argsort(code, axis=1, kind="stable")
    ranked = np.take_along_axis(code, by, 1)
    same = ranked[:, 1:] == ranked[:, :-1]
    none = np.zeros((len(o), 1), bool)
    twice = np.empty_like(inside)
    np.put_along_axis(twice, by, np.hstack([none, same]) | np.hstack([same, none]), 1)
    return [(twice[near[i] - o[0] : far[i] - o[0] + 1, i] | (repeats[i] > 1))[::-1] for i in range(u)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _merge_part(pdf: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """(content, starts, stops): of each content the window starts in it that occur twice, from the runs of one part."""
    out: list[tuple[bytes, bytes, bytes]] = []
    runs = []
    for r in pdf.itertuples():
        head = np.frombuffer(r.run, np.uint32).reshape(-1, 4).tolist()
        run, before, t, l = [], b"", 0, 0
        for i, (n, size, left, count) in enumerate(head):
            right = before[:n] + r.tails[t : t + size - n]
            run.append((n, right, (r.lefts[l : l + left], r.names[i * _NAME : (i + 1) * _NAME], count)))
            before, t, l = right, t + size - n, l + left
        runs.append(run)
    group: list[tuple[int, int, object]] = []

    def close() -> None:
        # contents in order of their right sides; equal ones from several runs are one
        rights, lefts, sizes, names, repeats, same = [], [], [], [], [], {}
        for n, size, (left, name, count) in group:
            if not rights or not n == size == sizes[-1]:
                same = {}
            if left in same:
                repeats[same[left]] += count
            else:
                same[left] = len(lefts)
                rights.append(n), lefts.append(left), sizes.append(size), names.append(name), repeats.append(count)
        for flags, name in zip(equal_windows(rights, lefts, sizes, repeats, length), names, strict=True):
            if found := _ranges(flags):
                a, b = np.array(found, np.int64).T
                out.append((name, a.tobytes(), b.tobytes()))

    for n, right, payload in LoserTree(runs) if runs else ():
        if group and n < _KEY + gram:
            close()
            group = []
        group.append((n - _KEY, len(right) - _KEY, payload))
    if group:
        close()
    return pd.DataFrame(out, columns=["content", "from_", "to_"])


def _placed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, start, stop) of what was found in a content, for each of its places."""
    for b in batches:
        tids, starts, stops = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for texts, at, low, high in zip(*(b.column(n).to_pylist() for n in ("texts", "starts", "from_", "to_")), strict=True):
            at, low, high = (np.frombuffer(x, np.int64) for x in (at, low, high))
            tids += [texts[i * 16 : i * 16 + 16] for i in range(len(at)) for _ in range(len(low))]
            starts.append((at[:, None] + low).reshape(-1)), stops.append((at[:, None] + high).reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(stops))], names=["tid", "start", "stop"])


def _cut_batches(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        names, starts, stops = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        out = []
        for a, b, data, offsets in text_slices(batch.column(0)):
            for k in range(b - a):
                text = data[offsets[k] : offsets[k + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, starts[a + k].values.to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, stops[a + k].values.to_numpy(zero_copy_only=False) - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                rest = text[~gone].tobytes()
                out.append((names[a + k], int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest if texts else None))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else
                                         [pa.array([], t) for t in types], names=["tid", "n_removed", "n_spans", "kept_sha256", "kept"])


def _name(text) -> "F.Column":
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return stage(docs.select(docs[id_col].alias("id"), _name(text).alias("tid"), F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("sha")), "suffix-base")


def anchored_texts(docs: DataFrame, base: DataFrame, id_col: str, text_col: str, length: int, gram: int, frequent: int) -> DataFrame:
    """Of docs and their `_base`: each distinct text with anchor grams that occur elsewhere: text, tid, those grams, the frequent ones.

    tid names a text's bytes; copies of a text are one here. The anchors are those of windows of `length` bytes or more.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), _name(text).alias("tid"))
    size = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = int(size // (length * 3 // 8) // ANCHORS + 1)
    answers = stage(rows.select("text", "tid").mapInArrow(lambda b: _ask_batches(b, slots, length, gram), _ASK).groupBy("part")
                    .applyInPandas(lambda x: _answer(x, frequent), "tid binary, key long, often boolean"), "suffix-anchors")
    often = answers.where("often").select("key").distinct().withColumn("hot", F.lit(True))
    wanted = answers.where("tid is not null").join(often, "key", "left")
    wanted = wanted.groupBy("tid").agg(F.collect_set("key").alias("want"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("often"))
    first = base.groupBy("tid").agg(F.min("id").alias("first"))
    wanted = wanted.join(first, "tid").withColumnRenamed("tid", "_tid")
    texts = rows.join(wanted, (F.col("tid") == F.col("_tid")) & F.col("id").eqNullSafe(F.col("first"))).select("text", "tid", "want", "often")
    if not base.groupBy("tid", "id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["tid"])
    return stage(texts, "suffix-texts")


def repeated_windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(tid, start, stop) of windows of `length` bytes found twice, of anchored_texts for windows of that length or shorter ones."""
    parts = int((texts.agg(F.coalesce(F.sum(F.size("want")), F.lit(0))).first()[0] * length * 11 // 8) // SUFFIXES + 1)
    runs = stage(texts.mapInArrow(lambda b: _run_batches(b, parts, length, gram), _RUN), "suffix-runs")
    # staged, so that the join with the places of a very frequent content can be split
    found = stage(runs.where("part >= 0").select("part", "run", "tails", "lefts", "names").groupBy("part")
                  .applyInPandas(lambda x: _merge_part(x, length, gram), "content binary, from_ binary, to_ binary"), "suffix-found")
    places = runs.where("part < 0").select("content", "texts", "starts")
    return places.join(found, "content").select("texts", "starts", "from_", "to_").mapInArrow(_placed_batches, "tid binary, start long, stop long")


def cut_texts(anchored: DataFrame, length: int, gram: int, *, texts: bool = True) -> DataFrame:
    """(tid, n_removed, n_spans, kept_sha256, kept) of each distinct text that loses bytes; `kept` is null without `texts`."""
    ranges = repeated_windows(anchored, length, gram).groupBy("tid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return stage(anchored.select("text", "tid").join(ranges, "tid").select("text", "tid", "starts", "stops")
                 .mapInArrow(lambda b: _cut_batches(b, length, texts), "tid binary, n_removed long, n_spans long, kept_sha256 string, kept binary"), "suffix-cut")


def _by_text(anchored: DataFrame, base: DataFrame, length: int, gram: int, name: str) -> DataFrame:
    """(tid, struct `name` of n_removed, n_spans, kept_sha256) of each text that loses bytes; n_removed is -1 for texts that have a copy."""
    cut = cut_texts(anchored, length, gram, texts=False).drop("kept")
    copies = base.where(F.col("n") >= length).groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    whole = copies.select("tid", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(whole).groupBy("tid").agg(F.min_by(F.struct("n_removed", "n_spans", "kept_sha256"), "n_removed").alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, frequent: int = FREQUENT, short: int | None = None) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; with `short` also n_short.

    A text's UTF-8 bytes (null: none) lose every byte covered by a string of `length` bytes that starts anywhere else
    too, in this document or another; strings are judged on the input and never cross documents. n_short is how many
    bytes are covered by such a string of `short` bytes (at most `length`). Repeated rows are documents of their own, so
    texts of `length` bytes or more that have a copy are removed whole. Other columns are ignored, empty tables give no
    rows, and a text of any length is read whole by one task, 4 MB at a time. Texts are named by 128 bits of their
    SHA-256; anchors are found by 64-bit hashes, and their suffixes compared as bytes. Grams with over `frequent` places
    are split further, see above.
    """
    base, least = _base(docs, id_col, text_col), min(length, short or length)
    gram = least // 4
    anchored = anchored_texts(docs, base, id_col, text_col, least, gram, frequent)
    by_text = _by_text(anchored, base, length, gram, "x")
    if short:
        by_text = by_text.join(_by_text(anchored, base, short, gram, "y"), "tid", "full")
    # staged, so that the join is of plain exchanges and a text with very many copies can be split
    out = base.join(stage(by_text, "suffix-result"), "tid", "left")
    lost = lambda x: F.when(x.isNull(), F.lit(0)).when(x["n_removed"] < 0, F.col("n")).otherwise(x["n_removed"]).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), lost(F.col("x")).alias("n_removed"), F.coalesce(F.col("x.n_spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce(F.col("x.kept_sha256"), F.col("sha")).alias("kept_sha256"), *([lost(F.col("y")).alias("n_short")] if short else []))
