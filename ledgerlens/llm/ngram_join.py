"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its word 5-grams. Equal sets are one class. A class with so many 5-grams of
its own that no other set can overlap it enough is out (first over a third of the hash space, then over all of it).
What is left is ordered from rare to frequent, the prefixes of that order give candidate groups, and each group is
joined over a trie: sets are stored in one global order, overlaps are summed once per shared path, and subtrees are
left as soon as the remaining lengths cannot reach the bound, or once all below is linked already. A group with more
sets than one task should hold is first held against its most common set; what is left is joined by prefixes and sizes.

Numbers travel as packed arrays, combined in each task first: a 5-gram that a third of all documents share costs one
entry a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, find_words, hash_runs, hash_spans, pack, small_batches, stage, text_slices, unpack
from .components import components

WORDS = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Sets that one task joins at a time; larger candidate groups are joined in blocks.
GROUP = 1000
#: Share of the hash space that the first round looks at.
FIRST = 0.35
#: Numbers that one task of the counting rounds holds, about.
TASK = 750_000


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words are one n-gram, none an empty set."""
    for a, b, raw, offsets in text_slices(column):
        data = LOWER[raw]
        starts, ends, text = find_words(data, offsets, SPACED)
        hashes = hash_spans(data, starts, ends)
        runs = hash_runs(hashes, words)
        bounds = np.searchsorted(text, np.arange(b - a + 1))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                yield np.unique(runs[lo : hi - words + 1])
            else:
                yield hash_runs(hashes[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Names:
    """How sets are named: by the first 64 bits of a digest of 192, or by the next, or the last, where different sets share a name.

    taken: names that different sets share; about n^2 / 2^65 of n sets, eleven of 2 x 10^10.
    """

    taken: frozenset[int] = frozenset()
    bits: int = 64

    def of(self, s: np.ndarray) -> tuple[int, bytes]:
        """The name and the rest of the digest."""
        d = hashlib.blake2b(s.tobytes(), digest_size=24).digest()
        return self.next(int.from_bytes(d[:8], "little", signed=True) >> (64 - self.bits), d[8:]), d[8:]

    def next(self, name: int, wide: bytes) -> int:
        for i in (0, 8):
            if name not in self.taken:
                break
            name = int.from_bytes(wide[i : i + 8], "little", signed=True)
        return name


def most_alone(n: np.ndarray) -> np.ndarray:
    """Elements that a set of n may have alone and still be linked."""
    return n - -(-PERCENT * n // 100)


def _by(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted uint64 keys by the part of the hash space they are in."""
    step = 2**64 // parts + 1
    cuts = np.searchsorted(keys, np.array([min(i * step, 2**64 - 1) for i in range(parts + 1)], np.uint64))
    cuts[-1] = len(keys)
    yield from ((i, slice(cuts[i], cuts[i + 1])) for i in range(parts) if cuts[i] < cuts[i + 1])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal sorted keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def _class_batches(batches: Iterator[pa.RecordBatch], names: Names) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(*names.of(s), len(s)) for s in shingle_sets(batch.column(1))]
        sig, wide, n = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sig, pa.int64()), pa.array(wide, pa.binary()), pa.array(n, pa.int64())],
                                         names=["id", "th", "sig", "wide", "n"])


def _renamed(batches: Iterator[pa.RecordBatch], names: Names) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = [names.next(name, wide) for name, wide in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.int64()), b.column(3), b.column(4)], names=["id", "th", "sig", "wide", "n"])


_FIRST = "part int, ones binary, who binary, table binary, many binary"


def _first_batches(batches: Iterator[pa.RecordBatch], parts: int, names: Names) -> Iterator[pa.RecordBatch]:
    """What this task knows of the 5-grams below FIRST: those that one of its sets has, with the set, and those that more have.

    Parts below zero carry the sets' own sizes. A set that several tasks see is reported by each; how many 5-grams it has
    alone is the same in all of them, so the sums in `link_classes` need no numbering of rows or tasks.
    """
    from pyspark import TaskContext

    limit, negative = np.uint64(int(FIRST * 2**64)), -1 - TaskContext.get().partitionId() % parts
    tokens, docs, seen, held = [], [], set(), 0

    def flush() -> pa.RecordBatch:
        keys = np.concatenate(tokens)
        who = np.repeat(np.arange(len(tokens), dtype=np.uint32), [len(t) for t in tokens])
        at = np.argsort(keys, kind="stable")
        keys, who = keys[at], who[at]
        first, size = _runs(keys)
        dup = np.bincount(who[np.repeat(size > 1, size)], minlength=len(tokens))
        sets = np.array([(d[0], d[1], len(t), k) for d, t, k in zip(docs, tokens, dup, strict=True)], np.int64)
        rows = [(negative, None, None, pack(sets.reshape(-1)), None)]
        ones, owner, many = keys[first[size == 1]], who[first[size == 1]], keys[first[size > 1]]
        of = {i: many[s] for i, s in _by(many, parts)}
        for i, s in _by(ones, parts):
            used, short = np.unique(owner[s], return_inverse=True)
            rows.append((i, pack(ones[s]), pack(short.astype(np.uint32)), pack(sets[used, 0]), pack(of.pop(i, many[:0]))))
        rows += [(i, b"", b"", b"", pack(x)) for i, x in of.items()]
        types = [pa.int32()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=[c.split()[0] for c in _FIRST.split(", ")])

    for batch in batches:
        for s in shingle_sets(batch.column(0)):
            if not len(s):
                continue
            sig, wide = names.of(s)
            if wide in seen:
                continue
            seen.add(wide)
            docs.append((sig, len(s)))
            tokens.append(s[s < limit])
            held += len(tokens[-1])
        if held > 2 * TASK:
            yield flush()
            tokens, docs, held = [], [], 0
            seen.clear()
    if docs:
        yield flush()


def _first_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """(sig, n, asked, dup, seen): a set's sizes as one task saw it, or the number of its 5-grams in this part that another set has."""
    if pdf["part"].iloc[0] < 0:
        t = np.concatenate([unpack(table, np.int64).reshape(-1, 4) for table in pdf["table"]])
        return pd.DataFrame({"sig": t[:, 0], "n": t[:, 1], "asked": t[:, 2], "dup": t[:, 3], "seen": 1})
    keys, sigs, many = [], [], []
    for r in pdf.itertuples():
        keys.append(unpack(r.ones, np.uint64)), sigs.append(unpack(r.table, np.int64)[unpack(r.who, np.uint32)]), many.append(unpack(r.many, np.uint64))
    keys, sigs, many = map(np.concatenate, (keys, sigs, many))
    at = np.argsort(keys, kind="stable")
    keys, sigs = keys[at], sigs[at]
    first, size = _runs(keys)
    if not len(first):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("sig", "n", "asked", "dup", "seen")})
    low, high = np.minimum.reduceat(sigs, first), np.maximum.reduceat(sigs, first)
    who, n = np.unique(sigs[np.repeat((low != high) | np.isin(keys[first], many), size)], return_counts=True)
    return pd.DataFrame({"sig": who, "n": 0, "asked": 0, "dup": n, "seen": 0})


def _full_batches(batches: Iterator[pa.RecordBatch], names: Names) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs, out = batch.column(1).to_pylist(), []
        for sig, s in zip(sigs, shingle_sets(batch.column(0)), strict=True):
            if len(s) and names.of(s)[0] == sig:
                out.append((sig, len(s), pack(s)))
        sig, n, raw = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["sig", "n", "grams"])


def _tally(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """How many sets of this block have each 5-gram, by part of the hash space."""
    keys, counts = np.unique(np.concatenate([unpack(x, np.uint64) for x in pdf.drop_duplicates("sig")["grams"]]), return_counts=True)
    rows = [(i, pdf["block"].iloc[0], pack(keys[s]), pack(counts[s].astype(np.uint32))) for i, s in _by(keys, parts)]
    return pd.DataFrame(rows, columns=["part", "block", "grams", "df"])


def _sum_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block that sent some of these 5-grams, those that two sets or more have, with the number of sets."""
    keys = [unpack(x, np.uint64) for x in pdf["grams"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack(x, np.uint32) for x in pdf["df"]]), len(every)).astype(np.int64)
    rows, i = [], 0
    for block, k in zip(pdf["block"], keys, strict=True):
        t = total[at[i : i + len(k)]]
        i += len(k)
        rows.append((block, pack(k[t > 1]), pack(t[t > 1])))
    return pd.DataFrame(rows, columns=["block", "grams", "df"])


def _prefixes(sets: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """(gram, sig, common): each set's prefix, the rarest 5-grams first, without those that it has alone."""
    keys = np.concatenate([unpack(x, np.uint64) for x in shared["grams"]] or [np.zeros(0, np.uint64)])
    df = np.concatenate([unpack(x, np.int64) for x in shared["df"]] or [np.zeros(0, np.int64)])
    at = np.argsort(keys)
    keys, df = keys[at], df[at]
    out = []
    for sig, n, raw in sets.drop_duplicates("sig")[["sig", "n", "grams"]].itertuples(index=False):
        s = unpack(raw, np.uint64)
        i = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
        have = keys[i] == s if len(keys) else np.zeros(len(s), bool)
        take = most_alone(np.int64(n)) + 1 - int((~have).sum())
        if take > 0:
            s, d = s[have], df[i[have]]
            grams = s[np.lexsort((s, d))[:take]].view(np.int64)
            out.append(pd.DataFrame({"gram": grams, "sig": sig, "common": float(d.sum()) / n}))
    return pd.concat(out) if out else pd.DataFrame({"gram": np.zeros(0, np.int64), "sig": np.zeros(0, np.int64), "common": np.zeros(0)})


class Tree:
    """A path-compressed trie over sets of numbers in ascending order, and the links between its sets."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        grams, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(grams), np.int64)
        rank[np.lexsort((grams, -counts))] = np.arange(len(grams))  # frequent first: paths are shared the longest
        self.words = len(grams)
        seqs = [np.sort(x) for x in np.split(rank[at], np.cumsum(sizes)[:-1])]
        self.order = sorted(range(len(sets)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.seqs = [seqs[i] for i in self.order]
        self.sizes = sizes[self.order]
        lcp = [0] * len(self.seqs)
        for i in range(1, len(self.seqs)):
            m = min(len(self.seqs[i - 1]), len(self.seqs[i]))
            off = np.flatnonzero(self.seqs[i - 1][:m] != self.seqs[i][:m])
            lcp[i] = int(off[0]) if len(off) else m
        lcp = np.array(lcp)
        #: low, high (leaves), depth from, depth to, smallest and largest size below, children
        self.nodes: list[list] = []
        todo = [(0, len(self.seqs), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = len(self.seqs[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
            me = len(self.nodes)
            self.nodes.append([lo, hi, depth, end, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), []])
            if parent >= 0:
                self.nodes[parent][6].append(me)
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == end)), hi]
                todo += [(int(a), int(b), end, me) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def linked(self) -> np.ndarray:
        """For each set the number of a set of its component: all links count, those inside a found component are not sought."""
        k = len(self.seqs)
        label, mask = np.arange(k), np.zeros(self.words, bool)
        central = np.argsort([s.mean() if len(s) else 0 for s in self.seqs], kind="stable")
        for i in map(int, central):
            if (label == label[i]).all():
                break
            x, n = self.seqs[i], len(self.seqs[i])
            mask[x] = True
            other = np.r_[0, np.cumsum(label != label[i])]
            todo = [(0, 0)]
            while todo:
                at, overlap = todo.pop()
                lo, hi, depth, end, least, most, below = self.nodes[at]
                if other[lo] == other[hi] or 100 * most < PERCENT * n or PERCENT * least > 100 * n:
                    continue
                seg = self.seqs[lo][depth:end]
                overlap += int(np.count_nonzero(mask[seg]))
                left = n - int(np.searchsorted(x, seg[-1], "right")) if len(seg) else n - overlap
                # links need (100 + PERCENT) * overlap >= PERCENT * (sum of sizes)
                if (100 + PERCENT) * (overlap + min(left, most - end)) < PERCENT * (n + least):
                    continue
                if below:
                    todo += [(c, overlap) for c in below]
                else:
                    label[label == label[lo]] = label[i]
                    other = np.r_[0, np.cumsum(label != label[i])]
            mask[x] = False
        out = np.empty(k, np.int64)
        out[self.order] = np.array(self.order)[label]
        return out


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b): for each set a set of its component, within each group of the frame."""
    out = []
    for _, g in pdf.groupby("root", sort=False):
        g = g.drop_duplicates("sig")
        sigs = g["sig"].to_numpy()
        to = Tree([unpack(x, np.uint64) for x in g["grams"]]).linked()
        out.append(pd.DataFrame({"a": sigs, "b": sigs[to]}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _pivot_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        linked = []
        for raw, other in zip(pdf["grams"], pdf["pivot_grams"], strict=True):
            x, y = unpack(raw, np.uint64), unpack(other, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pdf[["sig", "pivot"]].assign(linked=linked)


def _near(sets: DataFrame, rest: DataFrame, prefix: DataFrame) -> DataFrame:
    """(block, sig): the sets that may link with one of a block of `rest`, by a shared prefix 5-gram and by size."""
    asked = prefix.join(rest.select("sig", "block", "steps"), "sig").select("gram", "block", "steps").distinct()
    every = prefix.join(sets.select("sig", _steps().alias("_k")), "sig").select("gram", "sig", "_k")
    return every.join(asked, "gram").where(F.abs(F.col("_k") - F.col("steps")) <= 1).select("block", "sig").distinct()


def _steps() -> "F.Column":
    """Size class of a set: linked sets are in the same one or in neighbours."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) - 1e-9).cast("int")


def _blocks(sets: DataFrame, held: DataFrame, prefix: DataFrame, half: int) -> DataFrame:
    """The sets that did not link with their pivot, in blocks of about `half` sets or fewer that share rare 5-grams and sizes."""
    rare = prefix.groupBy("sig").agg(F.min("gram").alias("rare"))
    rest = sets.join(held.where("not linked").select("sig"), "sig").join(rare, "sig").withColumn("steps", _steps())
    crowd = stage(rest.groupBy("root", "rare", "steps").agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({"root": "_r", "rare": "_g", "steps": "_s"}), "join-crowd")
    rest = rest.join(crowd, (F.col("root") == F.col("_r")) & (F.col("rare") == F.col("_g")) & (F.col("steps") == F.col("_s")))
    piles = F.ceil(F.col("size") / half).cast("long")
    split = F.pmod(F.xxhash64("sig", F.lit(1)), F.ceil(F.col("c") / half).cast("long"))
    return rest.select("sig", "grams", "steps", F.xxhash64("root", F.pmod(F.xxhash64("rare"), piles), "steps", split).alias("block"))


def _large(sets: DataFrame, prefix: DataFrame, group: int) -> DataFrame:
    """Links in candidate groups of more than `group` sets (sig, n, grams, root, common, size), as edges (a, b).

    Every set is held against the group's most common one. What links to it is one component; the rest, in blocks that
    share rare 5-grams and sizes, is held against those sets of the group alone that share a prefix 5-gram with the block
    and are in a neighbouring size class, again in pieces: no task holds more than about `group` sets, and no link is lost.
    """
    sets = stage(sets, "join-large")
    pivots = sets.groupBy("root").agg(F.max_by("sig", F.struct("common", "sig")).alias("pivot"))
    pivots = pivots.join(sets.select(F.col("sig").alias("pivot"), F.col("grams").alias("pivot_grams")), "pivot")
    held = stage(sets.join(pivots, "root").select("sig", "grams", "pivot", "pivot_grams")
                 .mapInPandas(_pivot_batches, "sig long, pivot long, linked boolean"), "join-pivot")
    half = max(1, group // 2)
    rest = stage(_blocks(sets, held, prefix, half), "join-rest")
    near = stage(_near(sets, rest, prefix), "join-near-blocks")
    pieces = stage(near.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / half).cast("long").alias("pieces")), "join-pieces")
    mine = rest.join(pieces, "block").select("sig", "grams", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("j"))
    every = near.join(pieces, "block").withColumn("j", F.pmod(F.xxhash64("sig"), "pieces")).join(sets.select("sig", "grams"), "sig").select("sig", "grams", "block", "j")
    found = mine.unionByName(every).withColumn("root", F.lit(0)).groupBy("block", "j").applyInPandas(_links, "a long, b long")
    return held.where("linked").select(F.col("sig").alias("a"), F.col("pivot").alias("b")).unionByName(found)


def _classes(docs: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, Names]:
    """(id, th, sig, wide, n) of every row and how sets are named: no two sets have one sig. Texts are read once."""
    text = F.coalesce(docs[text_col], F.lit(""))
    seen = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    schema, names = f"id {docs.schema[id_col].dataType.simpleString()}, th long, sig long, wide binary, n long", Names(bits=bits)
    base = stage(seen.mapInArrow(lambda b, names=names: _class_batches(b, names), schema), "join-base")
    for _ in range(3):
        met = base.groupBy("sig").agg(F.min("wide").alias("x"), F.max("wide").alias("y")).where("x <> y").select("sig").collect()  # see Names for how many
        if not met:
            return base, names
        names = Names(names.taken | {r["sig"] for r in met}, bits)
        base = stage(base.mapInArrow(lambda b, names=names: _renamed(b, names), schema), "join-base")
    raise RuntimeError("different sets have one digest of 192 bits")


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(id, th, sig, wide, n) of every row, and (sig, root) of each set that is linked with another. bits: of a set's first name."""
    spark = docs.sparkSession
    small_batches(spark)
    base, names = _classes(docs, id_col, text_col, bits)
    total = base.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = int(max(1, -(-total * FIRST // TASK)))
    text = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    first = (text.mapInArrow(lambda b: _first_batches(b, slots, names), _FIRST)
             .groupBy("part").applyInPandas(_first_part, "sig long, n long, asked long, dup long, seen long"))
    of = first.groupBy("sig").agg(F.sum("asked").alias("asked"), F.max("n").alias("n"), F.sum("dup").alias("dup"), F.sum("seen").alias("seen"))
    alive = of.where(F.col("asked") - F.col("dup") <= F.col("seen") * F.floor((100 - PERCENT) * F.col("n") / 100)).select("sig")
    reps = base.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "th")).alias("r"))
    want = alive.join(reps, "sig").select("sig", F.col("r.id").alias("id"), F.col("r.th").alias("th"))
    seen = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    full = seen.join(want, (F.xxhash64("_text") == F.col("th")) & F.col("_id").eqNullSafe(F.col("id"))).select("_text", "sig")
    full = stage(full.mapInArrow(lambda b: _full_batches(b, names), "sig long, n long, grams binary"), "join-sets")
    asked = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(max(1, -(-asked // TASK)))
    blocked = full.withColumn("block", F.pmod(F.xxhash64("sig"), F.lit(parts)).cast("int"))
    shared = (blocked.groupBy("block").applyInPandas(lambda x: _tally(x, parts), "part int, block int, grams binary, df binary")
              .groupBy("part").applyInPandas(_sum_part, "block int, grams binary, df binary"))
    prefix = stage(blocked.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_prefixes, "gram long, sig long, common double"), "join-prefix")
    # staged, so that the join is of plain exchanges and a hot 5-gram can be split
    met = stage(prefix.groupBy("gram").agg(F.min("sig").alias("b"), F.max("sig").alias("_m")).where("b <> _m").select("gram", "b"), "join-met")
    near = stage(components(prefix.join(met, "gram").select(F.col("sig").alias("a"), "b")), "join-near")
    # only numbers meet by group, and the large groups are staged, so that the join can be split where one group is hot
    large = stage(near.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group), "join-sizes")
    near = near.join(large, "root", "left").select(F.col("node").alias("sig"), "root", F.coalesce("size", F.lit(0)).alias("size"))
    sets = full.join(near, "sig")
    tasks = spark.sparkContext.defaultParallelism * 4 + parts
    small = (sets.where(F.col("size") <= group).withColumn("part", F.pmod(F.xxhash64("root"), F.lit(tasks)))
             .select("part", "root", "sig", "grams").groupBy("part").applyInPandas(_links, "a long, b long"))
    links = small
    big = sets.where(F.col("size") > group)
    if not big.isEmpty():
        common = prefix.groupBy("sig").agg(F.max("common").alias("common"))
        links = links.unionByName(_large(big.join(common, "sig"), prefix, group))
    return base, components(links).withColumnRenamed("node", "sig")


def join_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, bits: int = 64) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two documents link when PERCENT * union <= 100 * intersection of their sets of distinct word 5-grams (A-Z lower-cased,
    words separated by [\\x20\\x09-\\x0D]; fewer words are one n-gram). Null and empty texts have an empty set and link
    with nothing. Repeated rows are one class. Null ids never name a component unless all its ids are null; empty tables
    give empty results; other columns are ignored; a text of any length is read whole by one task. 5-grams are compared by 64-bit hashes, sets of equal texts by 128.
    """
    base, roots = link_classes(docs, id_col, text_col, group, bits)
    of = base.where("n > 0").groupBy("sig").agg(F.min("id").alias("low")).join(roots, "sig", "left")
    # one row for each linked component, staged so that the join can be split where one component is hot
    named = stage(of.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id")), "join-named")
    by_sig = (of.withColumn("root", F.coalesce("root", "sig")).join(named, "root", "left")
              .select("sig", F.coalesce("component_id", "low").alias("component_id")))
    by_sig = stage(by_sig, "join-names")  # the same where one set has very many documents
    out = base.join(by_sig, "sig", "left")
    alone = F.col("n") == 0
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The documents that stay, one of each component (that with its smallest id), all columns as they were.

    Documents with empty sets all stay. Of rows that share the smallest id, that with the smallest text hash stays, and
    of rows equal in both, one.
    """
    base, roots = link_classes(docs, id_col, text_col, group)
    key = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("th").alias("th"))
    best = base.where("n > 0").groupBy("sig").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("c"))
    best = best.join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("k").alias("k"))
    want = stage(best.select(F.col("k.id").alias("_i"), F.col("k.th").alias("_t")), "join-kept")
    text = F.coalesce(docs[text_col], F.lit(""))
    packed = docs.select(F.struct("*").alias("_row"), docs[id_col].alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    empty = ~F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    again = base.where("n > 0").groupBy("id", "th").count().where("count > 1").select(F.col("id").alias("_i"), F.col("th").alias("_t"))
    hit = (F.col("_th") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_i"))
    kept = packed.where(~empty).join(want, hit, "left_semi")
    again = stage(again.join(want.withColumnsRenamed({"_i": "i", "_t": "t"}), (F.col("_t") == F.col("t")) & F.col("_i").eqNullSafe(F.col("i")), "left_semi"), "join-again")
    if not again.isEmpty():
        kept = kept.join(again, hit, "left_anti").unionByName(kept.join(again, hit, "left_semi").dropDuplicates(["_id", "_th"]))
    return packed.where(empty).unionByName(kept).select("_row.*")
