"""Near duplicates among embedding vectors by sorted projection passes.

Each pass hashes every distinct vector to the signs of its products with random directions of its own, and orders all
vectors lexicographically by the concatenated signs. Only keys and row numbers are sorted; a vector's places in all passes
then bring it, once a pass, to the block of that place. A block of the order is compared within windows of WINDOW
neighbours (the first rows of the next block included), and the pairs that pass the test of the cosine are united: what
leaves a block is a spanning forest of them. Passes are as many as find a pair at the threshold with probability RECALL,
by the number of vectors.

A window is bounded, and a crowd of near copies is not. So links are not counted in windows but within the components that
the passes found, where every pair of vectors counts: small components are compared whole in one task. In a larger one
each vector's angle to the component's mean is taken. Two vectors within half of the threshold's angle of it are linked for sure
(triangle inequality), so that the core of a crowd is counted, not compared; vectors outside the core are held against
all others in blocks. Pairs are counted where they are found; no list of pairs is ever written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .vectors import whole

#: Neighbours that a vector is compared with after it in an order; rows of a block; bits of a key.
WINDOW, BLOCK, BITS = 64, 2048, 63
#: Probability that a pair at the threshold comes within a window in some pass, for directions drawn anew.
RECALL = 0.97
#: Vectors of a component that one task compares whole; rows of a block of a larger one.
WHOLE, CELL = 256, 2048
#: Angles closer to a bound than this are not decided by the triangle inequality.
SLACK = 1e-6


def passes_for(n: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared a window with probability `recall`.

    A pass separates n vectors into windows by about log2(n / window) leading bits, and a bit of two vectors at angle t
    agrees with probability 1 - t / pi.
    """
    bits = max(1.0, math.log2(max(2.0, n / window)))
    hit = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))


def directions(number: int, width: int, seed: int) -> np.ndarray:
    """(width, BITS) random directions of a pass."""
    return np.random.default_rng([seed, number, width]).standard_normal((width, BITS))


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a column of packed doubles, zeros after the end of shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.to_pylist()
    if all(len(x) == 8 * width for x in raw):
        x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)
    else:
        x = np.zeros((len(raw), width))
        for i, r in enumerate(raw):
            x[i, : len(r) // 8] = np.frombuffer(r, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=5e-324)  # squares of tiny or huge numbers stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each of n nodes' least node of its component under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, root):
            return root
        root = now


def _pack(batches):
    """Vectors as packed doubles without zeros at the end, none where all are zero; -0.0 is 0.0."""
    for b in batches:
        out = [np.trim_zeros(np.asarray(x, np.float64) + 0.0, "b").tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])


def _ranked(classes: DataFrame, width: int, passes: int, seed: int) -> DataFrame:
    """node, places: the places of each vector in the orders of all passes, counted through all passes."""

    def keys(batches):
        for b in batches:
            u = _units(b.column(1), width)
            for p in range(passes):
                bits = (u @ directions(p, width, seed) > 0).astype(np.int64)
                key = bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(key), p, np.int32)), pa.array(key)], names=["node", "pass", "key"])

    keyed = stage(classes.select("node", "vec").mapInArrow(keys, "node long, pass int, key long"), "near-keys")
    order = ["pass", "key", "node"]
    placed = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("node", F.monotonically_increasing_id().alias("at")), "near-order")
    part = F.shiftright("at", 33)
    # one row a partition of the sort
    upto = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).selectExpr("part", "sum(n) over (order by part) - n as before")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("part", part).join(F.broadcast(upto), "part").select("node", rank.alias("rank"))
    return ranked.groupBy("node").agg(F.collect_list("rank").alias("places"))  # `passes` places each


def _united(classes: DataFrame, width: int, threshold: float, passes: int, seed: int) -> DataFrame:
    """(a, b): a spanning forest, block by block, of the pairs that windows found and the cosine confirmed."""
    n = F.col("rank")
    block = F.floor(n / BLOCK)
    places = stage(_ranked(classes, width, passes, seed), "near-places")
    moved = (classes.select("node", "vec").join(places, "node").withColumn("rank", F.explode("places")).drop("places")
             .withColumn("block", F.explode(F.when((n % BLOCK < WINDOW) & (n >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block)))))

    def compare(block: pa.Table) -> pa.Table:
        order = np.argsort(block["rank"].to_numpy(), kind="stable")
        node, u = block["node"].to_numpy()[order], _units(block["vec"], width)[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(u), WINDOW):
            x, y = np.nonzero(u[i : i + WINDOW] @ u[i : i + 2 * WINDOW].T >= threshold)
            ok = (y > x) & (y - x <= WINDOW)
            a.append(x[ok] + i)
            b.append(y[ok] + i)
        # rows of two passes can meet in a block: a node may be there twice, as a pair with itself
        root = forest(np.concatenate(a), np.concatenate(b), len(u))
        ok = node != node[root]
        return pa.table({"a": node[ok], "b": node[root][ok]})

    return moved.select("block", "rank", "node", "vec").groupBy("block").applyInArrow(compare, "a long, b long")


def _linked(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, n): for each node of a component, the rows of other nodes of it that its cosine links.

    members: root, node, vec, copies; components of two nodes at least.
    """
    sizes = stage(members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("rows")), "near-sizes")
    sized = stage(members.join(sizes, "root"), "near-sized")
    reach = math.acos(threshold)

    def compare(group: pa.Table) -> pa.Table:
        u, copies = _units(group["vec"], width), group["copies"].to_numpy().astype(np.float64)
        n = np.concatenate([(u[i : i + 512] @ u.T >= threshold) @ copies for i in range(0, len(u), 512)])
        # a vector's product with itself can be anything near 1: it is no link in any case
        own = ((u * u).sum(axis=1) >= threshold) * copies
        return pa.table({"node": group["node"], "n": np.rint(n - own).astype(np.int64)})

    small = sized.where(F.col("size") <= WHOLE).groupBy("root").applyInArrow(compare, "node long, n long")
    crowd = sized.where(F.col("size") > WHOLE)

    def add(batches):
        for b in batches:
            root = b.column(0).to_numpy()
            u, c = _units(b.column(1), width), b.column(2).to_numpy()
            for r in np.unique(root):
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([((u * c[:, None])[root == r]).sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["root", "total"])

    # sums of some batches each; at most a row a batch and component, of components above WHOLE
    sums = crowd.select("root", "vec", "copies").mapInArrow(add, "root long, total array<double>")
    centre = (sums.select("root", F.posexplode("total").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
              .groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")))
    centre = stage(centre, "near-centres")

    def angles(batches):
        for b in batches:
            u = _units(b.column("vec"), width)
            c = np.asarray(b.column("centre").to_pylist(), np.float64).reshape(len(u), width)
            length = np.sqrt((c * c).sum(axis=1))
            cos = np.where(length > 0, (u * c).sum(axis=1) / np.where(length > 0, length, 1.0), -1.0)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("root", "node", "vec", "copies")), pa.array(np.arccos(np.clip(cos, -1.0, 1.0)))],
                                             names=["root", "node", "vec", "copies", "angle"])

    turned = stage(crowd.join(centre, "root").select("root", "node", "vec", "copies", "centre")
                   .mapInArrow(angles, "root long, node long, vec binary, copies long, angle double"), "near-angles")
    core = F.col("angle") <= reach / 2 - SLACK
    inner = stage(turned.groupBy("root").agg(F.sum(F.when(core, F.col("copies")).otherwise(0)).alias("core"), F.count_if(~core).alias("rim"),
                                            F.count(F.lit(1)).alias("size")), "near-cores")
    sure = turned.where(core).join(inner, "root").select("node", (F.col("core") - F.col("copies")).alias("n"))
    # vectors outside the core against all: a block of the rim meets each block of the component; both sides learn of a link
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CELL)).cast("long")
    spread = lambda c, s: F.pmod(F.xxhash64("node", F.lit(s)), blocks(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), blocks(c) - 1))
    both = turned.join(inner.where("rim > 0"), "root")
    rim = both.where(~core).withColumn("r", spread("rim", 1)).withColumn("m", each("size"))
    rest = both.withColumn("m", spread("size", 2)).withColumn("r", each("rim")).withColumn("inside", core)

    def meet(edge: pa.Table, whole_: pa.Table) -> pa.Table:
        if not len(edge) or not len(whole_):
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        near, all_ = edge["angle"].to_numpy(), whole_["angle"].to_numpy()
        # vectors whose angles to the centre differ by more than the threshold's are no links
        some = (all_ >= near.min() - reach - SLACK) & (all_ <= near.max() + reach + SLACK)
        whole_ = whole_.filter(pa.array(some))
        u, v = _units(edge["vec"], width), _units(whole_["vec"], width)
        hit = (u @ v.T >= threshold) & (edge["node"].to_numpy()[:, None] != whole_["node"].to_numpy()[None, :])
        to_rim = hit @ whole_["copies"].to_numpy().astype(np.float64)
        inside = whole_["inside"].to_numpy(zero_copy_only=False)
        to_core = edge["copies"].to_numpy().astype(np.float64) @ hit[:, inside]
        return pa.table({"node": np.concatenate([edge["node"].to_numpy(), whole_["node"].to_numpy()[inside]]),
                         "n": np.rint(np.concatenate([to_rim, to_core])).astype(np.int64)})

    outer = (stage(rim.select("r", "m", "root", "node", "vec", "copies", "angle"), "near-rim").groupBy("root", "r", "m")
             .cogroup(rest.select("r", "m", "root", "node", "vec", "copies", "angle", "inside").groupBy("root", "r", "m")).applyInArrow(meet, "node long, n long"))
    return small.unionByName(sure).unionByName(outer).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 passes: int | None = None, seed: int = 20240607) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Rows link where the cosine (double precision) is `threshold` or more.

    component_id is the smallest id reachable by links, kept says whether that is the row's own, n_links counts the other
    rows linked directly. No link below the threshold is ever made, and within a component all are counted; a pair is
    missed only where no pass brings it, or a chain of links between its ends, into one window (see passes_for).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, a component of
    their own. Equal vectors link with one another whatever the rounding and are compared as one. Vectors of unequal
    lengths are compared as if padded with zeros. Null ids are kept (a component of rows without ids has a null id, and
    its rows count as kept); repeated ids are rows of their own. Empty tables give empty results; further columns are
    ignored, whatever their names. `threshold` is above 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold of the cosine is above 0 and at most 1")
    v = vectors
    vector = v[vector_col].cast("array<double>")
    usable = whole(v[vector_col]) & F.exists(vector, lambda x: x != 0)
    id_type = v.schema[id_col].dataType.simpleString()
    packed = stage(v.where(usable).select(v[id_col].alias("id"), vector.alias("x")).mapInArrow(_pack, f"id {id_type}, vec binary"), "near-rows")
    # equal vectors are one node, numbered in the written table
    classes = stage(packed.groupBy("vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
                    .select(F.monotonically_increasing_id().alias("node"), "vec", "copies", "least"), "near-classes")
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    width = (width or 8) // 8
    root = stage(components(_united(classes, width, threshold, passes or passes_for(n, threshold), seed)), "near-roots")
    members = stage(classes.join(root, "node"), "near-members")
    links = _linked(members.select("root", "node", "vec", "copies"), width, threshold)
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    about = stage(members.select("node", "root").join(least, "root").join(links, "node", "left").select("node", "component", "n"), "near-links")
    named = stage(classes.join(about, "node", "left")
                  .select("vec", F.coalesce("component", "least").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")), "near-named")
    found = packed.join(named, "vec").select(F.col("id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = v.where(~usable | usable.isNull()).select(v[id_col].alias("id"), F.lit(0).cast("long").alias("n_links"), v[id_col].alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
