"""Selection of ranks by radix histograms: exact order statistics that move sums, never values.

Numbers become 64-bit keys of the same order. A round counts rows by the leading bits of their keys, in each task first,
so that some thousand sums a group move whatever the number of rows or of different values. Sums say in which bucket each
wanted rank lies; only those buckets are counted by further bits, until few rows are left or the key is known in full.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the first round and of later ones; with so few rows left in the wanted buckets, they are counted by whole keys.
FIRST, NEXT, FEW = 12, 9, 20_000
#: Groups whose sums the driver takes; callers have a distributed way for more.
GROUPS = 200


def keyed(rows: DataFrame) -> DataFrame:
    """(_g, _k) of the rows of (_g, _x) whose double _x is a number: a long that sorts as the double does.

    Equal numbers have equal keys (zeros of both signs are one). The key is the IEEE 754 pattern of the absolute value,
    negated for numbers below zero. Steps are columns of their own, so that none is computed twice.
    """
    ax, guess, exponent = F.col("_ax"), F.col("_guess"), F.col("_exponent")
    power = F.pow(F.lit(2.0), guess.cast("double"))
    # in two steps, since 2^-exponent alone can be out of range
    part = ax * F.pow(F.lit(2.0), -F.col("_half")) * F.pow(F.lit(2.0), F.col("_half") - exponent)
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + ((part - 1) * float(1 << 52)).cast("long")
    tiny = (ax * 2.0**1000 * 2.0**74).cast("long")  # below the least normal number: a whole multiple of 2^-1074
    size = F.when(ax == 0, F.lit(0).cast("long")).when(ax == float("inf"), F.lit(2047 << 52)).when(ax < 2.0**-1022, tiny).otherwise(normal)
    return (rows.where("_x is not null and not isnan(_x)").withColumn("_ax", F.abs("_x"))
            .withColumn("_guess", F.when((ax > 0) & (ax < float("inf")), F.floor(F.log2(ax))).otherwise(0))
            .withColumn("_exponent", F.when(power > ax, guess - 1).when(power * 2 <= ax, guess + 1).otherwise(guess).cast("double"))  # a logarithm rounds
            .withColumn("_half", F.floor(exponent / 2).cast("double")).withColumn("_size", size)
            .select("_g", F.when(F.col("_x") < 0, -F.col("_size")).otherwise(F.col("_size")).alias("_k")))


def key_double(key: int) -> float:
    """The number of a key."""
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


@dataclass
class Ranks:
    """Of each group its rows, and for wanted ranks (from 0) the key, the rows below that key and those that have it."""

    total: dict[Hashable, int] = field(default_factory=dict)
    at: dict[Hashable, dict[int, tuple[int, int, int]]] = field(default_factory=dict)
    #: Sums that came to the driver, in all rounds.
    sums: int = 0


def select_ranks(rows: DataFrame, wanted: Callable[[int], list[int]]) -> Ranks | None:
    """Keys at wanted ranks of each group; None where there are more than GROUPS of them.

    rows: (_g, _k), keys long and not null; wanted: ranks from 0 by the group's rows.

    At most 2^FIRST sums a group, and 2^NEXT a wanted bucket, come to the driver in a round, and a row a wanted bucket goes
    back. Rows are read once a round: three times for a million values, four for a million million, eight at most.
    """
    out, spread = Ranks(), 1
    kind = rows.schema["_g"].dataType
    groups = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).limit(GROUPS + 1).collect()
    if len(groups) > GROUPS:
        return None
    for r in groups:
        out.total[r["_g"]] = r["n"]
        spread = max(spread, (r["hi"] - r["lo"]).bit_length())
    ranks = {g: sorted({k for k in wanted(n) if 0 <= k < n}) for g, n in out.total.items()}
    shift, before = max(0, spread - FIRST), None
    active: dict[Hashable, dict[int, int]] = {}  # of each group: bucket -> rows below it
    while any(ranks.values()):
        some = rows.select("_g", F.shiftright("_k", shift).alias("_b"), *([] if before is None else [F.shiftright("_k", before).alias("_p")]))
        if before is None:
            sums = some.withColumn("_p", F.lit(0).cast("long")).groupBy("_g", "_p", "_b").agg(F.count(F.lit(1)).alias("n")).collect()
        else:
            schema = T.StructType([T.StructField("_a", kind), T.StructField("_q", T.LongType())])
            few = rows.sparkSession.createDataFrame([(g, b) for g, buckets in active.items() for b in buckets], schema)
            # a row a wanted bucket; null-safe, so that no condition on the key is pushed below the steps that compute it
            hit = some.join(F.broadcast(few), F.col("_g").eqNullSafe(F.col("_a")) & F.col("_p").eqNullSafe(F.col("_q")), "left_semi")
            sums = hit.groupBy("_g", "_p", "_b").agg(F.count(F.lit(1)).alias("n")).collect()
        out.sums += len(sums)
        children: dict[Hashable, list[tuple[int, int, int]]] = {}
        for r in sums:
            children.setdefault(r["_g"], []).append((r["_b"], r["_p"], r["n"]))
        found, left = {}, 0
        for g, wants in ranks.items():
            upto, parent, spans = 0, None, []
            for b, p, n in sorted(children.get(g, [])):
                if before is not None and p != parent:
                    parent, upto = p, active[g][p]
                spans.append((upto, b, n))
                upto += n
            i, mine = 0, {}
            for k in wants:
                while spans[i][0] + spans[i][2] <= k:
                    i += 1
                mine[k] = spans[i]
            found[g] = mine
            left += sum(n for _, n in {(b, n) for _, b, n in mine.values()})
        if shift == 0:
            out.at = {g: {k: (b, below, n) for k, (below, b, n) in mine.items()} for g, mine in found.items()}
            return out
        active = {g: {b: below for below, b, _ in mine.values()} for g, mine in found.items()}
        before, shift = shift, 0 if left <= FEW else max(0, shift - NEXT)
    out.at = {g: {} for g in ranks}
    return out


def interpolated(n: int, p: float) -> tuple[int, int, float]:
    """Ranks between which the quantile p of n sorted values lies, and how far along, linearly."""
    h = (n - 1) * p
    low = int(h)
    return low, min(n - 1, low + (h > low)), h - low


def select_quantiles(rows: DataFrame, probabilities: list[float], number: Callable[[int], float] = key_double) -> dict[Hashable, list[float]] | None:
    """Of each group of (_g, _k) its quantiles with linear interpolation, None for more than GROUPS; number: the value of a key."""
    got = select_ranks(rows, lambda n: [k for p in probabilities for k in interpolated(n, p)[:2]])
    if got is None:
        return None
    out = {}
    for g, n in got.total.items():
        out[g] = []
        for p in probabilities:
            low, high, part = interpolated(n, p)
            a, b = number(got.at[g][low][0]), number(got.at[g][high][0])
            out[g].append(a if a == b else a + (b - a) * part)
    return out
