"""Counts that come out of a write, instead of out of another pass over what was written.

Spark may run a task before a shuffle again when an executor is lost, and its observed counts would then be added twice.
So an observation belongs above the last shuffle of the job that writes: there each task counts once. Hence two writes:
the parsed rows as they came (no shuffle), and the cleaned ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import one, parse_iso
from ..spec import TableSpec
from .clean import negative


@dataclass(frozen=True)
class RawCounts:
    """Rows, missing values by column, rows by class (None: no label), amounts and times of a raw table."""

    rows: int
    missing: dict[str, int]
    classes: dict[int | None, int]
    negative_amounts: int
    zero_amounts: int
    unreadable_times: int


@dataclass(frozen=True)
class CleanCounts:
    """Rows after each step of cleaning, and what was written."""

    distinct_rows: int
    negative_amounts: int
    unreadable_times: int
    final_rows: int
    positive_rows: int
    missing: dict[str, int]


def _observed(df: DataFrame, counts: dict) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[F.coalesce(c.cast("long"), F.lit(0)).alias(k) for k, c in counts.items()]), seen


def observe_raw(df: DataFrame, spec: TableSpec):
    """df to be written without a shuffle, and a function that gives its RawCounts once it is."""
    y = one(F.col(spec.target))
    names = {f"m{i}": c for i, c in enumerate(df.columns)}
    out, seen = _observed(df, {"n": F.count(F.lit(1)), "y1": F.count_if(y == 1), "y0": F.count_if(y == 0), "neg": F.count_if(negative(spec)), "zero": F.count_if(F.col(spec.amount) == 0),
                               "lost": F.count_if(parse_iso(F.col(spec.timestamp)).isNull()), **{k: F.count_if(F.col(c).isNull()) for k, c in names.items()}})

    def counts() -> RawCounts:
        g = seen.get
        none = g["n"] - g["y0"] - g["y1"]
        return RawCounts(g["n"], {c: g[k] for k, c in names.items()}, {k: v for k, v in ((0, g["y0"]), (1, g["y1"]), (None, none)) if v}, g["neg"], g["zero"], g["lost"])

    return out, counts


def clean_observed(df: DataFrame, spec: TableSpec, *, strict_iso: bool = True, out: str = "event_timestamp"):
    """The cleaned rows of a raw table (see clean.clean), and a function that gives their CleanCounts once they are written.

    Distinct rows are counted above the shuffle that finds them, removals on the rows that reach each step.
    """
    distinct, first = _observed(df.dropDuplicates(), {"n": F.count(F.lit(1)), "neg": F.count_if(negative(spec))})
    timed, second = _observed(distinct.where(~negative(spec)).withColumn(out, parse_iso(F.col(spec.timestamp), strict_iso)), {"lost": F.count_if(F.col(out).isNull())})
    names = {f"m{i}": c for i, c in enumerate(spec.gold)}
    kept, third = _observed(timed.where(F.col(out).isNotNull()), {"n": F.count(F.lit(1)), "y1": F.count_if(one(F.col(spec.target)) == 1),
                                                                  **{k: F.count_if(F.col(c).isNull()) for k, c in names.items()}})

    def counts() -> CleanCounts:
        a, b, c = first.get, second.get, third.get
        return CleanCounts(a["n"], a["neg"], b["lost"], c["n"], c["y1"], {v: c[k] for k, v in names.items()})

    return kept, counts
