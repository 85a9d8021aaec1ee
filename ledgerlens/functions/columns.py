"""Column expressions: rates, intervals, time parts and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value in CSV input, the public default list of the reader whose results are matched.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_ISO = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?)?)?$"


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return rate(part, whole) * 100


def wilson(f: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of f successes in n, from the counts; null where n is 0."""
    hits, trials, zz = f.cast("double"), F.nullif(n.cast("double"), F.lit(0.0)), z * z
    middle = F.try_divide(hits + zz / 2, trials + zz)
    spread = F.sqrt(F.greatest(F.try_divide(hits * (trials - hits), trials) + zz / 4, F.lit(0.0)))
    half = F.try_divide(z * spread, trials + zz)
    return middle - half, middle + half


def hash52(seed: int, key: Column) -> Column:
    """52 bits of the MD5 of seed and key, exact as a double; a null key hashes as an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def parse_iso(text: Column, strict: bool = True) -> Column:
    """Timestamp without zone of an ISO-8601 text, null where it is none.

    Strict parsing takes the extended form without offset only; otherwise whatever a timestamp_ntz cast takes.
    """
    parsed = text.try_cast("timestamp_ntz")
    return F.when(text.rlike(_ISO), parsed) if strict else F.when(~text.rlike(r"^\s*T?\d{1,2}:"), parsed)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def weekday_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def week_start(ts: Column) -> Column:
    """Midnight of the week's Monday."""
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def no_token(text: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~text.isin(*tokens), text)


def label(feature: Column, category: Column) -> Column:
    return F.concat_ws(" = ", feature, F.coalesce(category, F.lit("missing")))


def one(target: Column) -> Column:
    """A 0/1 or boolean target as a long."""
    return target.cast("int").cast("long")
