"""Column expressions over titles, durations and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: full-width forms U+FF01..U+FF5E and the ideographic space map to ASCII
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def normalize_title(text: Column) -> Column:
    """Full-width to ASCII (the compatibility mapping that matters for titles), one space, lower case."""
    ascii_forms = F.translate(text, _FULL, _HALF)
    return F.lower(F.trim(F.regexp_replace(ascii_forms, r"(?U)\s+", " ")))


def duration_seconds(text: Column) -> Column:
    """``MM:SS`` / ``HH:MM:SS``; other part counts use the last part; unreadable or blank is 0."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p).try_cast("bigint"))
    n = F.size(parts)
    readable = F.forall(parts, lambda p: p.isNotNull())
    last = F.element_at(parts, -1)
    value = (
        F.when(n == 2, F.get(parts, F.lit(0)) * 60 + last)
        .when(n == 3, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + last)
        .otherwise(last)
    )
    return F.when(readable, value).otherwise(0).cast("double")


def publish_time_iso(epoch: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(epoch > 0, stamp).otherwise("")


def keyword_hits(lowered: Column, keywords: Sequence[str]) -> Column:
    """Keywords contained in the (already lower-cased) text, in keyword order."""
    if not keywords:
        return F.array().cast("array<string>")
    tests = [F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*tests))


def first_n(hits: Column, n: int) -> Column:
    return F.array_join(F.slice(hits, 1, n), ", ")


def python_round(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, as Python does.

    The product with ``10 ** digits`` is taken with its rounding error (the value is split in two halves
    whose products are exact), so that a value is only a tie if it is one in binary.
    """
    x, scale = value.cast("double"), float(10**digits)
    big = x * 134217729.0
    high = big - (big - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    side = (product - below - 0.5) + error
    up = (side > 0) | ((side == 0) & (F.pmod(below, F.lit(2.0)) == 1))
    return F.when(F.abs(product) < 4503599627370496.0, F.when(up, below + 1).otherwise(below) / scale).otherwise(x)
