"""Scalar column functions. All stay inside the JVM; times are naive (timestamp_ntz) and the session time zone is UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Retrieval


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def tick(ts: Column | str, step_minutes: int = 1) -> Column:
    """Number of the bucket of step_minutes since the epoch; neighbouring buckets differ by one."""
    return F.floor(epoch_seconds(ts) / F.lit(60 * step_minutes)).cast("long")


def tick_start(number: Column | str, step_minutes: int = 1) -> Column:
    return from_epoch_seconds(col(number) * F.lit(60 * step_minutes))


def parse_number(c: Column | str) -> Column:
    """A decimal number in a string, else null: `5.0E`, `NaN`, `Infinity` and `5d` aren't numbers."""
    text = F.trim(col(c))
    ok = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(ok, text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_feed_time(c: Column | str) -> Column:
    """`M/D/YYYY H:MM` or `M/D/YYYY`. Fields out of range give null; they don't roll over."""
    text = F.trim(col(c))
    when = F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")), F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    return when.cast("timestamp_ntz")


def hole_size(c: Column | str) -> Column:
    """`12-1/4"`, `6 1/8` or `8.5` anywhere in a text as a decimal string of at most three places; null without digits."""
    text = F.replace(col(c), F.lit('"'), F.lit(""))
    # Fixed value: how mixed numbers are written.
    mixed = r"(\d+)\s*[-\s]\s*(\d+)\s*/\s*(\d+)"
    part = [F.regexp_extract(text, mixed, k).try_cast("double") for k in (1, 2, 3)]
    plain = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    value = F.coalesce(F.when(part[2] != 0, part[0] + F.try_divide(part[1], part[2])), plain)
    digits = F.round(value, 3).cast("decimal(12,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", "")


def tokens(c: Column | str, cfg: Retrieval = Retrieval()) -> Column:
    """Lower-case tokens of [a-z0-9./'-], stripped of edge punctuation, 2 to 24 long and no stop words, in order."""
    # Punctuation goes at a token's ends, over the whole text at once; after that only short lambdas run by token.
    edges = r"(?<![a-z0-9./'-])[.'-]+|[.'-]+(?![a-z0-9./'-])"
    words = F.split(F.regexp_replace(F.lower(col(c)), edges, " "), r"[^a-z0-9./'-]+")
    return F.filter(words, lambda w: F.length(w).between(2, 24) & ~w.isin(*sorted(cfg.stop)))


def truncated(c: Column | str, length: int = 400) -> Column:
    return F.when(F.length(col(c)) > length, F.concat(F.substring(col(c), 1, length), F.lit("..."))).otherwise(col(c))


def half_up(c: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(c + 0.5)


def night(ts: Column | str) -> Column:
    """18:00 to 06:00."""
    hour = F.hour(col(ts))
    return (hour >= 18) | (hour < 6)


def in_shift(ts: Column | str, shift: str) -> Column:
    return night(ts) if shift == "night" else ~night(ts)


def stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm")


def short_stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "MM/dd HH:mm")


def against_limit(actual: Column | str, limit: Column | str) -> Column:
    """struct(actual, limit, over_pct, exceeded), or null where there is no limit."""
    a, top = col(actual), col(limit)
    over = F.round(F.try_divide(a - top, top) * 100, 1)
    return F.when(top.isNotNull() & (top != 0), F.struct(a.alias("actual"), top.alias("limit"), over.alias("over_pct"), (a > top).alias("exceeded")))


def phase_label(*phases: Column | str) -> Column:
    return F.concat_ws(" / ", *(F.nullif(F.trim(col(p)), F.lit("")) for p in phases))


def severity(value: Column, watch: float, warn: float, alarm: float) -> Column:
    """Threshold ladder; null below `watch`."""
    return F.when(value >= alarm, "ALARM").when(value >= warn, "WARN").when(value >= watch, "WATCH")


def array_quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation at (n - 1) q of an ascending array; null if it is empty."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low, high = (F.get(sorted_values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return F.when(F.size(sorted_values) > 0, low + (high - low) * (at - F.floor(at)))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once a row, however often it is named and in lambdas too."""
    return F.get(F.transform(F.array(value), use), 0)


def snippet(text: Column | str, terms: Column, width: int = 240, stride: int = 20) -> Column:
    """The first window of `width` characters that holds most of the terms, by containment."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(col(text), r"\s*\n\s*", " / "), r"\s{2,}", " "))
    starts = F.sequence(F.lit(0), F.greatest(F.length(clean) - 41, F.lit(0)), F.lit(stride))
    found = F.transform(
        starts,
        lambda s: F.struct(
            (-F.size(F.filter(terms, lambda t: F.contains(F.lower(F.substr(clean, s + 1, F.lit(width))), t)))).alias("miss"), s.alias("at")
        ),
    )
    at = F.array_min(found)["at"]
    window = F.trim(F.substr(clean, at + 1, F.lit(width)))
    dots = F.lit("...")
    best = F.concat(F.when(at > 0, dots).otherwise(""), window, F.when(at + width < F.length(clean), dots).otherwise(""))
    head = F.concat(F.substring(clean, 1, width), dots)
    return F.when(F.length(clean) <= width, clean).when(F.size(terms) == 0, head).otherwise(best)
