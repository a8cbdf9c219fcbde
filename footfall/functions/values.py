"""Clamps, ratios and segment values as column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.urls import CONTROL, cleaned, text_or_empty

MONEY_LIMIT = "999999999999.99"
CREDIT_LIMIT = "99999999.9999"
MAX_DWELL_MS = 3_600_000
MAX_EVENT_VALUE = 1_000_000_000
SEGMENTS_PER_HIT = 5
DIMENSION_LENGTH = 500


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def event_value(x: Column) -> Column:
    """Rounded to cents and clamped to a thousand million either way; null for anything that is no number."""
    n = x.try_cast("double")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    clamped = F.greatest(F.least(n, F.lit(float(MAX_EVENT_VALUE))), F.lit(-float(MAX_EVENT_VALUE)))
    return F.when(finite, F.round(clamped, 2).cast("decimal(14,2)"))


def event_name(x: Column) -> Column:
    name = cleaned(x, 120)
    return F.when(name != "", name)


def target(x: Column) -> Column:
    """An http or https address of at most 500 characters, else null."""
    scheme = F.try_parse_url(x, F.lit("PROTOCOL"))
    return F.when(scheme.isin("http", "https"), F.left(x, F.lit(500)))


def dwell(x: Column) -> Column:
    ms = F.floor(x.try_cast("double")).cast("long")
    return F.when(ms.isNull() | (ms < 0), 0).when(ms > MAX_DWELL_MS, MAX_DWELL_MS).otherwise(ms).cast("long")


def scroll_bucket(x: Column) -> Column:
    n = x.try_cast("double").cast("int")
    return F.when(n.isin(25, 50, 75, 100), n)


def dimension(x: Column) -> Column:
    return F.left(x, F.lit(DIMENSION_LENGTH))


def saturated(total: Column, limit: str, kind: str) -> Column:
    """A sum held within its column: at the limit instead of past it."""
    edge = F.lit(limit).cast("decimal(38,4)")
    return F.greatest(F.least(total.cast("decimal(38,4)"), edge), -edge).cast(kind)


def ratio(part: Column, whole: Column) -> Column:
    """Percentage, 0 where there is no whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0)).cast("double")


def mean(total: Column, count: Column) -> Column:
    """Rounded mean, 0 where there is nothing to average."""
    return F.when(count > 0, F.round(total / count)).otherwise(F.lit(0)).cast("long")


def delta(current: Column, previous: Column) -> Column:
    """Change in per cent, null where there was nothing before."""
    return F.when(previous > 0, (current - previous) / previous * 100).cast("double")


@dataclass(frozen=True)
class Segment:
    key: str
    values: tuple[str, ...] | None = None
    from_beacon: bool = False
    label: str = ""


def segment_value(x: Column, segment: Segment) -> Column:
    """A declared value in its declared spelling, or any value in lower case where none are declared."""
    value = F.left(F.trim(F.regexp_replace(text_or_empty(x), CONTROL, "")), F.lit(100))
    if segment.values is None:
        return F.when(value != "", F.lower(value))
    out = F.when(F.lit(False), F.lit(""))
    for declared in segment.values:
        out = out.when(F.lower(value) == declared.lower(), declared)
    return out


def resolve_segments(beacon: Column, server: Column, segments: tuple[Segment, ...]) -> Column:
    """map<string,string> of at most five segments in the order of their declaration; the server's word wins."""
    entries = []
    for s in segments:
        own = segment_value(F.element_at(server, s.key), s)
        entries.append(F.struct(F.lit(s.key).alias("key"), (F.coalesce(own, segment_value(F.element_at(beacon, s.key), s)) if s.from_beacon else own).alias("value")))
    if not entries:
        return F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    kept = F.slice(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()), 1, SEGMENTS_PER_HIT)
    return F.map_from_entries(kept)


def segment_dimension(key: Column, value: Column) -> Column:
    return F.concat(key, F.lit(":"), value)


def segment_parts(dimension_value: Column) -> tuple[Column, Column]:
    parts = F.split(dimension_value, ":", 2)
    return parts[0], F.get(parts, F.lit(1))


def clamp_limit(limit: int, most: int = 200) -> int:
    return max(1, min(most, limit))
