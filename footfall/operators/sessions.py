"""Inactivity sessions from hits, with goals and campaign touches.

A session is a run of one visitor's hits with no gap of `window` seconds or more. Crawlers take no part. A run
without a counted view is no session, and hits before its first counted view do not belong to it.

Hits are summed up to summaries that add up further: a summary of hits and one of later hits make the summary of
both. A batch of hits becomes its sessions in one aggregate; a stream keeps the summaries of sessions that may still
go on and adds each batch's to them (`merged`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.goals import Definitions, at_close, live_goals

KEYS = ("site_id", "session_key")
#: What summaries of the stream hold, as the store keeps them.
SUMMARY = (
    "site_id int, session_key string, first struct<path:string,visitor_hash:string,referrer:string,user_agent:string>, "
    "first_at struct<ts:timestamp,seq:bigint>, last_path string, last_at struct<ts:timestamp,seq:bigint>, pageviews bigint, "
    "touches array<struct<at:struct<ts:timestamp,seq:bigint>,name:struct<s:string,m:string,c:string,t:string,o:string>>>, "
    "place struct<at:struct<ts:timestamp,seq:bigint>,country:string,region:string>, max_scroll int, "
    "segments array<struct<at:struct<ts:timestamp,seq:bigint>,name:string,value:string>>, "
    "goals array<struct<at:struct<ts:timestamp,seq:bigint>,id:int,name:string>>"
)


def is_view() -> Column:
    """A hit that counts as a view."""
    return (F.col("kind") == "view") & F.col("count_view")


def _runs(hits: DataFrame, window: int) -> DataFrame:
    """Hits with `session_no`, counted from 1 for each key, and `viewed`: at or after the run's first counted view.

    One shuffle by session key serves the gap test, the running count and the trim alike.
    """
    order = Window.partitionBy(*KEYS).orderBy("ts", "seq")
    gap = F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(order)
    marked = hits.where(F.col("kind") != "crawler").withColumn("_new", F.when(gap.isNull() | (gap >= window), 1).otherwise(0))
    runs = marked.withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    in_run = Window.partitionBy(*KEYS, "session_no").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("viewed", F.max(is_view()).over(in_run))


def numbered(hits: DataFrame, window: int) -> DataFrame:
    """Hits of sessions with `session_no`."""
    return _runs(hits, window).where("viewed").drop("viewed")


def acquisition(hits: DataFrame, window: int) -> DataFrame:
    """Counted views with the referrer and campaign their session arrived by."""
    own = numbered(hits, window)
    first = Window.partitionBy(*KEYS, "session_no").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return own.select("*", F.first("referrer").over(first).alias("arrived_from"), F.first("campaign", ignorenulls=True).over(first).isNotNull().alias("by_campaign")).where(is_view())


def _firsts(found: Column) -> Column:
    """Of an array of (at, ..., name, ...) the first element of each name, in order."""
    ordered = F.array_sort(found)
    names = F.transform(ordered, lambda x: x["name"])
    return F.transform(F.array_distinct(names), lambda n: F.element_at(ordered, F.array_position(names, n).cast("int")))


def _summed(runs: DataFrame, keys: tuple[str, ...], definitions: Definitions | None, segments: tuple[str, ...] | None) -> DataFrame:
    """A summary for each of `keys`.

    Touches and segment maps are collected only where they change from one hit to the next, declared segments are
    plain minima, so that what is held follows what changes and not the number of hits.
    """
    when = F.struct("ts", "seq")
    before = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_touch", F.col("campaign").isNotNull() & ~F.col("campaign").eqNullSafe(F.last("campaign", ignorenulls=True).over(before)))
    if segments is None:
        entries = F.when(F.size("segments") > 0, F.array_sort(F.map_entries("segments")))
        rows = rows.withColumn("_entries", entries)
        rows = rows.withColumn("_held", F.col("_entries").isNotNull() & ~F.col("_entries").eqNullSafe(F.last("_entries", ignorenulls=True).over(before)))
        named = F.transform("_entries", lambda e: F.struct(when.alias("at"), e["key"].alias("name"), e["value"].alias("value")))
        held = F.flatten(F.collect_list(F.when(F.col("_held"), named)))
    else:
        value = [F.element_at("segments", k) for k in segments]
        least = [F.min(F.when(v.isNotNull(), F.struct(when.alias("at"), F.lit(k).alias("name"), v.alias("value")))) for k, v in zip(segments, value, strict=True)]
        held = F.filter(F.array(*least), lambda x: x.isNotNull()) if least else F.array()
    live = [
        F.min(F.when(ok, F.struct(when.alias("at"), F.lit(i).alias("id"), F.lit(handle).alias("name"))))
        for i, handle, ok in (live_goals(definitions) if definitions else ())
    ]
    out = rows.groupBy(*keys).agg(
        F.min_by(F.struct("path", "visitor_hash", "referrer", "user_agent"), when).alias("first"),
        F.min(when).alias("first_at"),
        F.max_by("path", when).alias("last_path"),
        F.max(when).alias("last_at"),
        F.sum(F.when(is_view(), 1).otherwise(0)).alias("pageviews"),
        F.collect_list(F.when(F.col("_touch"), F.struct(when.alias("at"), F.col("campaign").alias("name")))).alias("touches"),
        F.min(F.when(F.coalesce("country_code", F.lit("")) != "", F.struct(when.alias("at"), F.col("country_code").alias("country"), "region"))).alias("place"),
        F.coalesce(F.max("scroll_bucket"), F.lit(0)).alias("max_scroll"),
        held.alias("segments"),
        (F.filter(F.array(*live), lambda x: x.isNotNull()) if live else F.array()).alias("goals"),
    )
    types = dict(part.split(" ", 1) for part in ("goals array<struct<at:struct<ts:timestamp,seq:bigint>,id:int,name:string>>", "segments array<struct<at:struct<ts:timestamp,seq:bigint>,name:string,value:string>>"))
    return out.select(*keys, *(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in out.columns[len(keys) :]))


def summaries(hits: DataFrame, window: int, definitions: Definitions | None = None, segments: tuple[str, ...] | None = None) -> DataFrame:
    """Summaries of a batch: of each run what comes before its first counted view, and the rest."""
    out = _summed(_runs(hits, window), (*KEYS, "session_no", "viewed"), definitions, segments)
    return out.drop("session_no", "viewed")


def merged(parts: DataFrame, window: int) -> DataFrame:
    """Summaries of the sessions that the parts make together; what precedes a first counted view goes.

    A part counts as a whole: where batches overlap in time, hits of one part are not told apart.
    """
    order = Window.partitionBy(*KEYS).orderBy("first_at", "last_at")
    reach = F.max("last_at.ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.unix_timestamp("first_at.ts") - F.unix_timestamp(reach)
    runs = parts.withColumn("_new", F.when(gap.isNull() | (gap >= window), 1).otherwise(0))
    runs = runs.withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(*KEYS, "session_no").orderBy("first_at", "last_at").rowsBetween(Window.unboundedPreceding, 0)
    kept = runs.withColumn("_viewed", F.max(F.col("pageviews") > 0).over(in_run)).where("_viewed")

    def together(name: str) -> Column:
        return _firsts(F.flatten(F.collect_list(name))).alias(name)

    out = kept.groupBy(*KEYS, "session_no").agg(
        F.min_by("first", "first_at").alias("first"), F.min("first_at").alias("first_at"), F.max_by("last_path", "last_at").alias("last_path"),
        F.max("last_at").alias("last_at"), F.sum("pageviews").alias("pageviews"), together("touches"), F.min("place").alias("place"),
        F.max("max_scroll").alias("max_scroll"), together("segments"), together("goals"),
    )
    return out.drop("session_no")


def finished(summary: DataFrame, keys: tuple[str, ...] = KEYS, definitions: Definitions | None = None) -> DataFrame:
    """Sessions from their summaries: `goals` in the order they were reached, `conversions` at the close."""
    seconds = F.unix_timestamp("last_at.ts") - F.unix_timestamp("first_at.ts")
    segments = F.transform(_firsts(F.col("segments")), lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))
    out = summary.select(
        *keys, "first.visitor_hash", F.col("first_at.ts").alias("started_at"), F.col("last_at.ts").alias("last_seen_at"), "pageviews", F.col("first.path").alias("entry_path"),
        "last_path", "first.referrer", "first.user_agent", F.array_distinct(F.transform(F.array_sort("touches"), lambda t: t["name"])).alias("campaigns"),
        F.coalesce("place.country", F.lit("")).alias("country_code"), F.coalesce("place.region", F.lit("")).alias("region"), "max_scroll",
        F.map_from_entries(segments).alias("segments"), (F.col("pageviews") <= 1).alias("is_bounce"), (F.greatest(seconds, F.lit(0)) * 1000).alias("duration_ms"),
        F.transform(F.array_sort("goals"), lambda g: g["name"]).alias("goals"),
    )
    return at_close(out, definitions) if definitions else out


def sessions(
    hits: DataFrame, window: int, definitions: Definitions | None = None, as_of: Column | None = None, segments: tuple[str, ...] | None = None
) -> DataFrame:
    """One row for each session; `as_of` leaves out those that may still go on.

    segments: the declared keys; None takes whatever keys there are.
    """
    keys = (*KEYS, "session_no")
    out = finished(_summed(numbered(hits, window), keys, definitions, segments), keys, definitions)
    return out if as_of is None else out.where(closed_by(F.unix_timestamp("last_seen_at"), F.unix_timestamp(as_of), window))


def closed_by(last_seen: Column, now: Column, window: int) -> Column:
    return last_seen <= now - window


def active(sessions_now: DataFrame, as_of: Column, window: int) -> DataFrame:
    """Sessions seen within the window before `as_of`."""
    return sessions_now.where(F.unix_timestamp("last_seen_at") > F.unix_timestamp(as_of) - window)
