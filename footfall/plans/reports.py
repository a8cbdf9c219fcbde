"""Reports over rollups. Every one reads one site and an inclusive range of dates.

Ties are broken by label, so that equal counts always come in the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions.traffic import CHANNELS, DEVICE_TYPES, label
from footfall.functions.values import clamp_limit, delta, mean, ratio, segment_parts
from footfall.operators import uniques
from footfall.operators.goals import Definitions
from footfall.operators.rollups import OTHER, Cube
from footfall.plans.ranges import DateRange

#: Ids are sent to all tasks up to this many (8 MB).
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Reports:
    spark: SparkSession
    cube: Cube
    site_id: int
    range: DateRange
    unique_counter: str = "exact"
    most: int = 200

    def rows(self, table: str, period: DateRange | None = None) -> DataFrame:
        """A rollup's rows of the site and range; both filters reach its partitions."""
        r = period or self.range
        return self.cube[table].where((F.col("site_id") == self.site_id) & F.col("date").between(F.lit(r.start.isoformat()).cast("date"), F.lit(r.end.isoformat()).cast("date")))

    def _visitors(self, by: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
        """Distinct visitors by columns: sets are united, never added."""
        if self.unique_counter == "hll":
            rows = self.rows("page_sketches") if where is None else self.rows("page_sketches").where(where)
            return rows.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("uniques"))
        if self.unique_counter == "bitmap":
            rows = self.rows("page_bitmaps") if where is None else self.rows("page_bitmaps").where(where)
            return uniques.counted(rows, list(by))
        rows = self.rows("page_visitors") if where is None else self.rows("page_visitors").where(where)
        return rows.groupBy(*by).agg(F.countDistinct("visitor_hash").alias("uniques"))

    # totals and trends

    def totals(self, period: DateRange | None = None) -> DataFrame:
        own = self if period is None else Reports(self.spark, self.cube, self.site_id, period, self.unique_counter)
        zero = F.lit(0).cast("long")
        views = own.rows("pages").agg(F.coalesce(F.sum("views"), zero).alias("views"), F.coalesce(F.sum("dwell_ms"), zero).alias("dwell_ms"))
        closed = own.rows("sessions").agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("sessions", "bounces", "duration_ms", "pageviews")))
        one = views.crossJoin(own._visitors()).crossJoin(closed)  # three tables of one row
        return one.select(
            "views", "uniques", "sessions", ratio(F.col("bounces"), F.col("sessions")).alias("bounce_rate"),
            mean(F.col("duration_ms"), F.col("sessions")).alias("avg_duration_ms"),
            F.when(F.col("sessions") > 0, F.col("pageviews") / F.col("sessions")).otherwise(F.lit(0.0)).alias("views_per_session"),
            mean(F.col("dwell_ms"), F.col("views")).alias("avg_dwell_ms"),
        )

    def trend(self) -> DataFrame:
        """Views and visitors by day, quiet days as zero."""
        views = self.rows("pages").groupBy("date").agg(F.sum("views").alias("views"))
        days = self.range.calendar(self.spark).join(views, "date", "left").join(self._visitors(("date",)), "date", "left")
        return days.select("date", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("views", "uniques"))).orderBy("date")

    def hourly_trend(self) -> DataFrame:
        """Views by hour of a single day; a day already folded shows zeros."""
        views = self.rows("pages").where("hour >= 0").groupBy("hour").agg(F.sum("views").alias("views"))
        hours = self.spark.range(24).select(F.col("id").cast("int").alias("hour"))
        return hours.join(views, "hour", "left").select("hour", F.coalesce("views", F.lit(0).cast("long")).alias("views")).orderBy("hour")

    def summary(self) -> DataFrame:
        """Totals beside those of the period before, with changes in per cent."""
        now, before = self.totals(), self.totals(self.range.previous())
        names = ("views", "uniques", "sessions")
        joined = now.crossJoin(before.select(*(F.col(n).alias(f"previous_{n}") for n in names)))  # two rows of one
        return joined.select("*", *(delta(F.col(n), F.col(f"previous_{n}")).alias(f"{n}_delta") for n in names))

    # pages

    def top_pages(self, limit: int = 10, include: str = "", exclude: str = "") -> DataFrame:
        rows = self.rows("pages")
        if include:
            rows = rows.where(F.col("path").contains(include))
        if exclude:
            rows = rows.where(~F.col("path").contains(exclude))
        out = rows.groupBy("path").agg(
            F.sum("views").alias("views"), F.sum("dwell_ms").alias("dwell"), F.sum("entrances").alias("entrances"), F.sum("exits").alias("exits"),
            F.sum("bounces").alias("bounces"), F.max("element_id").alias("element_id"),
        )
        return out.select(
            "path", "views", "entrances", "exits", "element_id", ratio(F.col("bounces"), F.col("entrances")).alias("bounce_rate"),
            mean(F.col("dwell"), F.col("views")).alias("avg_dwell_ms"),
        ).orderBy(F.col("views").desc(), "path").limit(clamp_limit(limit, self.most))

    def page_totals(self, path: str) -> DataFrame:
        zero = F.lit(0).cast("long")
        rows = self.rows("pages").where(F.col("path") == path)
        sums = rows.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("views", "entrances", "exits", "bounces", "dwell_ms")))
        return sums.crossJoin(self._visitors(where=F.col("path") == path)).select(  # two rows of one
            F.lit(path).alias("path"), "views", "uniques", "entrances", "exits", ratio(F.col("bounces"), F.col("entrances")).alias("bounce_rate"), mean(F.col("dwell_ms"), F.col("views")).alias("avg_dwell_ms")
        )

    def paths_trend(self, paths: list[str]) -> DataFrame:
        return self.rows("pages").where(F.col("path").isin(paths)).groupBy("path", "date").agg(F.sum("views").alias("views"))

    def compare_paths(self, asked: list[str], shown: list[str]) -> DataFrame:
        """At most four of the paths on screen, in the order asked for, by day."""
        kept = [p for p in dict.fromkeys(asked) if p in shown][:4]
        order = F.array_position(F.array(*map(F.lit, kept)) if kept else F.array().cast("array<string>"), F.col("path")).cast("int")
        return self.paths_trend(kept).select(order.alias("position"), "path", "date", "views")

    def page_sources(self, path: str, limit: int = 20) -> DataFrame:
        rows = self.rows("page_sources").where(F.col("path") == path).groupBy("channel", "host").agg(F.sum("views").alias("views"))
        return rows.select(label(F.col("channel"), CHANNELS).alias("channel"), "host", "views").orderBy(F.col("views").desc(), "channel", "host").limit(clamp_limit(limit, self.most))

    def page_sources_since(self) -> DataFrame:
        return self.cube["page_sources"].where(F.col("site_id") == self.site_id).agg(F.min("date").alias("since"))

    # arrivals

    def sources(self, limit: int = 10) -> DataFrame:
        rows = self.rows("sources").groupBy("channel", "host").agg(F.sum("sessions").alias("sessions"), F.sum("bounces").alias("bounces"))
        return rows.select(
            label(F.col("channel"), CHANNELS).alias("channel"), "host", "sessions", ratio(F.col("bounces"), F.col("sessions")).alias("bounce_rate")
        ).orderBy(F.col("sessions").desc(), "channel", "host").limit(clamp_limit(limit, self.most))

    def channels(self) -> DataFrame:
        rows = self.rows("sources").groupBy("channel").agg(F.sum("sessions").alias("sessions"))
        return rows.select(label(F.col("channel"), CHANNELS).alias("channel"), "sessions").orderBy(F.col("sessions").desc(), "channel")

    def channel_trend(self) -> DataFrame:
        rows = self.rows("sources").groupBy("date", "channel").agg(F.sum("sessions").alias("sessions"))
        return rows.select("date", label(F.col("channel"), CHANNELS).alias("channel"), "sessions")

    def devices(self, by: str = "browser") -> DataFrame:
        if by not in ("browser", "os", "device_type"):
            raise ValueError(f"devices are grouped by browser, os or device_type, not {by}")
        rows = self.rows("devices").groupBy(by).agg(F.sum("sessions").alias("sessions"))
        name = label(F.col(by), DEVICE_TYPES) if by == "device_type" else F.col(by)
        return rows.select(name.alias("label"), "sessions").orderBy(F.col("sessions").desc(), "label")

    def campaigns(self, limit: int = 10) -> DataFrame:
        keys = ("source", "medium", "campaign")
        sums = self.rows("campaigns").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("sessions", "bounces", "conversions", "value")))
        number = lambda c: F.col(c).cast("double")
        return sums.select(
            *keys, "sessions", "conversions", "value", ratio(number("bounces"), number("sessions")).alias("bounce_rate"),
            ratio(number("conversions"), number("sessions")).alias("conversion_rate"),
        ).orderBy(F.col("sessions").desc(), *keys).limit(clamp_limit(limit, self.most))

    def countries(self, limit: int = 10) -> DataFrame:
        return self.rows("geo").groupBy("country").agg(F.sum("sessions").alias("sessions")).orderBy(F.col("sessions").desc(), "country").limit(clamp_limit(limit, self.most))

    def regions(self, limit: int = 10) -> DataFrame:
        rows = self.rows("geo").where("region <> ''").groupBy("country", "region").agg(F.sum("sessions").alias("sessions"))
        return rows.orderBy(F.col("sessions").desc(), "country", "region").limit(clamp_limit(limit, self.most))

    # interactions

    def events(self, limit: int = 10, path: str | None = None) -> DataFrame:
        rows = self.rows("events") if path is None else self.rows("events").where(F.col("path") == path)
        return rows.groupBy("event_name").agg(F.sum("count").alias("count"), F.sum("value").alias("value")).orderBy(F.col("count").desc(), "event_name").limit(clamp_limit(limit, self.most))

    def outbound(self, limit: int = 10, path: str | None = None) -> DataFrame:
        rows = self.rows("outbound") if path is None else self.rows("outbound").where(F.col("path") == path)
        return rows.groupBy("host", "target").agg(F.sum("count").alias("count")).orderBy(F.col("count").desc(), "host", "target").limit(clamp_limit(limit, self.most))

    def searches(self, limit: int = 10) -> DataFrame:
        rows = self.rows("search").groupBy("term").agg(F.sum("count").alias("count"), F.sum("zero_results").alias("zero_results"))
        return rows.orderBy(F.col("count").desc(), "term").limit(clamp_limit(limit, self.most))

    def scroll_depth(self, limit: int = 10, cumulative: bool = False) -> DataFrame:
        """Deepest-scroll counts by page; cumulative adds what went deeper. The limit follows the pivot."""
        steps = (25, 50, 75, 100)
        wide = self.rows("scroll").groupBy("path").pivot("bucket", list(steps)).agg(F.sum("count"))
        found = {s: F.coalesce(F.col(str(s)), F.lit(0)).cast("long") for s in steps}
        sums = {s: sum((found[t] for t in steps if t > s), found[s]) if cumulative else found[s] for s in steps}
        return wide.select("path", *(c.alias(f"reached{s}") for s, c in sums.items())).orderBy(F.col("reached100").desc(), "path").limit(clamp_limit(limit, self.most))

    def crawlers(self, limit: int = 10) -> DataFrame:
        return self.rows("crawlers").groupBy("crawler").agg(F.sum("requests").alias("requests")).orderBy(F.col("requests").desc(), "crawler").limit(clamp_limit(limit, self.most))

    def crawler_requests(self) -> DataFrame:
        return self.rows("crawlers").agg(F.coalesce(F.sum("requests"), F.lit(0).cast("long")).alias("requests"))

    def segments(self, declared: list[str]) -> DataFrame:
        """Declared segments in their order, what was over the cap apart, undeclared ones not at all."""
        key, value = segment_parts(F.col("segment"))
        sums = self.rows("segments").groupBy("segment").agg(*(F.sum(c).alias(c) for c in ("sessions", "views", "bounces", "duration_ms")))
        named = sums.select(
            F.when(F.col("segment") == OTHER, OTHER).otherwise(key).alias("key"), F.when(F.col("segment") == OTHER, OTHER).otherwise(value).alias("value"),
            "sessions", "views", ratio(F.col("bounces"), F.col("sessions")).alias("bounce_rate"), mean(F.col("duration_ms"), F.col("sessions")).alias("avg_duration_ms"),
        )
        order = F.array_position(F.array(*map(F.lit, [*declared, OTHER])), F.col("key")).cast("int")
        return named.select(order.alias("position"), "*").where("position > 0").orderBy("position", F.col("sessions").desc(), "value")

    # content

    def element_series(self, element_id: int) -> DataFrame:
        views = self.rows("pages").where(F.col("element_id") == element_id).groupBy("date").agg(F.sum("views").alias("views"))
        return self.range.calendar(self.spark).join(views, "date", "left").select("date", F.coalesce("views", F.lit(0).cast("long")).alias("views")).orderBy("date")

    def top_elements(self, limit: int = 10) -> DataFrame:
        rows = self.rows("pages").where("element_id is not null").groupBy("element_id").agg(F.sum("views").alias("views"))
        return rows.orderBy(F.col("views").desc(), "element_id").limit(clamp_limit(limit, self.most))

    def views_by_element(self, ids: list[int]) -> DataFrame:
        return self.rows("pages").where(F.col("element_id").isin(ids)).groupBy("element_id").agg(F.sum("views").alias("views"))

    def element_uniques(self) -> DataFrame:
        """Distinct visitors of each element over all its pages."""
        elements = self.rows("pages").where("element_id is not null").select("date", "hour", "path", "element_id")
        if self.unique_counter == "hll":
            return uniques.united(self.rows("page_sketches").join(elements, ["date", "hour", "path"]), ["element_id"])
        if self.unique_counter == "bitmap":
            return uniques.counted(self.rows("page_bitmaps").join(elements, ["date", "hour", "path"]), ["element_id"])
        met = self.rows("page_visitors").join(elements, ["date", "hour", "path"])
        return met.groupBy("element_id").agg(F.countDistinct("visitor_hash").alias("uniques"))

    def content(self, entries: DataFrame | Callable[[DataFrame], DataFrame], by: str, limit: int = 10) -> DataFrame:
        """Views and elements by a column of `entries` (element_id, ...); an element with two authors counts for both.

        Where there are far more entries than elements seen, `entries` may be a function of the latter (element_id), so
        that it need not sort or group the rest. They are one row each, kept while they are used by both.
        """
        views = self.rows("pages").where("element_id is not null").groupBy("element_id").agg(F.sum("views").alias("views"), F.sum("dwell_ms").alias("dwell_ms"))
        if callable(entries):
            views = views.persist(StorageLevel.MEMORY_AND_DISK)
            seen = views.select("element_id")
            entries = entries(F.broadcast(seen) if views.count() <= BROADCAST_ROWS else seen)
        met = views.join(entries.select("element_id", F.col(by).alias("label")).distinct(), "element_id")
        out = met.groupBy("label").agg(F.sum("views").alias("views"), F.countDistinct("element_id").alias("elements"), F.sum("dwell_ms").alias("dwell"))
        return out.select("label", "views", "elements", mean(F.col("dwell"), F.col("views")).alias("avg_dwell_ms")).orderBy(F.col("views").desc(), "label").limit(clamp_limit(limit, self.most))

    def entries_in(self, entries: DataFrame, which: Column, limit: int = 10) -> DataFrame:
        """The busiest of the entries for which `which` holds: a section's, an author's."""
        own = entries.where(which).select("element_id", "title").distinct()
        views = self.rows("pages").where("element_id is not null").groupBy("element_id").agg(F.sum("views").alias("views"))
        return views.join(own, "element_id").orderBy(F.col("views").desc(), "element_id").limit(clamp_limit(limit, self.most))

    def popular_entries(self, live: DataFrame, limit: int = 10) -> DataFrame:
        """The first of four times as many elements that are live, order kept."""
        ranked = self.rows("pages").where("element_id is not null").groupBy("element_id").agg(F.sum("views").alias("views"))
        ranked = ranked.orderBy(F.col("views").desc(), "element_id").limit(4 * clamp_limit(limit, self.most))
        return ranked.join(live.select("element_id").distinct(), "element_id", "left_semi").orderBy(F.col("views").desc(), "element_id").limit(clamp_limit(limit, self.most))

    # goals and funnels

    def sessions_total(self) -> DataFrame:
        return self.rows("sessions").agg(F.coalesce(F.sum("sessions"), F.lit(0).cast("long")).alias("sessions"))

    def goals(self, definitions: Definitions) -> DataFrame:
        """Every enabled goal, those without a conversion too."""
        sums = self.rows("goals").groupBy("goal").agg(F.sum("conversions").alias("conversions"), F.sum("value").alias("value"))
        every = definitions.goal_table(self.spark).where((F.col("enabled")) & (F.col("site_id").isNull() | (F.col("site_id") == self.site_id)))
        joined = every.select("id", "name", F.col("handle").alias("goal")).join(sums, "goal", "left").crossJoin(self.sessions_total())  # one row
        return joined.select(
            "goal", "name", F.coalesce("conversions", F.lit(0).cast("long")).alias("conversions"), F.coalesce("value", F.lit(0)).cast("decimal(24,2)").alias("value"),
            ratio(F.coalesce("conversions", F.lit(0)), F.col("sessions")).alias("rate"), "id",
        ).orderBy(F.col("conversions").desc(), "id").drop("id")

    def funnel(self, definitions: Definitions, handle: str) -> DataFrame:
        """A funnel's steps with what is lost at each."""
        sums = self.rows("funnel_steps").where(F.col("funnel") == handle).groupBy("position").agg(F.sum("sessions").alias("sessions"))
        steps = definitions.step_table(self.spark).where(F.col("funnel") == handle).join(sums, "position", "left")
        n = F.coalesce("sessions", F.lit(0).cast("long"))
        order = Window.partitionBy("funnel").orderBy("position")
        rows = steps.select("funnel", "position", "goal", n.alias("sessions"))
        before, first = F.lag("sessions").over(order), F.first("sessions").over(order)
        lost = F.greatest(F.lit(0).cast("long"), before - F.col("sessions"))
        return rows.select(
            "position", "goal", "sessions", F.coalesce(lost, F.lit(0).cast("long")).alias("drop_off"), F.coalesce(ratio(lost, before), F.lit(0.0)).alias("drop_off_rate"),
            ratio(F.col("sessions"), first).alias("of_first"),
        ).orderBy("position")

    # time of week

    def hour_of_week(self, hourly_days: int) -> DataFrame:
        """Views by date and hour of the newest days that still have hours."""
        recent = F.date_sub(F.lit(self.range.end.isoformat()).cast("date"), hourly_days - 1)
        return self.rows("pages").where((F.col("hour") >= 0) & (F.col("date") >= recent)).groupBy("date", "hour").agg(F.sum("views").alias("views"))


def realtime(active_sessions: DataFrame, top: int = 10, newest: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals, busiest last pages and newest sessions of what goes on now."""
    totals = active_sessions.agg(F.countDistinct("visitor_hash").alias("visitors"), F.coalesce(F.sum("pageviews"), F.lit(0).cast("long")).alias("pageviews"), F.count(F.lit(1)).alias("sessions"))
    totals = totals.select(
        "visitors", "pageviews", F.when(F.col("visitors") > 0, F.col("pageviews") / F.col("visitors")).otherwise(F.lit(0.0)).alias("pages_per_visitor"),
        F.greatest(F.lit(0).cast("long"), F.col("sessions") - newest).alias("truncated"),
    )
    pages = active_sessions.groupBy(F.col("last_path").alias("path")).agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.col("sessions").desc(), "path").limit(top)
    recent = active_sessions.orderBy(F.col("last_seen_at").desc(), "session_key").limit(newest)
    return totals, pages, recent
