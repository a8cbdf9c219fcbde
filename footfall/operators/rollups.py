"""Folding hits and closed sessions into additive rollups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import traffic, values
from footfall.operators import sessions as ses
from footfall.operators import uniques
from footfall.operators.goals import Definitions, reached_step
from footfall.schema import ROLLUPS
from footfall.settings import Settings

OTHER = "__other__"
#: Parts that a day's values are ranked in before they are ranked together, so no task ranks more than cap times this.
SALTS = 32
#: A site's own channel rules: (host fragment, channel name), after the built-in ones.
ChannelRules = tuple[tuple[str, str], ...]
#: Attribution credit is kept to four places.
CREDIT = "decimal(12,4)"
MONEY = "decimal(14,2)"


def _when(hits: DataFrame, tz: str) -> DataFrame:
    return hits.withColumn("date", traffic.local_date(F.col("ts"), tz)).withColumn("hour", traffic.local_hour(F.col("ts"), tz))


def page_views(hits: DataFrame, tz: str) -> DataFrame:
    """Views, dwell and the page's element from view hits; a beacon that brings only dwell adds no view."""
    rows = _when(hits.where("kind = 'view'"), tz)
    element = F.min_by("element_id", F.when(F.col("element_id").isNotNull(), F.struct("ts", "seq")))
    return rows.groupBy("site_id", "date", "hour", "path").agg(
        F.sum(F.when(F.col("count_view"), 1).otherwise(0)).alias("views"), F.sum("dwell_ms").alias("dwell_ms"), element.alias("element_id")
    )


def page_edges(closed: DataFrame, tz: str) -> DataFrame:
    """Entrances and bounces at the start, exits at the end of sessions."""
    local = F.from_utc_timestamp
    ends = F.array(
        F.struct(local("started_at", tz).alias("at"), F.col("entry_path").alias("path"), F.lit(1).alias("entrances"), F.lit(0).alias("exits"), F.col("is_bounce").cast("int").alias("bounces")),
        F.struct(local("last_seen_at", tz).alias("at"), F.col("last_path").alias("path"), F.lit(0).alias("entrances"), F.lit(1).alias("exits"), F.lit(0).alias("bounces")),
    )
    each = closed.select("site_id", F.explode(ends).alias("e")).select("site_id", F.to_date("e.at").alias("date"), F.hour("e.at").alias("hour"), "e.path", "e.entrances", "e.exits", "e.bounces")
    return each.groupBy("site_id", "date", "hour", "path").agg(*(F.sum(c).alias(c) for c in ("entrances", "exits", "bounces")))


def pages(hits: DataFrame, closed: DataFrame, tz: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    views = page_views(hits, tz).select("site_id", "date", "hour", "path", "views", "dwell_ms", zero.alias("entrances"), zero.alias("exits"), zero.alias("bounces"), "element_id")
    edges = page_edges(closed, tz).select("site_id", "date", "hour", "path", zero.alias("views"), zero.alias("dwell_ms"), "entrances", "exits", "bounces", F.lit(None).cast("int").alias("element_id"))
    sums = (F.sum(c).alias(c) for c in ("views", "dwell_ms", "entrances", "exits", "bounces"))
    return views.union(edges).groupBy("site_id", "date", "hour", "path").agg(*sums, F.max("element_id").alias("element_id"))


def page_visitors(hits: DataFrame, tz: str) -> DataFrame:
    """Every visitor of a page and hour once."""
    return _when(hits.where("kind = 'view'"), tz).select("site_id", "date", "hour", "path", "visitor_hash").distinct()


def page_sources(hits: DataFrame, tz: str, window: int, rules: ChannelRules = ()) -> DataFrame:
    """Counted views by how their session arrived."""
    return page_arrivals(ses.acquisition(hits, window), tz, rules)


def page_arrivals(views: DataFrame, tz: str, rules: ChannelRules = ()) -> DataFrame:
    """Counted views with arrived_from and by_campaign, by channel and host."""
    rows = _when(views, tz)
    host = F.coalesce(traffic.referrer_host(F.col("arrived_from")), F.lit(""))
    return rows.groupBy("site_id", "date", "path", traffic.channel(F.col("arrived_from"), F.col("by_campaign"), rules).alias("channel"), host.alias("host")).agg(F.count(F.lit(1)).alias("views"))


def crawlers(hits: DataFrame, tz: str) -> DataFrame:
    rows = _when(hits.where("kind = 'crawler' and coalesce(crawler, '') <> ''"), tz)
    return rows.groupBy("site_id", "date", "crawler").agg(F.count(F.lit(1)).alias("requests"))


def events(hits: DataFrame, tz: str) -> DataFrame:
    rows = _when(hits.where("kind = 'event' and event_name is not null"), tz)
    total = values.saturated(F.sum(F.coalesce("event_value", F.lit(0).cast(MONEY)).cast("decimal(28,2)")), values.MONEY_LIMIT, MONEY)
    return rows.groupBy("site_id", "date", "hour", "event_name", "path").agg(F.count(F.lit(1)).alias("count"), total.alias("value"))


def scroll(hits: DataFrame, tz: str) -> DataFrame:
    """Hits that report each deepest bucket."""
    rows = _when(hits.where("scroll_bucket is not null and kind <> 'crawler'"), tz)
    return rows.groupBy("site_id", "date", "path", F.col("scroll_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def outbound(hits: DataFrame, tz: str) -> DataFrame:
    rows = _when(hits.where("kind in ('outbound', 'download')"), tz).withColumn("host", F.lower(F.try_parse_url("target", F.lit("HOST"))))
    return rows.where("coalesce(host, '') <> ''").groupBy("site_id", "date", "host", "target", "path").agg(F.count(F.lit(1)).alias("count"))


def search(hits: DataFrame, tz: str) -> DataFrame:
    rows = _when(hits.where("search_term is not null and kind = 'view' and count_view"), tz)
    return rows.groupBy("site_id", "date", F.col("search_term").alias("term")).agg(F.count(F.lit(1)).alias("count"), F.lit(0).cast("long").alias("zero_results"))


def _started(closed: DataFrame, tz: str) -> DataFrame:
    return closed.where("pageviews > 0").withColumn("date", traffic.local_date(F.col("started_at"), tz)).withColumn("hour", traffic.local_hour(F.col("started_at"), tz))


def _bounces() -> Column:
    return F.sum(F.col("is_bounce").cast("long"))


def session_totals(closed: DataFrame, tz: str) -> DataFrame:
    return _started(closed, tz).groupBy("site_id", "date", "hour").agg(
        F.count(F.lit(1)).alias("sessions"), _bounces().alias("bounces"), F.sum("duration_ms").alias("duration_ms"), F.sum("pageviews").alias("pageviews")
    )


def sources(closed: DataFrame, tz: str, rules: ChannelRules = ()) -> DataFrame:
    host = F.coalesce(traffic.referrer_host(F.col("referrer")), F.lit(""))
    kind = traffic.channel(F.col("referrer"), F.size("campaigns") > 0, rules)
    return _started(closed, tz).groupBy("site_id", "date", "hour", kind.alias("channel"), host.alias("host")).agg(F.count(F.lit(1)).alias("sessions"), _bounces().alias("bounces"))


def devices(closed: DataFrame, tz: str) -> DataFrame:
    rows = _started(closed, tz).withColumn("d", traffic.device(F.col("user_agent")))
    return rows.groupBy("site_id", "date", F.col("d.browser").alias("browser"), F.col("d.major").alias("major"), F.col("d.os").alias("os"), F.col("d.type").alias("device_type")).agg(F.count(F.lit(1)).alias("sessions"))


def geo(closed: DataFrame, tz: str) -> DataFrame:
    return _started(closed, tz).where("country_code <> ''").groupBy("site_id", "date", F.col("country_code").alias("country"), "region").agg(F.count(F.lit(1)).alias("sessions"))


def segments(closed: DataFrame, tz: str) -> DataFrame:
    each = _started(closed, tz).select("site_id", "date", "pageviews", "is_bounce", "duration_ms", F.explode("segments").alias("key", "value"))
    return each.groupBy("site_id", "date", values.segment_dimension(F.col("key"), F.col("value")).alias("segment")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("pageviews").alias("views"), _bounces().alias("bounces"), F.sum("duration_ms").alias("duration_ms")
    )


def attribution_weight(position: Column, count: Column, model: str) -> Column:
    """Credit of the touch at `position` (from 0) of `count`."""
    if model == "first-click":
        return F.when(position == 0, 1).otherwise(0).cast(CREDIT)
    if model == "last-click":
        return F.when(position == count - 1, 1).otherwise(0).cast(CREDIT)
    if model == "linear":
        return (F.lit(1.0) / F.greatest(count, F.lit(1))).cast(CREDIT)
    raise ValueError(f"unknown attribution model: {model}")


def goal_values(closed: DataFrame, definitions: Definitions) -> Column:
    """array of the values of a session's conversions."""
    worth = F.create_map(*(x for g in definitions.goals.values() for x in (F.lit(g.handle), F.lit(g.value).cast(MONEY)))) if definitions.goals else None
    if worth is None:
        return F.array().cast(f"array<{MONEY}>")
    return F.transform("conversions", lambda h: F.coalesce(F.element_at(worth, h), F.lit(0).cast(MONEY)))


def campaigns(closed: DataFrame, tz: str, model: str, definitions: Definitions | None = None) -> DataFrame:
    """Sessions, bounces, conversions and value by campaign, each touch with its share of the credit."""
    rows = _started(closed, tz)
    if definitions is not None:
        rows = rows.withColumn("_n", F.size("conversions")).withColumn("_v", F.aggregate(goal_values(rows, definitions), F.lit(0).cast("decimal(24,2)"), lambda a, x: (a + x).cast("decimal(24,2)")))
    else:
        rows = rows.withColumn("_n", F.lit(0)).withColumn("_v", F.lit(0).cast("decimal(24,2)"))
    each = rows.select("site_id", "date", "is_bounce", "_n", "_v", F.size("campaigns").alias("of"), F.posexplode("campaigns").alias("at", "c"))
    each = each.withColumn("w", attribution_weight(F.col("at"), F.col("of"), model)).where("w > 0")
    parts = {"source": "s", "medium": "m", "campaign": "c", "term": "t", "content": "o"}

    def credit(x: Column) -> Column:
        return values.saturated(F.sum((F.col("w") * x).cast("decimal(24,4)")), values.CREDIT_LIMIT, CREDIT)

    return each.groupBy("site_id", "date", *(F.col(f"c.{k}").alias(n) for n, k in parts.items())).agg(
        credit(F.lit(1)).alias("sessions"), credit(F.col("is_bounce").cast("int")).alias("bounces"), credit(F.col("_n")).alias("conversions"),
        values.saturated(F.sum((F.col("w") * F.col("_v")).cast("decimal(28,4)")), values.MONEY_LIMIT, MONEY).alias("value"),
    )


def goals(closed: DataFrame, tz: str, definitions: Definitions) -> DataFrame:
    each = _started(closed, tz).select("site_id", "date", F.explode(F.arrays_zip(F.col("conversions").alias("goal"), goal_values(closed, definitions).alias("worth"))).alias("x"))
    return each.groupBy("site_id", "date", F.col("x.goal").alias("goal")).agg(
        F.count(F.lit(1)).alias("conversions"), values.saturated(F.sum(F.col("x.worth").cast("decimal(28,2)")), values.MONEY_LIMIT, MONEY).alias("value")
    )


def funnel_steps(closed: DataFrame, tz: str, definitions: Definitions) -> DataFrame:
    """A session that reached step k counts at steps 1 to k; one that reached none, nowhere."""
    types = {h: g.type for h, g in definitions.goals.items() if g.enabled}
    walks = F.array(*(F.struct(F.lit(f.handle).alias("funnel"), F.lit(f.site_id).cast("int").alias("only"), reached_step(f.steps, types).alias("reached")) for f in definitions.funnels.values() if f.enabled))
    each = _started(closed, tz).select("site_id", "date", F.explode(walks).alias("w")).where("w.reached > 0 and (w.only is null or w.only = site_id)")
    steps = each.select("site_id", "date", "w.funnel", F.explode(F.sequence(F.lit(1), F.col("w.reached"))).alias("position"))
    return steps.groupBy("site_id", "date", "funnel", "position").agg(F.count(F.lit(1)).alias("sessions"))


def admitted(arrivals: DataFrame, cap: int, known: DataFrame | None = None) -> DataFrame:
    """(site_id, date, value): the first `cap` values of each site and day by arrival; `known` ones stay.

    arrivals: (site_id, date, value, seq). Values are reduced to their first arrival before they are ranked.
    """
    first = arrivals.where("coalesce(value, '') <> ''").groupBy("site_id", "date", "value").agg(F.min("seq").alias("seq"))
    if known is not None:
        first = first.join(known.select("site_id", "date", "value", F.lit(0).alias("_new")), ["site_id", "date", "value"], "full")
    else:
        first = first.withColumn("_new", F.lit(1))
    part = F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")
    order = (F.coalesce("_new", F.lit(1)), F.col("seq").asc_nulls_last(), "value")
    some = Window.partitionBy("site_id", "date", "_part").orderBy(*order)  # who is not among the first of a part is not among the first of all
    few = first.withColumn("_part", part).withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= cap)
    every = Window.partitionBy("site_id", "date").orderBy(*order)
    return few.withColumn("_n", F.row_number().over(every)).where(F.col("_n") <= cap).select("site_id", "date", "value")


def capped(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value was not admitted that day get OTHER; empty values stay."""
    marks = allowed.select("site_id", "date", F.col("value").alias(column), F.lit(True).alias("_in"))
    joined = rows.join(marks, ["site_id", "date", column], "left")
    keep = F.coalesce("_in", F.lit(False)) | (F.coalesce(column, F.lit("")) == "")
    return joined.withColumn(column, F.when(keep, F.col(column)).otherwise(OTHER)).select(*rows.columns)


def added_up(rows: DataFrame, table: str) -> DataFrame:
    """Rows of one rollup brought together by key: sums, capped decimals, first elements, merged sketches.

    A first element is the one of the least `_order`; without that column, rows have no order and the greatest counts.
    """
    keys, measures = ROLLUPS[table]
    if not measures:
        return rows.select(*keys).distinct()
    aggs = []
    for name, way in measures.items():
        if way == "sum":
            aggs.append(F.sum(name).cast("long").alias(name))
        elif way == "first":
            held = F.when(F.col(name).isNotNull(), F.struct("_order", F.negative(name).alias("last"))) if "_order" in rows.columns else None
            aggs.append((F.max(name) if held is None else F.min_by(name, held)).alias(name))
        elif way == "sketch":
            aggs.append(F.hll_union_agg(name).alias(name))
        elif way == "bits":
            aggs.append(F.bitmap_or_agg(name).alias(name))
        elif way == "least":
            aggs.append(F.min(name).alias(name))
        else:
            limit, text = (values.CREDIT_LIMIT, CREDIT) if way == "credit" else (values.MONEY_LIMIT, MONEY)
            aggs.append(values.saturated(F.sum(F.col(name).cast("decimal(30,4)")), limit, text).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


_RESIZED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def kept(rows: DataFrame) -> DataFrame:
    """`rows` persisted in partitions by their bytes. Otherwise they have as many as a shuffle has, however small, and so
    has all that is made of them."""
    conf = rows.sparkSession.conf
    before = conf.get(_RESIZED, None)
    conf.set(_RESIZED, "true")
    try:
        return rows.persist()
    finally:
        conf.unset(_RESIZED) if before is None else conf.set(_RESIZED, before)


@dataclass
class Cube:
    """The rollups of one set of hits, each a lazy DataFrame by table name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def merged(self, other: Cube) -> Cube:
        """Both cubes added up; only for first elements this one's come first."""

        def both(n: str) -> DataFrame:
            if n not in self.tables or n not in other.tables:
                return self.tables.get(n, other.tables.get(n))
            return added_up(self.tables[n].withColumn("_order", F.lit(0)).unionByName(other.tables[n].withColumn("_order", F.lit(1))), n)

        return Cube({n: both(n) for n in dict.fromkeys([*self.tables, *other.tables])})


def page_sketches(hits: DataFrame, tz: str, precision: int) -> DataFrame:
    """A sketch of the visitors of each page and hour; hashes that are none are left out."""
    return uniques.sketch(_when(hits.where("kind = 'view'"), tz), ["site_id", "date", "hour", "path"], "visitor_hash", precision)


def page_bitmaps(hits: DataFrame, tz: str, numbers: DataFrame) -> DataFrame:
    """A bit for each visitor of each page and hour; numbers: (site_id, visitor_hash, number)."""
    rows = page_visitors(hits, tz).join(numbers, ["site_id", "visitor_hash"])
    return uniques.bitmaps(rows, ["site_id", "date", "hour", "path"])


def new_visitors(hits: DataFrame, tz: str, known: DataFrame | None, after: int) -> DataFrame:
    """(site_id, date, visitor_hash, number) of the visitors of view hits that are not known: their first day and the
    numbers after `after`."""
    views = _when(hits.where("kind = 'view'"), tz)
    first = views.groupBy("site_id", "visitor_hash").agg(F.min("date").alias("date"))
    if known is not None:
        first = first.join(known.select("site_id", "visitor_hash"), ["site_id", "visitor_hash"], "left_anti")
    return uniques.numbered(first.select("site_id", "date", "visitor_hash"), after)


def fold_hits(hits: DataFrame, settings: Settings, numbers: DataFrame | None = None) -> Cube:
    """The rollups that need no session; visitors as a set, as bitmaps or as sketches, as the settings say.

    numbers: (site_id, visitor_hash, number) of all visitors of the hits, where they are counted in bitmaps.
    """
    tz, zero = settings.timezone, F.lit(0).cast("long")
    views = page_views(hits, tz)
    pages = views.select("site_id", "date", "hour", "path", "views", "dwell_ms", zero.alias("entrances"), zero.alias("exits"), zero.alias("bounces"), "element_id")
    out = {"pages": pages, "crawlers": crawlers(hits, tz)}
    if settings.unique_counter == "hll":
        out["page_sketches"] = page_sketches(hits, tz, settings.hll_precision)
    elif settings.unique_counter == "bitmap":
        own = uniques.numbered(hits.where("kind = 'view'").select("site_id", "visitor_hash").distinct()) if numbers is None else numbers
        out["page_bitmaps"] = page_bitmaps(hits, tz, own)
    else:
        out["page_visitors"] = page_visitors(hits, tz)
    if settings.enable_pro:
        out |= {"events": events(hits, tz), "scroll": scroll(hits, tz), "search": search(hits, tz), "outbound": outbound(hits, tz)}
    return Cube(out)


def fold_sessions(closed: DataFrame, settings: Settings, definitions: Definitions | None = None, rules: ChannelRules = ()) -> Cube:
    """The rollups of sessions that have closed."""
    tz, own = settings.timezone, definitions or Definitions()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    edges = page_edges(closed, tz).select("site_id", "date", "hour", "path", zero.alias("views"), zero.alias("dwell_ms"), "entrances", "exits", "bounces", none.alias("element_id"))
    out = {"pages": edges, "sessions": session_totals(closed, tz), "sources": sources(closed, tz, rules), "devices": devices(closed, tz)}
    if settings.enable_pro:
        out |= {"campaigns": campaigns(closed, tz, settings.attribution, definitions), "segments": segments(closed, tz)}
        if settings.enable_geo:
            out["geo"] = geo(closed, tz)
        if own.goals:
            out["goals"] = goals(closed, tz, own)
        if own.funnels:
            out["funnel_steps"] = funnel_steps(closed, tz, own)
    return Cube(out)


def fold(hits: DataFrame, closed: DataFrame, settings: Settings, definitions: Definitions | None = None, rules: ChannelRules = ()) -> Cube:
    """All rollups of `hits` and of the sessions that have closed."""
    both = fold_hits(hits, settings).merged(fold_sessions(closed, settings, definitions, rules))
    return both.merged(Cube({"page_sources": page_sources(hits, settings.timezone, settings.session_window, rules)}))


#: By type of dimension the rollup columns that it fills and whose values a caller can make up. The first column is
#: where a day's values are looked up.
CAPPED: dict[str, tuple[tuple[str, str], ...]] = {
    "path": (("pages", "path"), ("page_visitors", "path"), ("page_sketches", "path"), ("page_bitmaps", "path"), ("page_sources", "path"), ("events", "path"), ("scroll", "path"), ("outbound", "path")),
    "host": (("sources", "host"), ("page_sources", "host")),
    "segment": (("segments", "segment"),),
    "browser": (("devices", "browser"),),
    "os": (("devices", "os"),),
    "campaign_source": (("campaigns", "source"),),
    "campaign_medium": (("campaigns", "medium"),),
    "campaign_name": (("campaigns", "campaign"),),
    "campaign_term": (("campaigns", "term"),),
    "campaign_content": (("campaigns", "content"),),
    "search_term": (("search", "term"),),
    "event_name": (("events", "event_name"),),
    "outbound_host": (("outbound", "host"),),
    "outbound_url": (("outbound", "target"),),
    "crawler": (("crawlers", "crawler"),),
}


def _values(cube: Cube, kind: str) -> DataFrame | None:
    """(site_id, date, value, seq) of a dimension's values in a cube, which have no order among them."""
    out = None
    for t, c in CAPPED[kind]:
        if t in cube.tables:
            own = cube[t].select("site_id", "date", F.col(c).alias("value"), F.lit(0).cast("long").alias("seq"))
            out = own if out is None else out.union(own)
    return out


def _known(kind: str, table: Callable[[str], DataFrame | None]) -> DataFrame | None:
    """Values that a day has admitted. A view's source is known before its session closes, so sources have two tables;
    the other types have every value in their first."""
    out = None
    for name, column in CAPPED[kind][: 2 if kind == "host" else 1]:
        before = table(name)
        if before is not None:
            own = before.select("site_id", "date", F.col(column).alias("value")).where(F.col("value") != OTHER)
            out = own if out is None else out.union(own)
    return None if out is None else out.distinct()


def arrivals(hits: DataFrame, closed: DataFrame | None, tz: str) -> dict[str, DataFrame]:
    """By type of dimension (site_id, date, value, seq): when a batch's values came, in its hits and closed sessions.

    Values of hits come by `seq`. Those of sessions come by the second at which their session started; the pages that
    closed sessions begin and end with were there before the batch's views.
    """

    def of(rows: DataFrame, value: Column, seq: Column) -> DataFrame:
        return rows.select("site_id", "date", value.alias("value"), seq.cast("long").alias("seq"))

    seq, own = F.col("seq"), _when(hits, tz)
    views, out = own.where("kind = 'view'"), own.where("kind in ('outbound', 'download')")
    found = {
        "path": of(views, F.col("path"), seq), "event_name": of(own.where("kind = 'event'"), F.col("event_name"), seq),
        "search_term": of(views.where("count_view"), F.col("search_term"), seq), "crawler": of(own.where("kind = 'crawler'"), F.col("crawler"), seq),
        "outbound_host": of(out, F.lower(F.try_parse_url("target", F.lit("HOST"))), seq), "outbound_url": of(out, F.col("target"), seq),
    }
    if closed is not None:
        begun, at = _started(closed, tz), F.unix_timestamp("started_at")
        device = begun.withColumn("d", traffic.device(F.col("user_agent")))
        touch = begun.select("site_id", "date", "started_at", F.posexplode("campaigns").alias("_at", "c"))
        kept = begun.select("site_id", "date", "started_at", F.explode("segments").alias("key", "val"))
        edges = page_edges(closed, tz).select("site_id", "date", F.col("path").alias("value"), F.lit(-1).cast("long").alias("seq"))
        found |= {
            "path": found["path"].union(edges), "host": of(begun, F.coalesce(traffic.referrer_host(F.col("referrer")), F.lit("")), at),
            "browser": of(device, F.col("d.browser"), at), "os": of(device, F.col("d.os"), at), "segment": of(kept, values.segment_dimension(F.col("key"), F.col("val")), at),
            **{f"campaign_{n}": of(touch, F.col(f"c.{k}"), at * 64 + F.least("_at", F.lit(63))) for n, k in (("source", "s"), ("medium", "m"), ("name", "c"), ("term", "t"), ("content", "o"))},
        }
    return found


def over_cap(cube: Cube, cap: int, table: Callable[[str], DataFrame | None]) -> list[str]:
    """The dimensions of which some site and day has more than `cap` values, those known before included."""
    every = None
    for kind in CAPPED:
        fresh, held = _values(cube, kind), _known(kind, table)
        if fresh is None:
            continue
        both = fresh.drop("seq") if held is None else fresh.drop("seq").union(held)
        both = both.where("coalesce(value, '') <> ''").select(F.lit(kind).alias("kind"), "site_id", "date", "value")
        # every task reports on all tables of the cube, so there are as many for each kind as run at once, and not tables times partitions
        both = both.coalesce(both.sparkSession.sparkContext.defaultParallelism)
        every = both if every is None else every.union(both)
    if every is None:
        return []
    counts = every.distinct().groupBy("kind", "site_id", "date").agg(F.count(F.lit(1)).alias("n"))
    return [r["kind"] for r in counts.where(F.col("n") > cap).select("kind").distinct().collect()]


def capped_cube(cube: Cube, cap: int, table: Callable[[str], DataFrame | None], came: dict[str, DataFrame] | None = None) -> Cube:
    """A batch's cube with at most `cap` values of each dimension, site and day; the others become OTHER.

    table: a rollup as it stood before the batch, whose values of the day stay. Within a batch, values are admitted in
    the order in which they `came` (see `arrivals`); those that are in the cube alone come last, by label.
    """
    over = over_cap(cube, cap, table)
    tables, touched = dict(cube.tables), set()
    for kind in over:
        fresh = _values(cube, kind).withColumn("seq", F.lit((1 << 63) - 1))
        if came and kind in came:
            fresh = fresh.union(came[kind])
        allowed = admitted(fresh, cap, _known(kind, table))
        for t, c in CAPPED[kind]:
            if t in tables:
                tables[t] = capped(tables[t], c, allowed)
                touched.add(t)
    return Cube({t: added_up(rows.withColumn("_order", F.lit(0)), t) if t in touched else rows for t, rows in tables.items()})
