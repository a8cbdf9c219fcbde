"""Raw requests and beacons: which of them count, and the hits they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import traffic, urls, values
from footfall.settings import Settings

# Fragment routes that are no pages, and fetch destinations that are.
RESERVED_PREFIXES = ("/_dynamic_include",)
DOCUMENT_DESTINATIONS = ("document", "iframe", "frame", "nested-document")
# End of fixed values.


def header(name: str) -> Column:
    """A request header from the map column `headers`, in lower case; empty where missing."""
    return F.lower(F.coalesce(F.element_at("headers", name), F.lit("")))


def is_prefetch() -> Column:
    return (
        header("sec-purpose").contains("prefetch") | header("sec-purpose").contains("prerender")
        | header("purpose").isin("prefetch", "prerender") | (header("x-moz") == "prefetch") | (header("x-purpose") == "preview")
    )


def is_reserved(path: Column) -> Column:
    out, plain = F.lit(False), F.substring_index(path, "?", 1)
    for prefix in RESERVED_PREFIXES:
        out = out | plain.startswith(prefix)
    return out


def is_document() -> Column:
    asked = header("x-requested-with") == "xmlhttprequest"
    return ~asked & ((header("sec-fetch-dest") == "") | header("sec-fetch-dest").isin(*DOCUMENT_DESTINATIONS))


def objects(settings: Settings) -> Column:
    """Whether the browser asks not to be counted."""
    gpc = (header("sec-gpc") == "1") if settings.honour_gpc else F.lit(False)
    dnt = (header("dnt") == "1") if settings.honour_dnt else F.lit(False)
    return gpc | dnt


def is_excluded(path: Column, settings: Settings) -> Column:
    out, plain = F.lit(False), F.substring_index(path, "?", 1)
    for pattern in settings.exclude_paths:
        out = out | plain.rlike(urls.glob(pattern))
    return out


def trackable(requests: DataFrame, settings: Settings) -> DataFrame:
    """Page requests that count: (method, status, content_type, path, section_id, headers, ...) rows."""
    page = (
        (F.upper("method") == "GET") & (F.col("status") == 200) & F.lower("content_type").startswith("text/html")
        & ~objects(settings) & ~is_excluded(F.col("path"), settings) & ~is_reserved(F.col("path")) & ~is_prefetch() & is_document()
    )
    kept = requests.where(page)
    if settings.exclude_sections:
        kept = kept.where(F.col("section_id").isNull() | ~F.col("section_id").isin(list(settings.exclude_sections)))
    return kept


def within_rate(requests: DataFrame, limit: int) -> DataFrame:
    """At most `limit` requests of a visitor in each minute, the first ones by (ts, seq)."""
    minute = F.floor(F.unix_timestamp("ts") / 60)
    order = Window.partitionBy("visitor_hash", minute).orderBy("ts", "seq")
    return requests.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def beacon_hits(beacons: DataFrame, settings: Settings, base_path: str = "") -> DataFrame:
    """Hits from beacon posts.

    Columns: seq, site_id, ts, address, salt, user_agent, path (with its query), kind, event_name, event_value,
    target, scroll, dwell, referrer, engagement (no view of its own).
    """
    full = F.col("path")
    plain, query = F.substring_index(full, "?", 1), F.when(full.contains("?"), F.substring(full, F.locate("?", full) + 1, F.length(full))).otherwise("")
    visitor = traffic.visitor_hash(F.col("salt"), F.col("address"), F.col("user_agent"), F.col("site_id"))
    kind = F.when(F.col("kind").isin("event", "outbound", "download"), F.col("kind")).otherwise("view")
    bot = traffic.is_bot(F.col("user_agent"))
    out = beacons.where(urls.usable_path(full)).select(
        "seq", "site_id", "ts", "user_agent",
        urls.normalize_path(urls.beacon_path(plain, base_path), query, settings.exclude_params, settings.strip_query).alias("path"),
        visitor.alias("visitor_hash"), traffic.session_key(visitor, F.col("site_id")).alias("session_key"),
        urls.external_referrer(F.col("referrer"), settings.own_hosts).alias("referrer"),
        urls.campaign(query).alias("campaign"), F.when(bot, "crawler").otherwise(kind).alias("kind"),
        F.when(bot, traffic.crawler_name(F.col("user_agent"))).alias("crawler"),
        values.event_name(F.col("event_name")).alias("event_name"), values.event_value(F.col("event_value")).alias("event_value"),
        values.target(F.col("target")).alias("target"), values.scroll_bucket(F.col("scroll")).alias("scroll_bucket"),
        values.dwell(F.col("dwell")).alias("dwell_ms"), (~F.coalesce("engagement", F.lit(False))).alias("count_view"),
        urls.search_term(urls.normalize_path(plain, F.lit("")), query, settings.search_path, settings.search_param).alias("search_term"),
    )
    usable = ((F.col("kind") != "event") | F.col("event_name").isNotNull()) & (~F.col("kind").isin("outbound", "download") | F.col("target").isNotNull())
    return out.where(usable)


def deferred(settings: Settings) -> Column:
    """Whether a page's view is left to its beacon: in hybrid mode a page without a nonce that no template rendered
    came out of a full-page cache, whose beacon counts it."""
    return F.lit(settings.hybrid) & F.col("nonce").isNull() & ~F.coalesce("rendered", F.lit(False))


def _visitor() -> Column:
    return traffic.visitor_hash(F.col("salt"), F.col("address"), F.col("user_agent"), F.col("site_id"))


def _split_path() -> tuple[Column, Column]:
    full = F.coalesce("path", F.lit(""))
    return F.substring_index(full, "?", 1), F.when(full.contains("?"), F.substring(full, F.locate("?", full) + 1, F.length(full))).otherwise("")


def captured(requests: DataFrame, settings: Settings) -> DataFrame:
    """Hits from page requests as the server sees them; addresses are hashed and go no further.

    Columns beside those of `trackable`: seq, site_id, ts, address, salt, user_agent, referrer, element_id, nonce,
    rendered.
    """
    plain, query = _split_path()
    visitor, bot = _visitor(), traffic.is_bot(F.col("user_agent"), threshold=settings.bot_score_threshold)
    kept = trackable(requests, settings).where(~deferred(settings))
    return kept.select(
        "seq", "site_id", "ts", "user_agent", "element_id", "nonce", visitor.alias("visitor_hash"), traffic.session_key(visitor, F.col("site_id")).alias("session_key"),
        urls.normalize_path(plain, query, settings.exclude_params, settings.strip_query).alias("path"), urls.external_referrer(F.col("referrer"), settings.own_hosts).alias("referrer"),
        header("accept-language").alias("accept_language"), urls.campaign(query).alias("campaign"), F.when(bot, "crawler").otherwise("view").alias("kind"),
        F.when(bot, traffic.crawler_name(F.col("user_agent"))).alias("crawler"), F.lit(True).alias("count_view"), F.lit(0).cast("long").alias("dwell_ms"),
        urls.search_term(urls.normalize_path(plain, F.lit("")), query, settings.search_path, settings.search_param).alias("search_term"),
    )


def tracked_events(calls: DataFrame, settings: Settings) -> DataFrame:
    """Hits of kind `event` from a site's own code; none for those who object and for bots, and never a view.

    Columns: seq, site_id, ts, name, value, path, element_id, address, salt, user_agent, headers.
    """
    plain, query = _split_path()
    visitor = _visitor()
    named = calls.withColumn("event_name", values.event_name(F.col("name"))).where(F.col("event_name").isNotNull() & ~objects(settings) & ~traffic.is_bot(F.col("user_agent")))
    return named.select(
        "seq", "site_id", "ts", "user_agent", "element_id", visitor.alias("visitor_hash"), traffic.session_key(visitor, F.col("site_id")).alias("session_key"),
        urls.normalize_path(plain, query, settings.exclude_params, settings.strip_query).alias("path"), F.lit("event").alias("kind"), "event_name",
        values.event_value(F.col("value")).alias("event_value"), F.lit(False).alias("count_view"),
    )


def count_once(beacons: DataFrame, served: DataFrame, ttl: int) -> DataFrame:
    """Beacon hits whose view the server has not counted: (nonce, visitor_hash) seen within `ttl` seconds.

    A nonce is used once: of several beacons with one nonce the first by (ts, seq) keeps its view.
    """
    first = Window.partitionBy("nonce", "visitor_hash").orderBy("ts", "seq")
    counted = served.select("nonce", "visitor_hash", F.col("ts").alias("served_at")).groupBy("nonce", "visitor_hash").agg(F.max("served_at").alias("served_at"))
    joined = beacons.withColumn("_n", F.row_number().over(first)).join(counted, ["nonce", "visitor_hash"], "left")
    age = F.unix_timestamp("ts") - F.unix_timestamp("served_at")
    again = (F.col("_n") > 1) | F.coalesce(age.between(0, ttl), F.lit(False))
    return joined.withColumn("count_view", F.col("count_view") & ~(F.col("nonce").isNotNull() & again)).drop("_n", "served_at")


def order_events(orders: DataFrame, site_id: int = 1) -> DataFrame:
    """Completed orders as events `order` worth their total: (order_id, customer_id, total, ts)."""
    return orders.select(
        F.col("order_id").alias("seq"), F.lit(site_id).alias("site_id"), F.col("ts"), F.lit("event").alias("kind"), F.lit("order").alias("event_name"),
        values.event_value(F.col("total")).alias("event_value"), F.lit("/checkout").alias("path"),
    )


def form_events(submissions: DataFrame, site_id: int = 1) -> DataFrame:
    """Form submissions that are no spam, as events `form:<handle>` at the referring path."""
    path = F.coalesce(F.try_parse_url("referrer", F.lit("PATH")), F.lit("/"))
    return submissions.where(~F.coalesce("is_spam", F.lit(False))).select(
        F.col("id").alias("seq"), F.lit(site_id).alias("site_id"), "ts", F.lit("event").alias("kind"),
        F.concat(F.lit("form:"), "handle").alias("event_name"), F.lit(None).cast("decimal(14,2)").alias("event_value"), path.alias("path"),
    )


def locate(hits: DataFrame, networks: DataFrame) -> DataFrame:
    """Country and region of IPv4 addresses: networks (first, last, country, region, registered) do not overlap.

    A network of any size is cut at its /16 borders, so that the range join is an equality on the upper half of
    the address and a comparison within it.
    """
    parts = F.split("address", r"\.")
    number = parts[0].try_cast("long") * 16_777_216 + parts[1].try_cast("long") * 65_536 + parts[2].try_cast("long") * 256 + parts[3].try_cast("long")
    asked = hits.withColumn("_ip", F.when(F.col("address").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)).withColumn("_upper", F.shiftright("_ip", 16))
    cut = networks.withColumn("_upper", F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))))
    found = asked.join(cut, (asked["_upper"] == cut["_upper"]) & asked["_ip"].between(cut["first"], cut["last"]), "left")
    country = F.coalesce(F.nullif(F.col("country"), F.lit("")), F.col("registered"), F.lit(""))
    return found.select(*hits.columns, country.alias("country_code"), F.coalesce("region", F.lit("")).alias("region"))
