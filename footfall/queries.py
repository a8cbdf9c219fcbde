"""Every operator as a query over the star-schema tables, with the SQL that checks it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import traffic, urls, values
from footfall.operators import governance, journeys, rollups, sessions, store, uniques
from footfall.operators.rollups import Cube
from footfall.plans import cache, export, viz
from footfall.plans.ranges import DateRange
from footfall.plans.reports import Reports, realtime
from footfall.settings import Settings
from footfall.sources import adapter, crawlers, geo, hits, imports, requests
from footfall.streaming import guard, ingest, live

RANGE = DateRange(dt.date(2024, 1, 5), dt.date(2024, 1, 24))
DAY = DateRange(dt.date(2024, 1, 10), dt.date(2024, 1, 10))
WINDOW = 21_600
NOW = "2024-01-20 12:00:00"
BETWEEN = "date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'"
DEFS = adapter.DEFINITIONS
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_PLAIN: dict[str, str] = {}  # as written, without the sessions they stand on


def _sessions_sql(window: int = WINDOW) -> str:
    return f"""{adapter.HITS_SQL},
n0 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY visitor_hash ORDER BY ts, seq) AS gap FROM hd WHERE kind <> 'crawler'),
n1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {window} THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_hash ORDER BY ts, seq) AS no FROM n0),
n2 AS (SELECT *, max((kind = 'view' AND count_view)::INT) OVER (PARTITION BY visitor_hash, no ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS seen FROM n1),
sh AS (SELECT * FROM n2 WHERE seen = 1),
s0 AS (SELECT visitor_hash, no, min(ts) AS t0, max(ts) AS t1, sum((kind = 'view' AND count_view)::INT)::BIGINT AS pageviews,
  first(path ORDER BY ts, seq) AS entry_path, last(path ORDER BY ts, seq) AS last_path, first(referrer ORDER BY ts, seq) AS referrer,
  first(user_agent ORDER BY ts, seq) AS user_agent, first(role ORDER BY ts, seq) AS role, first(plan ORDER BY ts, seq) AS plan,
  coalesce(first(country ORDER BY ts, seq) FILTER (WHERE country <> ''), '') AS country,
  coalesce(first(region ORDER BY ts, seq) FILTER (WHERE country <> ''), '') AS region,
  coalesce(max(scroll_bucket), 0) AS max_scroll, count(campaign) > 0 AS tagged FROM sh GROUP BY ALL),
s AS (SELECT *, pageviews <= 1 AS is_bounce, (t1 - t0) * 1000 AS duration_ms, make_timestamp(t0 * 1000000)::DATE AS date,
  hour(make_timestamp(t0 * 1000000))::INT AS hour FROM s0),
touch AS (SELECT visitor_hash, no, campaign, min((ts, seq)) AS fst FROM sh WHERE campaign IS NOT NULL GROUP BY ALL),
touches AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY visitor_hash, no) AS cnt FROM touch WINDOW w AS (PARTITION BY visitor_hash, no ORDER BY fst)),
live AS (SELECT visitor_hash, no, 1 AS id, 'early' AS goal, min((ts, seq)) AS fst FROM sh WHERE kind = 'view' AND regexp_full_match(path, '/p/[0-4].*') GROUP BY ALL
  UNION ALL SELECT visitor_hash, no, 2, 'signup', min((ts, seq)) FROM sh WHERE event_name = 'signup' GROUP BY ALL
  UNION ALL SELECT visitor_hash, no, 3, 'purchase', min((ts, seq)) FROM sh WHERE event_name = 'purchase' GROUP BY ALL
  UNION ALL SELECT visitor_hash, no, 4, 'five', min((ts, seq)) FROM sh WHERE kind = 'view' AND element_id = 6 GROUP BY ALL),
conv AS (SELECT visitor_hash, no, goal FROM live
  UNION ALL SELECT visitor_hash, no, 'hour' FROM s WHERE duration_ms >= 3600000
  UNION ALL SELECT visitor_hash, no, 'deep' FROM s WHERE max_scroll >= 75),
worth AS (SELECT * FROM (VALUES ('early', 1.50), ('signup', 10.00), ('purchase', 25.25), ('five', 2.00), ('hour', 0.10), ('deep', 0.00)) w(goal, worth)),
chan AS (SELECT * FROM (VALUES ('', 'Direct', ''), ('https://www.google.com/search', 'Search', 'www.google.com'), ('https://m.facebook.com/', 'Social', 'm.facebook.com'),
  ('https://blog.example.org/a', 'Referral', 'blog.example.org'), ('https://t.co/x', 'Social', 't.co')) c(referrer, channel, host)),
sc AS (SELECT s.*, CASE WHEN tagged THEN 'Campaign' ELSE channel END AS channel, host FROM s JOIN chan USING (referrer))"""


def _query(name: str, sql: str | None = None, window: int = WINDOW) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _PLAIN[name] = sql
            _SQL[name] = f"WITH {_sessions_sql(window)}\n{sql}" if sql.lstrip().startswith(("SELECT", ",")) else sql
        return f

    return add


SEGMENTS = ("role", "plan")


def _closed(spark: SparkSession, sf: str, goals: bool = False) -> DataFrame:
    return sessions.sessions(adapter.hits(spark, sf), WINDOW, DEFS if goals else None, segments=SEGMENTS)


def _reports(spark: SparkSession, sf: str, *tables: str, period: DateRange = RANGE, model: str = "last-click", counter: str = "exact") -> Reports:
    """Reports over the rollups named; those not asked for are not built."""
    tz, rows = "UTC", adapter.hits(spark, sf)
    with_goals = bool(set(tables) & {"campaigns", "goals", "funnel_steps"})
    closed = _closed(spark, sf, with_goals) if set(tables) & {"pages", "sessions", "sources", "devices", "campaigns", "geo", "segments", "goals", "funnel_steps"} else None
    build: dict[str, Callable[[], DataFrame]] = {
        "pages": lambda: rollups.pages(rows, closed, tz), "page_visitors": lambda: rollups.page_visitors(rows, tz),
        "page_sources": lambda: rollups.page_sources(rows, tz, WINDOW), "sessions": lambda: rollups.session_totals(closed, tz),
        "sources": lambda: rollups.sources(closed, tz), "devices": lambda: rollups.devices(closed, tz), "crawlers": lambda: rollups.crawlers(rows, tz),
        "campaigns": lambda: rollups.campaigns(closed, tz, model, DEFS), "geo": lambda: rollups.geo(closed, tz), "events": lambda: rollups.events(rows, tz),
        "scroll": lambda: rollups.scroll(rows, tz), "search": lambda: rollups.search(rows, tz), "outbound": lambda: rollups.outbound(rows, tz),
        "segments": lambda: rollups.segments(closed, tz), "goals": lambda: rollups.goals(closed, tz, DEFS), "funnel_steps": lambda: rollups.funnel_steps(closed, tz, DEFS),
        "page_bitmaps": lambda: rollups.page_bitmaps(rows, tz, uniques.numbered(rows.where("kind = 'view'").select("site_id", "visitor_hash").distinct())),
        "page_sketches": lambda: uniques.sketch(rows.where("kind = 'view'").withColumn("date", F.to_date("ts")).withColumn("hour", F.hour("ts")), ["site_id", "date", "hour", "path"], "visitor_hash"),
    }
    return Reports(spark, Cube({t: build[t]() for t in tables}), 1, period, counter)


PAGES_SQL = """SELECT date, hour, path, sum(views)::BIGINT AS views, sum(dwell)::BIGINT AS dwell, sum(ent)::BIGINT AS ent, sum(ex)::BIGINT AS ex, sum(bo)::BIGINT AS bo,
  first(element_id ORDER BY ts, seq) FILTER (WHERE element_id IS NOT NULL) AS element_id FROM (
  SELECT date, hour, path, count_view::INT AS views, dwell_ms AS dwell, 0 AS ent, 0 AS ex, 0 AS bo, element_id, ts, seq FROM hd WHERE kind = 'view'
  UNION ALL SELECT date, hour, entry_path, 0, 0, 1, 0, is_bounce::INT, NULL, NULL, NULL FROM s
  UNION ALL SELECT make_timestamp(t1 * 1000000)::DATE, hour(make_timestamp(t1 * 1000000))::INT, last_path, 0, 0, 0, 1, 0, NULL, NULL, NULL FROM s) GROUP BY ALL"""
RATIO = "CASE WHEN {1} > 0 THEN {0} / {1} * 100 ELSE 0.0 END"
MEAN = "CASE WHEN {1} > 0 THEN round({0} / {1}) ELSE 0 END::BIGINT"


# pages


@_query("pages_rollup", f"SELECT 1 AS site_id, date, hour, path, views, dwell AS dwell_ms, ent AS entrances, ex AS exits, bo AS bounces, element_id::INT AS element_id FROM ({PAGES_SQL})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").cube["pages"]


@_query("top_pages", f""", p AS ({PAGES_SQL}), t AS (SELECT path, sum(views)::BIGINT AS views, sum(dwell) AS dwell, sum(ent)::BIGINT AS entrances, sum(ex)::BIGINT AS exits,
  sum(bo) AS bo, max(element_id)::INT AS element_id FROM p WHERE {BETWEEN} GROUP BY path)
SELECT path, views, entrances, exits, element_id, {RATIO.format("bo", "entrances")} AS bounce_rate, {MEAN.format("dwell", "views")} AS avg_dwell_ms FROM t ORDER BY views DESC, path LIMIT 20""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").top_pages(20)


@_query("top_pages_filtered", f""", p AS ({PAGES_SQL}), t AS (SELECT path, sum(views)::BIGINT AS views, sum(dwell) AS dwell, sum(ent)::BIGINT AS entrances, sum(ex)::BIGINT AS exits,
  sum(bo) AS bo, max(element_id)::INT AS element_id FROM p WHERE {BETWEEN} AND contains(path, '/p/1') AND NOT contains(path, '7') GROUP BY path)
SELECT path, views, entrances, exits, element_id, {RATIO.format("bo", "entrances")} AS bounce_rate, {MEAN.format("dwell", "views")} AS avg_dwell_ms FROM t ORDER BY views DESC, path LIMIT 5""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").top_pages(5, "/p/1", "7")


TOTALS_SQL = f"""SELECT v.views, u.uniques, t.sessions, {RATIO.format("bounces", "sessions")} AS bounce_rate, {MEAN.format("duration", "sessions")} AS avg_duration_ms,
  CASE WHEN sessions > 0 THEN pageviews / sessions ELSE 0.0 END AS views_per_session, {MEAN.format("dwell", "views")} AS avg_dwell_ms FROM
  (SELECT sum((count_view)::INT)::BIGINT AS views, sum(dwell_ms) AS dwell FROM hd WHERE kind = 'view' AND {BETWEEN}) v,
  (SELECT count(DISTINCT visitor_hash) AS uniques FROM hd WHERE kind = 'view' AND {BETWEEN}) u,
  (SELECT count(*) AS sessions, sum(is_bounce::INT) AS bounces, sum(duration_ms) AS duration, sum(pageviews) AS pageviews FROM s WHERE {BETWEEN}) t"""


@_query("totals", TOTALS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages", "page_visitors", "sessions").totals()


@_query("summary_with_deltas", f""", a AS ({TOTALS_SQL}), b AS ({TOTALS_SQL.replace(BETWEEN, "date BETWEEN DATE '2023-12-16' AND DATE '2024-01-04'")})
SELECT a.*, b.views AS previous_views, b.uniques AS previous_uniques, b.sessions AS previous_sessions,
  CASE WHEN b.views > 0 THEN (a.views - b.views) / b.views * 100 END AS views_delta, CASE WHEN b.uniques > 0 THEN (a.uniques - b.uniques) / b.uniques * 100 END AS uniques_delta,
  CASE WHEN b.sessions > 0 THEN (a.sessions - b.sessions) / b.sessions * 100 END AS sessions_delta FROM a, b""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages", "page_visitors", "sessions").summary()


@_query("daily_trend", """, c AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24', INTERVAL 1 DAY))::DATE AS date)
SELECT c.date, coalesce(sum(count_view::INT), 0)::BIGINT AS views, count(DISTINCT visitor_hash) AS uniques FROM c LEFT JOIN (SELECT * FROM hd WHERE kind = 'view') hd ON hd.date = c.date GROUP BY c.date""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages", "page_visitors").trend()


@_query("hourly_trend", """SELECT h.hour::INT AS hour, coalesce(sum(count_view::INT), 0)::BIGINT AS views FROM range(24) h(hour)
LEFT JOIN (SELECT * FROM hd WHERE kind = 'view' AND date = DATE '2024-01-10') x ON x.hour = h.hour GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages", period=DAY).hourly_trend()


@_query("page_totals", f""", p AS ({PAGES_SQL}) SELECT '/p/12' AS path, v.views, u.uniques, v.entrances, v.exits, {RATIO.format("bo", "entrances")} AS bounce_rate, {MEAN.format("dwell", "views")} AS avg_dwell_ms FROM
  (SELECT coalesce(sum(views), 0)::BIGINT AS views, coalesce(sum(ent), 0)::BIGINT AS entrances, coalesce(sum(ex), 0)::BIGINT AS exits, sum(bo) AS bo, sum(dwell) AS dwell FROM p WHERE path = '/p/12' AND {BETWEEN}) v,
  (SELECT count(DISTINCT visitor_hash) AS uniques FROM hd WHERE kind = 'view' AND path = '/p/12' AND {BETWEEN}) u""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages", "page_visitors").page_totals("/p/12")


@_query("paths_trend", f"SELECT path, date, sum(views)::BIGINT AS views FROM ({PAGES_SQL}) WHERE path IN ('/p/1', '/p/2', '/p/3') AND {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").paths_trend(["/p/1", "/p/2", "/p/3"])


@_query("compare_paths", f"""SELECT list_position(['/p/3', '/p/1', '/p/4', '/p/5'], path)::INT AS position, path, date, sum(views)::BIGINT AS views FROM ({PAGES_SQL})
WHERE path IN ('/p/3', '/p/1', '/p/4', '/p/5') AND {BETWEEN} GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    shown = [f"/p/{i}" for i in range(1, 8)]
    return _reports(spark, sf, "pages").compare_paths(["/p/3", "/p/1", "/p/3", "/gone", "/p/4", "/p/5", "/p/6"], shown)


ARRIVED_SQL = """(SELECT v.date, v.path, CASE WHEN s.tagged THEN 'Campaign' ELSE c.channel END AS channel, c.host FROM sh v JOIN s USING (visitor_hash, no)
  JOIN chan c ON c.referrer = s.referrer WHERE v.kind = 'view' AND v.count_view)"""


@_query("page_sources", f"SELECT channel, host, count(*) AS views FROM {ARRIVED_SQL} WHERE path = '/p/12' AND {BETWEEN} GROUP BY ALL ORDER BY views DESC, channel, host LIMIT 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "page_sources").page_sources("/p/12")


@_query("page_sources_since", f"SELECT min(date) AS since FROM {ARRIVED_SQL}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "page_sources").page_sources_since()


# arrivals


@_query("sources", f"""SELECT channel, host, count(*) AS sessions, {RATIO.format("sum(is_bounce::INT)", "count(*)")} AS bounce_rate FROM sc WHERE {BETWEEN}
GROUP BY ALL ORDER BY sessions DESC, channel, host LIMIT 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "sources").sources()


@_query("channels", f"SELECT channel, count(*) AS sessions FROM sc WHERE {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "sources").channels()


@_query("channel_trend", f"SELECT date, channel, count(*) AS sessions FROM sc WHERE {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "sources").channel_trend()


def _device_sql(case: str) -> str:
    return f"SELECT CASE {case} END AS label, count(*) AS sessions FROM s WHERE {BETWEEN} GROUP BY ALL"


@_query("devices_by_browser", _device_sql("WHEN contains(user_agent, 'Edg/') THEN 'Edge' WHEN contains(user_agent, 'Firefox') THEN 'Firefox' WHEN contains(user_agent, 'Chrome') THEN 'Chrome' ELSE 'Safari'"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "devices").devices("browser")


@_query("devices_by_system", _device_sql("WHEN contains(user_agent, 'iPad') THEN 'iPad' WHEN contains(user_agent, 'iPhone') THEN 'iPhone' WHEN contains(user_agent, 'Windows') THEN 'Windows' ELSE 'Linux'"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "devices").devices("os")


@_query("devices_by_type", _device_sql("WHEN contains(user_agent, 'iPad') THEN 'Tablet' WHEN contains(user_agent, 'iPhone') THEN 'Mobile' ELSE 'Desktop'"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "devices").devices("device_type")


def _campaign_sql(weight: str) -> str:
    return f""", x AS (SELECT campaign, s.is_bounce::INT AS b, ({weight})::DECIMAL(12,4) AS w, coalesce(k.n, 0) AS k, coalesce(k.v, 0)::DECIMAL(24,2) AS v FROM touches t JOIN s USING (visitor_hash, no)
  LEFT JOIN (SELECT visitor_hash, no, count(*) AS n, sum(worth::DECIMAL(14,2)) AS v FROM conv JOIN worth USING (goal) GROUP BY ALL) k USING (visitor_hash, no) WHERE {BETWEEN}),
d AS (SELECT campaign, date, sum((w * v)::DECIMAL(28,4)) AS v FROM (SELECT t.campaign, s.date, ({weight})::DECIMAL(12,4) AS w, coalesce(k.v, 0)::DECIMAL(24,2) AS v FROM touches t JOIN s USING (visitor_hash, no)
  LEFT JOIN (SELECT visitor_hash, no, sum(worth::DECIMAL(14,2)) AS v FROM conv JOIN worth USING (goal) GROUP BY ALL) k USING (visitor_hash, no)) WHERE w > 0 AND {BETWEEN} GROUP BY ALL),
m AS (SELECT campaign, sum(round(v, 2))::DECIMAL(24,2) AS value FROM d GROUP BY campaign),
g AS (SELECT campaign, sum(w) AS sessions, sum(w * b) AS bounces, sum(w * k) AS conversions FROM x WHERE w > 0 GROUP BY campaign)
SELECT split_part(campaign, '|', 1) AS source, split_part(campaign, '|', 2) AS medium, split_part(campaign, '|', 3) AS campaign, sessions::DOUBLE AS sessions, conversions::DOUBLE AS conversions, value::DOUBLE AS value,
  {RATIO.format("bounces::DOUBLE", "sessions::DOUBLE")} AS bounce_rate, {RATIO.format("conversions::DOUBLE", "sessions::DOUBLE")} AS conversion_rate
FROM g JOIN m USING (campaign) ORDER BY sessions DESC, 1, 2, 3 LIMIT 50"""


def _campaigns(spark: SparkSession, sf: str, model: str) -> DataFrame:
    rows = _reports(spark, sf, "campaigns", model=model).campaigns(50)
    return rows.select(*(F.col(c).cast("double") if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes))


@_query("campaigns_last_click", _campaign_sql("(pos = cnt - 1)::INT"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _campaigns(spark, sf, "last-click")


@_query("campaigns_first_click", _campaign_sql("(pos = 0)::INT"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _campaigns(spark, sf, "first-click")


@_query("campaigns_linear", _campaign_sql("1.0::DOUBLE / cnt"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _campaigns(spark, sf, "linear")


@_query("countries", f"SELECT country, count(*) AS sessions FROM s WHERE country <> '' AND {BETWEEN} GROUP BY ALL ORDER BY sessions DESC, country LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "geo").countries()


@_query("regions", f"SELECT country, region, count(*) AS sessions FROM s WHERE country <> '' AND region <> '' AND {BETWEEN} GROUP BY ALL ORDER BY sessions DESC, country, region LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "geo").regions()


# interactions


@_query("events", f"SELECT event_name, count(*) AS count, sum(event_value)::DOUBLE AS value FROM hd WHERE event_name IS NOT NULL AND {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "events").events().withColumn("value", F.col("value").cast("double"))


@_query("events_of_page", f"SELECT event_name, count(*) AS count, sum(event_value)::DOUBLE AS value FROM hd WHERE event_name IS NOT NULL AND path = '/p/12' AND {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "events").events(path="/p/12").withColumn("value", F.col("value").cast("double"))


@_query("outbound", f"""SELECT lower(regexp_extract(target, '//([^/]+)', 1)) AS host, target, count(*) AS count FROM hd WHERE kind = 'outbound' AND {BETWEEN} GROUP BY ALL ORDER BY count DESC, host, target LIMIT 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "outbound").outbound()


@_query("searches", f"SELECT search_term AS term, count(*) AS count, 0::BIGINT AS zero_results FROM hd WHERE search_term IS NOT NULL AND kind = 'view' AND count_view AND {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "search").searches(50)


def _scroll_sql(op: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE scroll_bucket {op} {b}) AS reached{b}" for b in (25, 50, 75, 100))
    return f"SELECT path, {cols} FROM hd WHERE scroll_bucket IS NOT NULL AND {BETWEEN} GROUP BY path ORDER BY reached100 DESC, path LIMIT 10"


@_query("scroll_depth", _scroll_sql("="))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "scroll").scroll_depth()


@_query("scroll_depth_cumulative", _scroll_sql(">="))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "scroll").scroll_depth(cumulative=True)


@_query("crawlers", f"SELECT crawler, count(*) AS requests FROM hd WHERE crawler IS NOT NULL AND {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "crawlers").crawlers()


@_query("crawler_requests", f"SELECT count(*) AS requests FROM hd WHERE crawler IS NOT NULL AND {BETWEEN}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "crawlers").crawler_requests()


@_query("segments", f"""SELECT CASE k WHEN 'role' THEN 1 ELSE 2 END::INT AS position, k AS key, v AS value, count(*) AS sessions, sum(pageviews)::BIGINT AS views,
  {RATIO.format("sum(is_bounce::INT)", "count(*)")} AS bounce_rate, {MEAN.format("sum(duration_ms)", "count(*)")} AS avg_duration_ms
FROM (SELECT *, 'role' AS k, role AS v FROM s UNION ALL SELECT *, 'plan', plan FROM s) WHERE {BETWEEN} GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "segments").segments(["role", "plan"])


# content


@_query("element_series", f""", c AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24', INTERVAL 1 DAY))::DATE AS date)
SELECT c.date, coalesce(sum(views), 0)::BIGINT AS views FROM c LEFT JOIN (SELECT * FROM ({PAGES_SQL}) WHERE element_id = 13) p ON p.date = c.date GROUP BY c.date""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").element_series(13)


ELEMENT_SQL = f"el AS (SELECT element_id::INT AS element_id, sum(views)::BIGINT AS views, sum(dwell) AS dwell FROM ({PAGES_SQL}) WHERE element_id IS NOT NULL AND {BETWEEN} GROUP BY ALL)"


@_query("top_elements", f", {ELEMENT_SQL} SELECT element_id, views FROM el ORDER BY views DESC, element_id LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").top_elements()


@_query("views_by_element", f", {ELEMENT_SQL} SELECT element_id, views FROM el WHERE element_id IN (1, 2, 3, 50, 99)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").views_by_element([1, 2, 3, 50, 99])


@_query("element_uniques", f""", p AS (SELECT date, hour, path, element_id::INT AS element_id FROM ({PAGES_SQL}) WHERE element_id IS NOT NULL AND {BETWEEN})
SELECT p.element_id, count(DISTINCT visitor_hash) AS uniques FROM p JOIN hd USING (date, hour, path) WHERE kind = 'view' GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages", "page_visitors").element_uniques()


_UNIQUES_SQL = {name: _PLAIN[name] for name in ("totals", "daily_trend", "page_totals", "element_uniques")}
for _name, _read in (
    ("totals", lambda r: r.totals()), ("daily_trend", lambda r: r.trend()), ("page_totals", lambda r: r.page_totals("/p/12")), ("element_uniques", lambda r: r.element_uniques()),
):
    _query(f"bitmap_{_name}", _UNIQUES_SQL[_name])(lambda spark, sf, read=_read: read(_reports(spark, sf, "pages", "page_bitmaps", "sessions", counter="bitmap")))


@_query("sketched_elements", f""", p AS (SELECT date, hour, path, element_id::INT AS element_id FROM ({PAGES_SQL}) WHERE element_id IS NOT NULL AND {BETWEEN})
SELECT p.element_id, count(DISTINCT visitor_hash) AS exact, true AS within_bound FROM p JOIN hd USING (date, hour, path) WHERE kind = 'view' GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates of each element's visitors, within four standard errors of the exact number (two visitors at least)."""
    guess = _reports(spark, sf, "pages", "page_sketches", counter="hll").element_uniques().withColumnRenamed("uniques", "guess")
    exact = _reports(spark, sf, "pages", "page_visitors").element_uniques().withColumnRenamed("uniques", "exact")
    gap = F.abs(F.col("guess") - F.col("exact"))
    return exact.join(guess, "element_id").select("element_id", "exact", (gap <= F.greatest(F.lit(2.0), 4 * uniques.error_bound(12) * F.col("exact"))).alias("within_bound"))


def _content_sql(label: str, source: str = "part") -> str:
    return f""", {ELEMENT_SQL}, en AS (SELECT DISTINCT p_partkey AS element_id, {label} AS label FROM {source})
SELECT label, sum(views)::BIGINT AS views, count(DISTINCT element_id) AS elements, {MEAN.format("sum(dwell)", "sum(views)")} AS avg_dwell_ms FROM el JOIN en USING (element_id) GROUP BY label ORDER BY views DESC, label LIMIT 10"""


@_query("content_by_section", _content_sql("p_brand"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").content(partial(adapter.entries, spark, sf), "section")


@_query("content_by_type", _content_sql("p_type"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").content(partial(adapter.entries, spark, sf), "entry_type")


@_query("content_by_author", _content_sql("s_name", "part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").content(partial(adapter.entries, spark, sf), "author")


@_query("entries_in_section", f""", {ELEMENT_SQL} SELECT element_id, views, p_name AS title FROM el JOIN part ON p_partkey = element_id
WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY views DESC, element_id LIMIT 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    entries = adapter.entries(spark, sf)
    first = entries.agg(F.min("section").alias("section"))
    own = entries.join(F.broadcast(first), "section")  # one row
    return _reports(spark, sf, "pages").entries_in(own, own["section"].isNotNull()).select("element_id", "views", "title")


@_query("popular_entries", f", {ELEMENT_SQL}, r AS (SELECT * FROM el ORDER BY views DESC, element_id LIMIT 20) SELECT element_id, views FROM r JOIN part ON p_partkey = element_id WHERE p_size > 20 ORDER BY views DESC, element_id LIMIT 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    live = adapter.read(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("element_id"))
    return _reports(spark, sf, "pages").popular_entries(live, 5)


# sessions, goals, funnels

SESSION_SQL = """SELECT visitor_hash, no::BIGINT AS session_no, t0 AS started, t1 AS seen, pageviews, entry_path, last_path, referrer, country AS country_code, region, max_scroll::INT AS max_scroll,
  is_bounce, duration_ms FROM s"""


def _plain(closed: DataFrame) -> DataFrame:
    return closed.select(
        "visitor_hash", "session_no", F.unix_timestamp("started_at").alias("started"), F.unix_timestamp("last_seen_at").alias("seen"), "pageviews", "entry_path",
        "last_path", "referrer", "country_code", "region", "max_scroll", "is_bounce", "duration_ms",
    )


@_query("sessions_6h", SESSION_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(sessions.sessions(adapter.hits(spark, sf), WINDOW))


@_query("sessions_30min", SESSION_SQL, window=1800)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(sessions.sessions(adapter.hits(spark, sf), 1800))


@_query("sessions_closed_by", f"{SESSION_SQL} WHERE t1 <= epoch(TIMESTAMP '{NOW}') - {WINDOW}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(sessions.sessions(adapter.hits(spark, sf), WINDOW, as_of=F.lit(NOW).cast("timestamp")))


@_query("session_goals", "SELECT visitor_hash, no::BIGINT AS session_no, string_agg(goal, ',' ORDER BY fst, id) AS goals FROM live GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(spark, sf, True).where("size(goals) > 0").select("visitor_hash", "session_no", F.array_join("goals", ",").alias("goals"))


@_query("session_campaigns", "SELECT visitor_hash, no::BIGINT AS session_no, string_agg(campaign, ';' ORDER BY pos) AS campaigns FROM touches GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.sessions(adapter.hits(spark, sf), WINDOW).where("size(campaigns) > 0")
    return rows.select("visitor_hash", "session_no", F.array_join(F.transform("campaigns", lambda c: F.concat_ws("|", c["s"], c["m"], c["c"])), ";").alias("campaigns"))


@_query("sessions_rollup", "SELECT 1 AS site_id, date, hour, count(*) AS sessions, sum(is_bounce::INT)::BIGINT AS bounces, sum(duration_ms)::BIGINT AS duration_ms, sum(pageviews)::BIGINT AS pageviews FROM s GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "sessions").cube["sessions"]


@_query("goals", f""", c AS (SELECT goal, count(*) AS conversions, sum(worth)::DOUBLE AS value FROM conv JOIN s USING (visitor_hash, no) JOIN worth USING (goal) WHERE {BETWEEN} GROUP BY goal),
n AS (SELECT count(*) AS n FROM s WHERE {BETWEEN})
SELECT goal, goal AS name, coalesce(conversions, 0)::BIGINT AS conversions, coalesce(value, 0)::DOUBLE AS value, CASE WHEN n > 0 THEN coalesce(conversions, 0) / n * 100 ELSE 0.0 END AS rate FROM worth LEFT JOIN c USING (goal), n""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "goals", "sessions").goals(DEFS).withColumn("value", F.col("value").cast("double"))


def _funnel_sql(goals: list[str], reach: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(goals, 1))
    return f""", r AS (SELECT s.*, {reach} AS reached FROM s LEFT JOIN live e ON e.visitor_hash = s.visitor_hash AND e.no = s.no AND e.goal = 'early'
  LEFT JOIN live u ON u.visitor_hash = s.visitor_hash AND u.no = s.no AND u.goal = 'signup' LEFT JOIN live p ON p.visitor_hash = s.visitor_hash AND p.no = s.no AND p.goal = 'purchase'),
f AS (SELECT position::INT AS position, CASE position {cases} END AS goal, count(*) FILTER (WHERE reached >= position AND {BETWEEN}) AS sessions FROM r, range(1, 4) x(position) GROUP BY ALL),
g AS (SELECT *, lag(sessions) OVER (ORDER BY position) AS before, first(sessions) OVER (ORDER BY position) AS first FROM f)
SELECT position, goal, sessions, coalesce(greatest(0, before - sessions), 0)::BIGINT AS drop_off, CASE WHEN before > 0 THEN greatest(0, before - sessions) / before * 100 ELSE 0.0 END AS drop_off_rate,
  CASE WHEN first > 0 THEN sessions / first * 100 ELSE 0.0 END AS of_first FROM g"""


@_query("funnel_buy", _funnel_sql(["early", "signup", "purchase"], "CASE WHEN e.fst IS NULL THEN 0 WHEN u.fst IS NULL OR u.fst < e.fst OR (u.fst = e.fst AND u.id < e.id) THEN 1 WHEN p.fst IS NULL OR p.fst < u.fst THEN 2 ELSE 3 END"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "funnel_steps").funnel(DEFS, "buy")


@_query("funnel_with_duration", _funnel_sql(["early", "hour", "purchase"], "CASE WHEN e.fst IS NULL THEN 0 WHEN duration_ms < 3600000 THEN 1 WHEN p.fst IS NULL OR p.fst < e.fst THEN 2 ELSE 3 END"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "funnel_steps").funnel(DEFS, "read")


ACTIVE = f"t1 > epoch(TIMESTAMP '{NOW}') - {WINDOW} AND t0 <= epoch(TIMESTAMP '{NOW}')"


def _active(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return sessions.active(sessions.sessions(adapter.hits(spark, sf), WINDOW).where(F.col("started_at") <= now), now, WINDOW)


@_query("realtime_totals", f"SELECT count(DISTINCT visitor_hash) AS visitors, coalesce(sum(pageviews), 0)::BIGINT AS pageviews, coalesce(sum(pageviews) / count(DISTINCT visitor_hash), 0.0)::DOUBLE AS pages_per_visitor, greatest(0, count(*) - 50)::BIGINT AS truncated FROM s WHERE {ACTIVE}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return realtime(_active(spark, sf))[0]


@_query("realtime_newest", f"SELECT visitor_hash, last_path, t1 AS seen, pageviews FROM s WHERE {ACTIVE} ORDER BY t1 DESC, substr(sha256(visitor_hash || '|1'), 1, 32) LIMIT 50")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return realtime(_active(spark, sf))[2].select("visitor_hash", "last_path", F.unix_timestamp("last_seen_at").alias("seen"), "pageviews")


@_query("realtime_pages", f"SELECT last_path AS path, count(*) AS sessions FROM s WHERE {ACTIVE} GROUP BY ALL ORDER BY sessions DESC, path LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return realtime(_active(spark, sf))[1]


# week, shares, series


@_query("hour_of_week", f"SELECT date, hour, sum(views)::BIGINT AS views FROM ({PAGES_SQL}) WHERE date BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf, "pages").hour_of_week(7)


@_query("heatmap", """, v AS (SELECT dayofweek(date) AS weekday, hour, sum(count_view::INT) AS views FROM hd WHERE kind = 'view' AND date BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' GROUP BY ALL),
c AS (SELECT d.weekday::INT AS weekday, h.hour::INT AS hour, coalesce(views, 0)::BIGINT AS views FROM range(7) d(weekday) CROSS JOIN range(24) h(hour) LEFT JOIN v ON v.weekday = d.weekday AND v.hour = h.hour)
SELECT ((weekday + 6) % 7)::INT AS row, weekday, hour, views, CASE WHEN views > 0 THEN greatest(1, round(sqrt(views / max(views) OVER ()) * 6))::INT ELSE 0 END AS bucket FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return viz.heatmap(_reports(spark, sf, "pages").hour_of_week(7))


@_query("fold_to_top", f""", t AS (SELECT path AS key, date, sum(count_view::INT)::BIGINT AS value FROM hd WHERE kind = 'view' AND {BETWEEN} GROUP BY ALL),
r AS (SELECT key, row_number() OVER (ORDER BY sum(value) DESC, key) AS n FROM t GROUP BY key)
SELECT CASE WHEN n <= 4 THEN key ELSE 'Other' END AS key, date, sum(value)::BIGINT AS value FROM t JOIN r USING (key) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    views = rollups.page_views(adapter.hits(spark, sf), "UTC").where(F.col("date").between("2024-01-05", "2024-01-24"))
    return viz.fold_to_top(views.groupBy(F.col("path").alias("key"), "date").agg(F.sum("views").alias("value")))


@_query("dense_series", f""", t AS (SELECT event_name AS key, date, count(*) AS value FROM hd WHERE event_name IS NOT NULL AND path = '/p/12' AND {BETWEEN} GROUP BY ALL),
c AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24', INTERVAL 1 DAY))::DATE AS date)
SELECT k.key, c.date, coalesce(t.value, 0)::BIGINT AS value FROM (SELECT DISTINCT key FROM t) k CROSS JOIN c LEFT JOIN t ON t.key = k.key AND t.date = c.date""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = _reports(spark, sf, "events")
    rows = r.rows("events").where("path = '/p/12'").select(F.col("event_name").alias("key"), "date", F.col("count").alias("value"))
    return viz.dense(rows, RANGE.calendar(spark))


@_query("channel_shares", f"SELECT channel, count(*) AS sessions, count(*) / sum(count(*)) OVER () * 100 AS share FROM sc WHERE {BETWEEN} GROUP BY channel")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return viz.shares(_reports(spark, sf, "sources").channels(), "sessions")


# maintenance and governance


@_query("dimension_cap", """, f AS (SELECT date, path, min(seq) AS seq FROM hd WHERE kind = 'view' GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY seq, path) AS n FROM f)
SELECT 1 AS site_id, hd.date, CASE WHEN a.n <= 10 THEN hd.path ELSE '__other__' END AS path, sum(count_view::INT)::BIGINT AS views FROM hd JOIN a ON a.date = hd.date AND a.path = hd.path WHERE kind = 'view' GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    views = adapter.hits(spark, sf).where("kind = 'view'").withColumn("date", F.to_date("ts"))
    allowed = rollups.admitted(views.select("site_id", "date", F.col("path").alias("value"), "seq"), 10)
    return rollups.capped(views, "path", allowed).groupBy("site_id", "date", "path").agg(F.sum(F.col("count_view").cast("long")).alias("views"))


@_query("caps_by_arrival", """, v AS (SELECT 'search_term' AS type, date, search_term AS value, seq FROM hd WHERE search_term IS NOT NULL AND kind = 'view' AND count_view
  UNION ALL SELECT 'outbound_host', date, lower(regexp_extract(target, '//([^/]+)', 1)), seq FROM hd WHERE kind = 'outbound'
  UNION ALL SELECT 'event_name', date, event_name, seq FROM hd WHERE kind = 'event' AND event_name IS NOT NULL
  UNION ALL SELECT 'crawler', date, crawler, seq FROM hd WHERE kind = 'crawler' AND crawler IS NOT NULL),
f AS (SELECT type, date, value, row_number() OVER (PARTITION BY type, date ORDER BY min(seq)) AS n FROM v GROUP BY type, date, value)
SELECT type, date, CASE WHEN n <= 2 THEN value ELSE '__other__' END AS value, count(*) AS count FROM v JOIN f USING (type, date, value) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches, two values a day of each dimension: those that came first, whichever batch they came in."""
    own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = adapter.hits(spark, sf)
    last = rows.agg(F.max("seq")).first()[0]
    needed = ("site_id", "seq", "ts", "kind", "count_view", "path", "search_term", "target", "event_name", "event_value", "crawler")
    for n in range(3):
        part = rows.where((F.col("seq") * 3 > n * last) & (F.col("seq") * 3 <= (n + 1) * last) if n else F.col("seq") * 3 <= last).select(*needed).persist()
        cube = Cube({"search": rollups.search(part, "UTC"), "outbound": rollups.outbound(part, "UTC"), "events": rollups.events(part, "UTC"), "crawlers": rollups.crawlers(part, "UTC")})
        cube = Cube({name: rollups.kept(table) for name, table in cube.tables.items()})
        try:
            at = own.snapshot()
            own.write_delta(n, rollups.capped_cube(cube, 2, lambda name, at=at: own.table(name, at=at), rollups.arrivals(part, None, "UTC")))
        finally:
            for held in (*cube.tables.values(), part):
                held.unpersist()
    kinds = (("search_term", "search", "term", "count"), ("outbound_host", "outbound", "host", "count"), ("event_name", "events", "event_name", "count"), ("crawler", "crawlers", "crawler", "requests"))
    cube, out = own.cube(*(t for _, t, *_ in kinds)), None
    for kind, table, column, n in kinds:
        each = cube[table].groupBy(F.lit(kind).alias("type"), "date", F.col(column).alias("value")).agg(F.sum(n).alias("count"))
        out = each if out is None else out.union(each)
    return out


@_query("compaction", f"""SELECT 1 AS site_id, date, (CASE WHEN date < DATE '2024-01-17' THEN -1 ELSE p.hour END)::INT AS hour, path, sum(views)::BIGINT AS views, sum(dwell)::BIGINT AS dwell_ms, sum(ent)::BIGINT AS entrances,
  sum(ex)::BIGINT AS exits, sum(bo)::BIGINT AS bounces, (first(element_id ORDER BY p.hour) FILTER (WHERE element_id IS NOT NULL))::INT AS element_id FROM ({PAGES_SQL}) p
GROUP BY date, CASE WHEN date < DATE '2024-01-17' THEN -1 ELSE p.hour END, path""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return store.compacted(_reports(spark, sf, "pages").cube["pages"], "pages", dt.date(2024, 1, 17))


@_query("orphan_dimensions", """, d AS (SELECT DISTINCT path AS value FROM hd WHERE kind = 'view'), u AS (SELECT DISTINCT path AS value FROM hd WHERE kind = 'view' AND date >= DATE '2024-01-29')
SELECT 'path' AS type, value FROM d WHERE value NOT IN (SELECT value FROM u)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    views = rollups.page_views(adapter.hits(spark, sf), "UTC")
    named = views.select(F.lit("path").alias("type"), F.col("path").alias("value"), "date")
    return store.orphans(named.select("type", "value").distinct(), [named.where("date >= '2024-01-29'").select("type", "value")])


LOG_SQL = """lg AS (SELECT event_id AS id, 'v' || user_id AS visitor_id, CASE WHEN event_id % 3 = 0 THEN 'denied' ELSE 'granted' END AS state, cast(floor(epoch(ts)) AS BIGINT) AS said FROM events)"""
JOURNEY_SQL = f"""{LOG_SQL}, den AS (SELECT visitor_id FROM lg GROUP BY visitor_id HAVING last(state ORDER BY said, id) = 'denied'),
jr AS (SELECT visitor_id, row_number() OVER (PARTITION BY visitor_id ORDER BY ts, seq)::INT AS sequence, path, ts FROM hd WHERE visitor_id IS NOT NULL AND kind = 'view' AND count_view AND visitor_id NOT IN (SELECT visitor_id FROM den))"""


def _journeys(spark: SparkSession, sf: str) -> DataFrame:
    return governance.journeys(adapter.hits(spark, sf), adapter.consent_log(spark, sf))


@_query("journeys", f", {JOURNEY_SQL} SELECT visitor_id, sequence, path, ts AS occurred FROM jr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _journeys(spark, sf).select("visitor_id", "sequence", "path", F.unix_timestamp("occurred_at").alias("occurred"))


@_query("erased_journeys", f", {JOURNEY_SQL} SELECT visitor_id, sequence, path, ts AS occurred FROM jr WHERE visitor_id NOT IN ('v2', 'v4', 'v10')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.createDataFrame([("v2",), ("v4",), ("v10",)], "visitor_id string")
    return governance.erased(_journeys(spark, sf), gone).select("visitor_id", "sequence", "path", F.unix_timestamp("occurred_at").alias("occurred"))


@_query("erased_from_files", f", {JOURNEY_SQL} SELECT visitor_id, sequence, path, ts AS occurred FROM jr WHERE visitor_id NOT IN (SELECT 'v' || c_custkey FROM customer WHERE c_custkey % 7 = 3)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Journeys in files of four batches, of which those that hold a subject are rewritten."""
    own, rows = journeys.Journeys(spark, f"{store.shared_dir(spark)}/journeys-{uuid.uuid4().hex}"), _journeys(spark, sf)
    for n in range(4):
        own.append(n, rows.where(F.pmod(F.hash("visitor_id"), F.lit(4)) == n))
        own.append(n, rows)  # once, however often it is called
    own.erase(visitors=adapter.read(spark, sf, "customer").where("c_custkey % 7 = 3").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("visitor_id")))
    own.purge()
    return own.rows().select("visitor_id", "sequence", "path", F.unix_timestamp("occurred_at").alias("occurred"))


@_query("journeys_joined", f", {JOURNEY_SQL} SELECT visitor_id, sequence, path, ts AS occurred FROM jr WHERE visitor_id NOT IN (SELECT 'v' || c_custkey FROM customer WHERE c_custkey % 7 = 3)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Journeys of four batches whose small files are joined before an erasure and after it."""
    own, rows = journeys.Journeys(spark, f"{store.shared_dir(spark)}/journeys-{uuid.uuid4().hex}"), _journeys(spark, sf)
    for n in range(4):
        own.append(n, rows.where(F.pmod(F.hash("path"), F.lit(4)) == n))
    own.join_small()
    own.erase(visitors=adapter.read(spark, sf, "customer").where("c_custkey % 7 = 3").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("visitor_id")))
    own.join_small()
    own.purge()
    return own.rows().select("visitor_id", "sequence", "path", F.unix_timestamp("occurred_at").alias("occurred"))


@_query("privacy_counts", f""", {JOURNEY_SQL} SELECT 1 AS site_id, (SELECT count(DISTINCT visitor_id) FROM jr) AS visitors, (SELECT count(*) FROM jr) AS rows,
  (SELECT count(*) FROM lg WHERE state = 'granted') AS grants, (SELECT count(*) FROM lg WHERE state = 'denied') AS denials""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return governance.counts(_journeys(spark, sf), adapter.consent_log(spark, sf))


# functions over page addresses

_QUERY_OF = "CASE WHEN contains(url, '?') THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END"


@_query("normalized_paths", rf"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path, list_sort(list_filter(string_split({_QUERY_OF}, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS kept FROM pages)
SELECT page_id, path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS path FROM p""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    path, query = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    return adapter.read(spark, sf, "pages").select("page_id", urls.normalize_path(path, query).alias("path"))


_UTM = {"source": "utm_source", "medium": "utm_medium", "campaign": "utm_campaign", "term": "utm_term", "content": "utm_content"}


@_query("page_campaigns", f"""WITH p AS (SELECT page_id, '&' || {_QUERY_OF} AS q FROM pages),
u AS (SELECT page_id, {", ".join(f"lower(regexp_extract(q, '&{u}=([^&]*)', 1)) AS {n}" for n, u in _UTM.items())} FROM p) SELECT * FROM u WHERE source <> ''""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = urls.campaign(F.try_parse_url("url", F.lit("QUERY")))
    return adapter.read(spark, sf, "pages").select("page_id", *(c[k].alias(n) for k, n in zip("smcto", _UTM, strict=True))).where("source is not null")


@_query("page_hosts", "WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages) SELECT host, 'Referral' AS channel, count(*) AS pages FROM p GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    host = urls.referrer_host(F.col("url"))
    named = adapter.read(spark, sf, "pages").select(host.alias("host"), traffic.label(traffic.channel(F.col("url"), F.lit(False)), traffic.CHANNELS).alias("channel"))
    return named.groupBy("host", "channel").agg(F.count(F.lit(1)).alias("pages"))


@_query("visitor_identity", """WITH v AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, substr(sha256('salt|' || user_id || '||1'), 1, 16) AS visitor FROM v)
SELECT user_id, visitor, substr(sha256(visitor || '|1'), 1, 32) AS session_key FROM h""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    users = adapter.read(spark, sf, "events").select("user_id").distinct()
    visitor = traffic.visitor_hash(F.lit("salt"), F.col("user_id").cast("string"), F.lit(""), F.lit(1))
    return users.select("user_id", visitor.alias("visitor"), traffic.session_key(visitor, F.lit(1)).alias("session_key"))


@_query("salt_epochs", "WITH e AS (SELECT floor((floor(epoch(ts)) - 14400) / 86400)::BIGINT AS salt, count(*) AS hits FROM events GROUP BY ALL) SELECT * FROM e")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ts = adapter.hits(spark, sf)
    return ts.groupBy(traffic.salt_epoch(F.col("ts"), "UTC").alias("salt")).agg(F.count(F.lit(1)).alias("hits"))


@_query("rate_limited", ", r AS (SELECT *, row_number() OVER (PARTITION BY visitor_hash, ts // 3600 ORDER BY ts, seq) AS n FROM hd) SELECT date, count(*) AS kept FROM r WHERE n <= 1 GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # an hour stands for the minute, which these sparse events rarely share
    rows = adapter.hits(spark, sf).withColumn("date", F.to_date("ts")).withColumn("ts", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 60).cast("long")))
    return requests.within_rate(rows, 1).groupBy("date").agg(F.count(F.lit(1)).alias("kept"))


@_query("order_events", """WITH o AS (SELECT o_orderdate::DATE AS date, o_totalprice::DECIMAL(14,2) AS v FROM orders) SELECT date, 'order' AS event_name, count(*) AS count, sum(v)::DOUBLE AS value FROM o GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = adapter.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return requests.order_events(orders).groupBy(F.to_date("ts").alias("date"), "event_name").agg(F.count(F.lit(1)).alias("count"), F.sum("event_value").cast("double").alias("value"))


ROUND_TRIP = (
    "site_id", "path", "visitor_hash", "element_id", "referrer", "user_agent", "dwell_ms", "count_view", "visitor_id", "user_id", "country_code", "region", "kind", "event_name", "target",
    "scroll_bucket", "search_term", "crawler", "seen_at", "campaigns", "plan", "role",
)


@_query("hits_round_trip", f"""SELECT date, kind, count(*) AS hits, sum(event_value)::DOUBLE AS value, {", ".join(f"count({c}) AS {c}_n, sum(length({c}::VARCHAR))::BIGINT AS {c}_sum, max({c}::VARCHAR) AS {c}_max" for c in ROUND_TRIP)} FROM (
  SELECT * EXCLUDE (path, campaign), 1 AS site_id, CASE WHEN search_term IS NULL THEN path ELSE path || '?q=' || replace(search_term, ' ', '%20') END AS path, country AS country_code,
    ts AS seen_at, campaign AS campaigns FROM hd) GROUP BY date, kind""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every column through the wire form: how many values, their lengths and the greatest. The term travels in the address."""
    rows = adapter.hits(spark, sf).select(F.inline(F.array(F.struct("*"))))  # so that what hits are made by is not repeated in what follows
    asked = F.concat("path", F.lit("?q="), F.replace("search_term", F.lit(" "), F.lit("%20")))
    sent = rows.withColumn("path", F.when(F.col("search_term").isNull(), F.col("path")).otherwise(asked)).drop("search_term")
    back = ingest.with_search_term(hits.usable(hits.decode(hits.encode(sent))), Settings())
    tag = F.when(F.col("campaign").isNotNull(), F.concat_ws("|", "campaign.s", "campaign.m", "campaign.c"))
    flat = back.select("*", F.unix_timestamp("ts").alias("seen_at"), tag.alias("campaigns"), F.element_at("segments", "plan").alias("plan"), F.element_at("segments", "role").alias("role"))
    text = {c: F.col(c).cast("string") for c in ROUND_TRIP}
    sums = [x for c, t in text.items() for x in (F.count(c).alias(f"{c}_n"), F.sum(F.length(t)).alias(f"{c}_sum"), F.max(t).alias(f"{c}_max"))]
    return flat.groupBy(F.to_date("ts").alias("date"), F.col("kind").alias("of")).agg(F.count(F.lit(1)).alias("hits"), F.sum("event_value").cast("double").alias("value"), *sums).withColumnRenamed("of", "kind")


@_query("imported_sources", """WITH o AS (SELECT o_orderdate::DATE AS date, o_orderpriority AS g, count(*) AS n FROM orders GROUP BY ALL)
SELECT 1 AS site_id, date, -1 AS hour, 4 AS channel, g AS host, n AS sessions, round(n * 0.25)::BIGINT AS bounces FROM o""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    daily = adapter.read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_orderpriority").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    cell = lambda x: F.struct(x.cast("string").alias("value"))
    names = lambda *n: F.array(*(F.struct(F.lit(x).alias("name")) for x in n))
    row = F.struct(F.array(cell(F.col("d")), cell(F.lit("Email")), cell(F.col("g"))).alias("dimensionValues"), F.array(cell(F.col("n")), cell(F.lit(0.25))).alias("metricValues"))
    response = F.to_json(F.struct(names("date", "sessionDefaultChannelGroup", "sessionSource").alias("dimensionHeaders"), names("sessions", "bounceRate").alias("metricHeaders"), F.array(row).alias("rows")))
    return imports.dataset(imports.normalize(daily.select(response.alias("value"))), "sources")


IMPORTS_SQL = """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, o_orderkey % 7 AS p FROM orders),
o AS (SELECT date, p, count(*) AS n FROM m WHERE date < (SELECT max(date) FROM m) GROUP BY ALL)
SELECT date, '/o/' || p AS path, n * 3 AS views, 1 + (n - 1) % 5 AS visitors FROM o"""


def _report(rows: DataFrame) -> DataFrame:
    """Daily orders as a report's page: (day, p, n)."""
    cell = lambda x: F.struct(x.cast("string").alias("value"))
    names = lambda *n: F.array(*(F.struct(F.lit(x).alias("name")) for x in n))
    row = F.struct(
        F.array(cell(F.date_format("date", "yyyyMMdd")), cell(F.concat(F.lit("o/"), F.col("p")))).alias("dimensionValues"),
        F.array(cell(F.col("n") * 3), cell(F.lit(0)), cell(1 + (F.col("n") - 1) % 5)).alias("metricValues"),
    )
    response = F.struct(names("date", "pagePath").alias("dimensionHeaders"), names("screenPageViews", "userEngagementDuration", "activeUsers").alias("metricHeaders"), F.array(row).alias("rows"))
    return imports.normalize(rows.select(F.to_json(response).alias("value")))


@_query("imported_twice", IMPORTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each month as exports, of which the second and third overlap the first, beside a day that the store has
    counted and compacted itself."""
    own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    orders = adapter.read(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("date"), (F.col("o_orderkey") % 7).alias("p"))
    daily = orders.groupBy("date", "p").agg(F.count(F.lit(1)).alias("n")).cache()
    last, middle = daily.agg(F.max("date"), F.percentile(F.unix_date("date"), 0.5).cast("int")).first()
    zero = F.lit(0).cast("long")
    counted = daily.where(F.col("date") == F.lit(last)).select(F.lit(1).alias("site_id"), "date", F.lit(9).alias("hour"), F.lit("/own").alias("path"), F.lit(5).cast("long").alias("views"), *(zero.alias(c) for c in ("dwell_ms", "entrances", "exits", "bounces")), F.lit(None).cast("int").alias("element_id"))
    own.write_delta(0, Cube({"pages": counted.limit(1)}))
    own.compact(last + dt.timedelta(days=30), Settings())
    for part in (daily.where(F.unix_date("date") <= middle + 400), daily.where(F.unix_date("date") >= middle - 400), daily):
        imports.add(own, _report(part), "pages")
        own.compact(last + dt.timedelta(days=30), Settings())
    at = own.snapshot()
    seen = own.table("page_visitors", at=at).groupBy("date", "path").agg(F.count(F.lit(1)).alias("visitors"))
    return own.table("pages", at=at).where("path <> '/own'").join(seen, ["date", "path"]).select("date", "path", "views", "visitors")


@_query("customer_segments", """WITH x AS (SELECT 'market:' || lower(trim(c_mktsegment)) AS segment FROM customer UNION ALL SELECT 'priority:' || lower(trim(o_orderpriority)) FROM orders) SELECT segment, count(*) AS n FROM x GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    market, priority = values.Segment("market"), values.Segment("priority")
    a = adapter.read(spark, sf, "customer").select(values.segment_dimension(F.lit("market"), values.segment_value(F.col("c_mktsegment"), market)).alias("segment"))
    b = adapter.read(spark, sf, "orders").select(values.segment_dimension(F.lit("priority"), values.segment_value(F.col("o_orderpriority"), priority)).alias("segment"))
    return a.union(b).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@_query("customers_by_country", "WITH c AS (SELECT n_name AS country, r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT * FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    places = adapter.read(spark, sf, "nation").join(adapter.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = adapter.read(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy(F.col("n_name").alias("country"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("customers"))


@_query("csv_export", f""", p AS ({PAGES_SQL}), t AS (SELECT path, sum(views)::BIGINT AS views, sum(ent) AS ent, sum(bo) AS bo FROM p WHERE {BETWEEN} GROUP BY path)
SELECT '''=' || path AS path, views, round({RATIO.format("bo", "ent")}, 2) AS bounce_rate FROM t ORDER BY views DESC, path LIMIT 200""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reports(spark, sf, "pages").top_pages(200).select(F.concat(F.lit("="), "path").alias("path"), "views", "bounce_rate")
    return export.for_csv(rows)


@_query("approximate_uniques", f"SELECT date, count(DISTINCT visitor_hash) AS exact, true AS within_bound FROM hd WHERE kind = 'view' AND {BETWEEN} GROUP BY date")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates from sketches, each within three standard errors of the exact count (one visitor at least)."""
    guess = _reports(spark, sf, "page_sketches", counter="hll")._visitors(("date",)).withColumnRenamed("uniques", "guess")
    exact = _reports(spark, sf, "page_visitors")._visitors(("date",)).withColumnRenamed("uniques", "exact")
    gap = F.abs(F.col("guess") - F.col("exact"))
    return exact.join(guess, "date").select("date", "exact", (gap <= F.greatest(F.lit(1.0), 3 * uniques.error_bound(12) * F.col("exact"))).alias("within_bound"))


# the store: hits in batches, through maintenance, and reports of what it holds

STREAM = Settings(session_window=1800, segments=SEGMENTS, hourly_window_days=7)
_STORES: dict[tuple[str, str], store.Store] = {}


def _stored(spark: SparkSession, sf: str) -> store.Store:
    """A store that took in all events in two batches, of which the first is compacted; all sessions are closed."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
        rows, cut = adapter.hits(spark, sf), F.lit("2024-01-15").cast("timestamp")
        ingest.apply(own, rows.where(F.col("ts") < cut), 0, STREAM, DEFS)
        own.compact(dt.date(2024, 1, 17), STREAM)
        own.tidy(0)
        ingest.apply(own, rows.where(F.col("ts") >= cut), 1, STREAM, DEFS, as_of=4_102_444_800)
        _STORES[key] = own
    return _STORES[key]


for _name, _of, _tables, _read in (
    ("totals", "totals", "pages page_visitors sessions", lambda r: r.totals()),
    ("daily_trend", "daily_trend", "pages page_visitors", lambda r: r.trend()),
    ("top_pages", "top_pages", "pages", lambda r: r.top_pages(20)),
    ("sources", "sources", "sources", lambda r: r.sources()),
    ("devices", "devices_by_browser", "devices", lambda r: r.devices("browser")),
    ("countries", "countries", "geo", lambda r: r.countries()),
    ("searches", "searches", "search", lambda r: r.searches(50)),
    ("scroll", "scroll_depth", "scroll", lambda r: r.scroll_depth()),
    ("outbound", "outbound", "outbound", lambda r: r.outbound()),
    ("crawlers", "crawlers", "crawlers", lambda r: r.crawlers()),
    ("segments", "segments", "segments", lambda r: r.segments(list(SEGMENTS))),
    ("goals", "goals", "goals sessions", lambda r: r.goals(DEFS).withColumn("value", F.col("value").cast("double"))),
    ("funnel", "funnel_buy", "funnel_steps", lambda r: r.funnel(DEFS, "buy")),
):
    _query(f"stored_{_name}", _PLAIN[_of], 1800)(
        lambda spark, sf, tables=_tables, read=_read: read(Reports(spark, _stored(spark, sf).cube(*tables.split()), 1, RANGE))
    )


def _view_batches(spark: SparkSession, sf: str, parts: int) -> list[Cube]:
    """The page views of all events as so many batches."""
    rows, zero = adapter.hits(spark, sf), F.lit(0).cast("long")
    views = [rollups.page_views(rows.where(F.col("seq") % parts == n), "UTC") for n in range(parts)]
    return [Cube({"pages": v.select("site_id", "date", "hour", "path", "views", "dwell_ms", zero.alias("entrances"), zero.alias("exits"), zero.alias("bounces"), F.lit(None).cast("int").alias("element_id"))}) for v in views]


VIEWS_SQL = "SELECT date, path, sum(count_view::INT)::BIGINT AS views, sum(dwell_ms)::BIGINT AS dwell_ms FROM hd WHERE kind = 'view' GROUP BY ALL"


def _views(own: store.Store) -> DataFrame:
    return own.table("pages").groupBy("date", "path").agg(F.sum("views").alias("views"), F.sum("dwell_ms").alias("dwell_ms"))


@_query("taken_in_slices", f"{VIEWS_SQL} HAVING sum(count_view::INT) > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All events through the stream in slices of half of them: a run that may take one in, then one that takes the rest."""
    root, rows = f"{store.shared_dir(spark)}/slices-{uuid.uuid4().hex}", adapter.hits(spark, sf).persist()
    hits.write(rows, f"{root}/in")
    half = -(-rows.count() // 2)
    rows.unpersist()
    for most in (1, None):
        ingest.drain(spark, f"{root}/in", f"{root}/store", f"{root}/check", STREAM, most, half)
    return _views(store.Store(spark, f"{root}/store")).where("views > 0")  # others are pages of sessions that end on another day


@_query("cached_report", f"SELECT path, sum(count_view::INT)::BIGINT AS views FROM hd WHERE kind = 'view' AND {BETWEEN} GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A report that is kept, read again after late hits, and again after they were folded."""
    own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept = cache.ReportCache(own)

    def read() -> DataFrame:
        views = lambda r: r.rows("pages").groupBy("path").agg(F.sum("views").alias("views"))
        return kept.report("views", ("pages",), views, 1, RANGE, RANGE.end + dt.timedelta(days=1))

    for n, part in enumerate(_view_batches(spark, sf, 2)):
        own.write_delta(n, part)
        read()
    own.rewrite(lambda name, rows: rows)
    return read()


@_query("fold_beside_ingest", VIEWS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches, of which the second is written while the first is folded, and the third while both are compacted."""
    own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    cubes = _view_batches(spark, sf, 3)
    own.write_delta(0, cubes[0])
    for n in (1, 2):

        def meanwhile(name: str, rows: DataFrame, n: int = n) -> DataFrame:
            own.write_delta(n, cubes[n])  # once, however often it is called
            return store.compacted(rows, name, dt.date(2024, 1, 17)) if n == 2 else rows

        own.rewrite(meanwhile)
    own.tidy(0)
    return _views(own)


class _Interrupted(Cube):
    """A cube of which an attempt writes the first rollup and no more."""

    def __init__(self, cube: Cube):
        class Some(dict):
            def items(self):  # noqa: ANN202
                yield "pages", cube["pages"]
                raise RuntimeError("lost between two rollups")

        super().__init__(Some())


@_query("failed_batch_retried", VIEWS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A batch whose first attempts end half-way is passed over, comes again under another number and counts once."""
    own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    cubes = _view_batches(spark, sf, 2)
    own.write_delta(0, cubes[0])
    for _ in range(2):
        try:
            own.write_delta(1, _Interrupted(cubes[1]))
        except RuntimeError:
            continue
    own.write_delta(1, Cube(), note={"failed": True})
    own.rewrite(lambda name, rows: rows)
    own.write_delta(2, cubes[1])
    return _views(own)


@_query("element_first_wins", """, b AS (SELECT date, hour, path, seq % 3 AS batch, first(element_id ORDER BY ts, seq) FILTER (WHERE element_id IS NOT NULL) AS element, sum(count_view::INT) AS views FROM hd WHERE kind = 'view' GROUP BY ALL)
SELECT date, hour, path, (first(element ORDER BY batch) FILTER (WHERE element IS NOT NULL))::INT AS element_id, sum(views)::BIGINT AS views FROM b GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of the same pages: the first batch's element stays, views add up."""
    own = store.Store(spark, f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    zero = F.lit(0).cast("long")
    for n in range(3):
        views = rollups.page_views(adapter.hits(spark, sf).where(F.col("seq") % 3 == n), "UTC")
        own.write_delta(n, Cube({"pages": views.select("site_id", "date", "hour", "path", "views", "dwell_ms", zero.alias("entrances"), zero.alias("exits"), zero.alias("bounces"), "element_id")}))
    return own.table("pages").select("date", "hour", "path", "element_id", "views")


# sessions in the state of a stream

_LIVE: dict[tuple[str, str], str] = {}
LAST = f"(SELECT max(ts) FROM hd WHERE kind <> 'crawler') - {WINDOW}"


def _live(spark: SparkSession, sf: str) -> str:
    """The folder of a stream that took all events in, in two runs; open sessions are in its state."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LIVE:
        root, rows, cut = f"{store.shared_dir(spark)}/live-{uuid.uuid4().hex}", adapter.hits(spark, sf), F.lit("2024-01-15").cast("timestamp")
        for part in (rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)):
            hits.write(part, f"{root}/in")
            live.follow(spark, f"{root}/in", f"{root}/closed", f"{root}/check", WINDOW, "0 seconds").awaitTermination()
        _LIVE[key] = root
    return _LIVE[key]


@_query("sessions_closed_by_timer", f"SELECT visitor_hash, t0 AS started, t1 AS seen, pageviews, max_scroll::INT AS max_scroll FROM s WHERE t1 <= {LAST}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    closed = spark.read.schema(live.CLOSED).parquet(f"{_live(spark, sf)}/closed")
    return closed.select("visitor_hash", F.unix_timestamp("started_at").alias("started"), F.unix_timestamp("last_seen_at").alias("seen"), "pageviews", "max_scroll")


@_query("realtime_stored", f"SELECT count(DISTINCT visitor_hash) AS visitors, coalesce(sum(pageviews), 0)::BIGINT AS pageviews, coalesce(sum(pageviews) / count(DISTINCT visitor_hash), 0.0)::DOUBLE AS pages_per_visitor, greatest(0, count(*) - 50)::BIGINT AS truncated FROM s WHERE t1 > {LAST}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What goes on at the newest hit, from the state and not from hits."""
    return realtime(live.open_now(spark, f"{_live(spark, sf)}/check"))[0]


# requests, beacons, consent

_AGENT_SQL = "CASE WHEN user_id % 7 = 0 THEN 'SomeBot/1.0' ELSE 'Mozilla/5.0 Firefox/130.0' END"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """A page request for each event, some of which must not count."""
    e = adapter.read(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    signs = F.when(i % 17 == 0, F.create_map(F.lit("sec-gpc"), F.lit("1"))).when(i % 19 == 0, F.create_map(F.lit("sec-purpose"), F.lit("prefetch;prerender")))
    signs = signs.when(i % 23 == 0, F.create_map(F.lit("sec-fetch-dest"), F.lit("image"))).otherwise(F.create_map(F.lit("sec-fetch-dest"), F.lit("document")))
    return e.select(
        i.alias("seq"), F.lit(1).alias("site_id"), F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ts"), F.when(i % 10 == 0, "POST").otherwise("GET").alias("method"),
        F.when(i % 11 == 0, 404).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.concat(F.lit("/p/"), (i % 40).cast("string"), F.lit("?utm_source=x&b=2&a=1")).alias("path"),
        (i % 5).cast("int").alias("section_id"), (i % 40).cast("int").alias("element_id"), signs.alias("headers"), F.concat(F.lit("10.0."), (u % 256).cast("string"), F.lit(".1")).alias("address"),
        F.lit("s").alias("salt"), F.when(u % 7 == 0, "SomeBot/1.0").otherwise("Mozilla/5.0 Firefox/130.0").alias("user_agent"), F.when(i % 2 == 0, "https://own.example/x").otherwise("https://t.co/y").alias("referrer"),
        F.when(i % 3 > 0, F.concat(F.lit("n"), (i % 500).cast("string"))).alias("nonce"), (i % 6 == 0).alias("rendered"),
    )


_CAPTURE_SQL = f"""rq AS (SELECT event_id AS i, user_id AS u, cast(floor(epoch(ts)) AS BIGINT) AS ts, {_AGENT_SQL} AS agent FROM events),
cp AS (SELECT *, substr(sha256('s|10.0.' || u % 256 || '.1|' || agent || '|1'), 1, 16) AS visitor FROM rq WHERE i % 10 <> 0 AND i % 11 <> 0 AND i % 17 <> 0 AND i % 19 <> 0 AND i % 23 <> 0
  AND NOT (i % 40 BETWEEN 30 AND 39) AND i % 5 <> 4 AND (i % 3 > 0 OR i % 6 = 0))"""
CAPTURE = Settings(exclude_paths=("/p/3?",), exclude_sections=(4,), own_hosts=("own.example",), hybrid=True)


@_query("captured_requests", f"""WITH {_CAPTURE_SQL} SELECT '/p/' || i % 40 || '?a=1&b=2' AS path, visitor AS visitor_hash, CASE WHEN i % 2 = 0 THEN '' ELSE 'https://t.co/y' END AS referrer,
  CASE WHEN u % 7 = 0 THEN 'crawler' ELSE 'view' END AS kind, CASE WHEN u % 7 = 0 THEN 'SomeBot' END AS crawler, count(*) AS hits FROM cp GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests.captured(_requests(spark, sf), CAPTURE)
    return rows.groupBy("path", "visitor_hash", "referrer", "kind", "crawler").agg(F.count(F.lit(1)).alias("hits"))


@_query("views_counted_once", f"""WITH {_CAPTURE_SQL}, served AS (SELECT 'n' || i % 500 AS nonce, visitor, max(ts) AS served_at FROM cp WHERE i % 3 > 0 GROUP BY ALL),
bc AS (SELECT i, 'n' || i % 500 AS nonce, substr(sha256('s|10.0.' || u % 256 || '.1|' || agent || '|1'), 1, 16) AS visitor, ts + i % 4000 AS ts FROM rq),
nb AS (SELECT *, row_number() OVER (PARTITION BY nonce, visitor ORDER BY ts, i) AS n FROM bc)
SELECT nonce, count(*) AS beacons, sum((n = 1 AND NOT coalesce(nb.ts - served_at BETWEEN 0 AND 1800, false))::INT)::BIGINT AS counted FROM nb LEFT JOIN served USING (nonce, visitor) GROUP BY nonce""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A page's beacon counts unless the server has counted that nonce and visitor within half an hour before."""
    asked = _requests(spark, sf)
    served = requests.captured(asked, CAPTURE).where("nonce is not null")
    visitor = traffic.visitor_hash(F.col("salt"), F.col("address"), F.col("user_agent"), F.col("site_id"))
    beacons = asked.select("seq", F.concat(F.lit("n"), (F.col("seq") % 500).cast("string")).alias("nonce"), visitor.alias("visitor_hash"), F.timestamp_seconds(F.unix_timestamp("ts") + F.col("seq") % 4000).alias("ts"), F.lit(True).alias("count_view"))
    once = requests.count_once(beacons, served, 1800)
    return once.groupBy("nonce").agg(F.count(F.lit(1)).alias("beacons"), F.sum(F.col("count_view").cast("long")).alias("counted"))


LIMIT_SQL = """WITH rq AS (SELECT event_id AS i, 'v' || user_id % 40 AS visitor, cast(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
b0 AS (SELECT i * 10 + k AS seq, visitor, 'n' || i % 300 AS nonce, ts + k * 7 + i % 4 * 700 AS ts FROM rq, range(5) r(k) WHERE k <= i % 5),
b1 AS (SELECT *, row_number() OVER (PARTITION BY visitor, ts // 60 ORDER BY ts, seq) AS n FROM b0),
a AS (SELECT seq, visitor, nonce, ts, false AS served FROM b1 WHERE n <= 3 UNION ALL SELECT i * 10 - 1, visitor, 'n' || i % 300, ts, true FROM rq),
w AS (SELECT *, lag(served) OVER o AS before, ts - lag(ts) OVER o AS age FROM a WINDOW o AS (PARTITION BY visitor, nonce ORDER BY ts, seq))
SELECT seq, visitor AS visitor_hash, nonce, NOT (coalesce(before, false) AND age <= 1800) AS counted FROM w WHERE NOT served"""


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """A counted page for each event, and up to five beacons of it, some too late for its nonce."""
    e = adapter.read(spark, sf, "events").select(F.col("event_id").alias("i"), F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("visitor_hash"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    nonce = F.concat(F.lit("n"), (F.col("i") % 300).cast("string"))
    beacons = e.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("i") % 5).cast("int"))))
    rows = beacons.select("visitor_hash", (F.col("at") + F.col("k") * 7 + F.col("i") % 4 * 700).alias("at"), (F.col("i") * 10 + F.col("k")).alias("seq"), F.lit(False).alias("served"), nonce.alias("nonce"))
    rows = rows.union(e.select("visitor_hash", "at", F.col("i") * 10 - 1, F.lit(True), nonce))
    return rows.select(F.lit(1).alias("site_id"), "visitor_hash", F.timestamp_seconds("at").alias("ts"), "seq", "served", "nonce", F.lit(True).alias("count_view"), F.lit("").alias("value"))


def _guarded(spark: SparkSession, sf: str, cuts: list[str]) -> DataFrame:
    """The beacons of a stream whose batches end at the given days."""
    root, rows, day = f"{store.shared_dir(spark)}/guard-{uuid.uuid4().hex}", _arrivals(spark, sf), F.col("ts").cast("date")
    for begin, end in zip(["1970-01-01", *cuts], [*cuts, "2100-01-01"], strict=True):
        rows.where((day >= begin) & (day < end)).write.mode("append").parquet(f"{root}/in")
        stream = guard.guarded(spark.readStream.schema(guard.ARRIVAL).parquet(f"{root}/in"), 3, 1800, "1 second")
        with live.managed_state(spark):
            query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("seq", "visitor_hash", "nonce", F.col("count_view").alias("counted"))


@_query("beacons_guarded_in_one_batch", LIMIT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _guarded(spark, sf, [])


@_query("beacons_guarded_in_batches", LIMIT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _guarded(spark, sf, ["2024-01-08", "2024-01-21"])


@_query("tracked_events", f"""WITH {_CAPTURE_SQL} SELECT '/p/' || i % 40 || '?a=1&b=2' AS path, 'buy' AS event_name, count(*) AS hits, sum(round(i / 7.0, 2))::DOUBLE AS value FROM rq WHERE i % 17 <> 0 AND u % 7 <> 0 GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    calls = _requests(spark, sf).withColumn("name", F.lit(" buy ")).withColumn("value", F.round(F.col("seq") / 7.0, 2).cast("string"))
    rows = requests.tracked_events(calls, Settings())
    return rows.groupBy("path", "event_name").agg(F.count(F.lit(1)).alias("hits"), F.sum("event_value").cast("double").alias("value"))


@_query("located_addresses", """WITH e AS (SELECT user_id % 256 AS b FROM events) SELECT CASE WHEN b < 64 THEN 'DE' WHEN b < 200 THEN 'FR' ELSE '' END AS country_code, CASE WHEN b < 64 THEN 'BE' ELSE '' END AS region, count(*) AS hits FROM e GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    start = 10 << 24
    nets = spark.createDataFrame([(start, start + 64 * 256 - 1, "DE", "BE", None), (start + 64 * 256, start + 200 * 256 - 1, "", "", "FR")], "first long, last long, country string, region string, registered string")
    return requests.locate(_requests(spark, sf).select("seq", "address"), nets).groupBy("country_code", "region").agg(F.count(F.lit(1)).alias("hits"))


@_query("nested_networks", """WITH a AS (SELECT event_id % 2 = 0 AS four, CASE WHEN event_id % 2 = 0 THEN 167772160 + user_id % 4 * 65536 + event_id % 256 * 256 + user_id % 256 ELSE user_id % 16 * 65536 + event_id % 128 END AS num, count(*) AS hits FROM events GROUP BY ALL),
n AS (SELECT k % 4 < 2 AS four, CASE k % 4 WHEN 0 THEN 167772160 + k // 4 % 4 * 65536 + k % 256 * 256 WHEN 1 THEN 167772160 + k // 4 % 4 * 65536 + k % 16 * 4096 WHEN 2 THEN k % 16 * 65536 ELSE k % 16 * 65536 + k // 16 % 8 * 16 END AS num,
  CASE k % 4 WHEN 0 THEN 256 WHEN 1 THEN 4096 WHEN 2 THEN 65536 ELSE 16 END AS room, CASE WHEN s_nationkey > 0 THEN 'C' || s_nationkey ELSE '' END AS country, 'R' || k % 5 AS region FROM (SELECT s_suppkey AS k, s_nationkey FROM supplier)
  UNION ALL SELECT true, 167772160, 16777216, 'A8', '' UNION ALL SELECT false, 0, 4294967296, 'V6', ''),
f AS (SELECT a.four, a.num, any_value(a.hits) AS hits, min((room, country, n.region)) AS best FROM a LEFT JOIN n ON a.four = n.four AND a.num // room = n.num // room GROUP BY ALL)
SELECT best[2] AS country_code, CASE WHEN best[2] = '' THEN '' ELSE best[3] END AS region, four, sum(hits)::BIGINT AS hits FROM f GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Networks of four lengths, one in the other, for addresses of both families; a third of IPv4 is written as IPv6."""
    k, i, u = F.col("s_suppkey"), F.col("event_id"), F.col("user_id")
    hexed = lambda x: F.lower(F.hex(x))
    text = (
        F.when(k % 4 == 0, F.format_string("10.%d.%d.0/24", F.floor(k / 4) % 4, k % 256)).when(k % 4 == 1, F.format_string("10.%d.%d.0/20", F.floor(k / 4) % 4, k % 16 * 16))
        .when(k % 4 == 2, F.concat(F.lit("2001:db8:"), hexed(k % 16), F.lit("::/48"))).otherwise(F.concat(F.lit("2001:0DB8:"), hexed(k % 16), F.lit(":"), hexed(F.floor(k / 16) % 8 * 16), F.lit("::/60")))
    )
    country = F.when(F.col("s_nationkey") > 0, F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))).otherwise("")
    nets = adapter.read(spark, sf, "supplier").select(text.alias("network"), country.alias("country"), F.concat(F.lit("R"), (k % 5).cast("string")).alias("region"), F.lit(None).cast("string").alias("registered"))
    around = spark.createDataFrame([("10.0.0.0/8", "A8", None, None), ("2001:db8::/32", "", None, "V6")], nets.schema)
    dotted = F.format_string("10.%d.%d.%d", u % 4, i % 256, u % 256)
    address = F.when(i % 6 == 0, F.concat(F.lit("::ffff:"), dotted)).when(i % 2 == 0, dotted).otherwise(F.concat(F.lit("2001:db8:"), hexed(u % 16), F.lit(":"), hexed(i % 128), F.lit("::"), hexed(i % 4096)))
    asked = adapter.read(spark, sf, "events").select((i % 2 == 0).alias("four"), address.alias("address"))
    return geo.locate(asked, nets.unionByName(around)).groupBy("country_code", "region", "four").agg(F.count(F.lit(1)).alias("hits"))


@_query("crawlers_by_table", """WITH e AS (SELECT user_id AS u, CASE WHEN event_id % 5 = 0 THEN 'Mozilla/5.0 (compatible; Customer-Fetch-' || user_id || '/2.1; +https://c.example)' WHEN event_id % 5 = 1 THEN 'FETCH ' || user_id || ' Mobile'
  WHEN event_id % 5 = 2 THEN 'OtherBot/3' WHEN event_id % 5 = 3 THEN 'Mozilla/5.0 Firefox/130.0' END AS agent, event_id % 5 AS form FROM events),
k AS (SELECT c_custkey AS c, c_mktsegment || ' ' || c_custkey AS name FROM customer)
SELECT CASE WHEN form = 0 AND c IS NOT NULL THEN name WHEN form = 1 AND c IS NOT NULL AND c % 2 = 0 THEN 'Fetcher ' || c WHEN form = 2 THEN 'OtherBot' WHEN form = 4 THEN 'Unknown' END AS crawler, count(*) AS hits
FROM e LEFT JOIN k ON u = c GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A name for each customer; every second one is also known by a shorter phrase, which counts where the longer fails."""
    c, i, u = F.col("c_custkey").cast("string"), F.col("event_id"), F.col("user_id").cast("string")
    people = adapter.read(spark, sf, "customer")
    table = people.select(F.concat(F.lit("customer-fetch-"), c).alias("phrase"), F.concat("c_mktsegment", F.lit(" "), c).alias("name"))
    table = table.unionByName(people.where("c_custkey % 2 = 0").select(F.concat(F.lit("Fetch "), c).alias("phrase"), F.concat(F.lit("Fetcher "), c).alias("name")))
    agent = (
        F.when(i % 5 == 0, F.concat(F.lit("Mozilla/5.0 (compatible; Customer-Fetch-"), u, F.lit("/2.1; +https://c.example)"))).when(i % 5 == 1, F.concat(F.lit("FETCH "), u, F.lit(" Mobile")))
        .when(i % 5 == 2, "OtherBot/3").when(i % 5 == 3, "Mozilla/5.0 Firefox/130.0")
    )
    rows = adapter.read(spark, sf, "events").select(agent.alias("user_agent"))
    return crawlers.identify(rows, table).groupBy("crawler").agg(F.count(F.lit(1)).alias("hits"))


@_query("consent_decisions", """WITH c AS (SELECT user_id AS u, event_id AS i, cast(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN event_id % 4 = 0 THEN 'denied' WHEN event_id % 17 <> 0 THEN 'granted' END AS state FROM events)
SELECT 'v' || u AS visitor_id, last(state ORDER BY ts, i) AS state, count(*) AS rows FROM c WHERE state IS NOT NULL GROUP BY u""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The last word of every visitor, from choices of which grants by objecting browsers are none."""
    users = adapter.read(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id")
    choices = _requests(spark, sf).join(users, "seq").select(
        F.col("seq").alias("id"), "site_id", F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_id"), F.when(F.col("seq") % 4 == 0, "deny").otherwise("grant").alias("choice"),
        F.lit("banner").alias("method"), "ts", "headers",
    )
    log = governance.decisions(choices, requests.objects(Settings()))
    return log.groupBy("visitor_id").agg(F.max_by("state", F.struct("recorded_at", "id")).alias("state"), F.count(F.lit(1)).alias("rows"))


@_query("withdrawn_journeys", """, c AS (SELECT 'v' || user_id AS visitor_id, max(cast(floor(epoch(ts)) AS BIGINT)) AS until FROM events WHERE event_id % 9 = 0 GROUP BY ALL)
SELECT visitor_id, count(*) AS views FROM hd LEFT JOIN c USING (visitor_id) WHERE visitor_id IS NOT NULL AND kind = 'view' AND count_view AND (until IS NULL OR ts > until) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    refusals = adapter.read(spark, sf, "events").where("event_id % 9 = 0").select(
        F.col("event_id").alias("id"), F.lit(1).alias("site_id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_id"), F.lit("denied").alias("state"), F.lit("banner").alias("method"),
        F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("recorded_at"),
    )
    seen = governance.journeys(adapter.hits(spark, sf), refusals.limit(0))
    return governance.withdrawn(seen, refusals).groupBy("visitor_id").agg(F.count(F.lit(1)).alias("views"))


@_query("recent_consent", """WITH c AS (SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-20') SELECT count(*) AS rows FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = governance.recent(adapter.consent_log(spark, sf), "recorded_at", dt.date(2024, 1, 30), 10)
    return kept.agg(F.count(F.lit(1)).alias("rows"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
