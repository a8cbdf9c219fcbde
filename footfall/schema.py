"""Schemas of hits, definitions and rollups."""

from __future__ import annotations

HIT = (
    "seq bigint, site_id int, path string, visitor_hash string, session_key string, ts timestamp, element_id int, "
    "referrer string, user_agent string, accept_language string, dwell_ms bigint, count_view boolean, visitor_id string, "
    "user_id int, campaign struct<s:string,m:string,c:string,t:string,o:string>, country_code string, region string, "
    "kind string, event_name string, event_value decimal(14,2), target string, scroll_bucket int, "
    "segments map<string,string>, search_term string, crawler string"
)

#: The wire form: short keys, defaults left out.
WIRE = (
    "si int, p string, v string, k string, ts bigint, e int, r string, ua string, al string, d bigint, nv boolean, "
    "vid string, uid int, cm struct<s:string,m:string,c:string,t:string,o:string>, cc string, rg string, kd string, "
    "en string, ev string, tg string, sb int, sg map<string,string>, _corrupt_record string"
)

GOAL = "id int, name string, handle string, type string, target string, value decimal(14,2), enabled boolean, site_id int"
FUNNEL_STEP = "funnel string, site_id int, position int, goal string"
CONSENT = "id bigint, site_id int, visitor_id string, state string, method string, recorded_at timestamp"

#: Rollup tables: key columns, then measures with the way they add up.
ROLLUPS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "pages": (("site_id", "date", "hour", "path"), {"views": "sum", "dwell_ms": "sum", "entrances": "sum", "exits": "sum", "bounces": "sum", "element_id": "first"}),
    "page_visitors": (("site_id", "date", "hour", "path", "visitor_hash"), {}),
    "page_sketches": (("site_id", "date", "hour", "path"), {"sketch": "sketch"}),
    "page_bitmaps": (("site_id", "date", "hour", "path", "range"), {"bits": "bits"}),
    "visitors": (("site_id", "date", "visitor_hash"), {"number": "least"}),
    "page_sources": (("site_id", "date", "path", "channel", "host"), {"views": "sum"}),
    "sessions": (("site_id", "date", "hour"), {"sessions": "sum", "bounces": "sum", "duration_ms": "sum", "pageviews": "sum"}),
    "sources": (("site_id", "date", "hour", "channel", "host"), {"sessions": "sum", "bounces": "sum"}),
    "devices": (("site_id", "date", "browser", "major", "os", "device_type"), {"sessions": "sum"}),
    "crawlers": (("site_id", "date", "crawler"), {"requests": "sum"}),
    "campaigns": (("site_id", "date", "source", "medium", "campaign", "term", "content"), {"sessions": "credit", "bounces": "credit", "conversions": "credit", "value": "money"}),
    "geo": (("site_id", "date", "country", "region"), {"sessions": "sum"}),
    "events": (("site_id", "date", "hour", "event_name", "path"), {"count": "sum", "value": "money"}),
    "scroll": (("site_id", "date", "path", "bucket"), {"count": "sum"}),
    "search": (("site_id", "date", "term"), {"count": "sum", "zero_results": "sum"}),
    "outbound": (("site_id", "date", "host", "target", "path"), {"count": "sum"}),
    "segments": (("site_id", "date", "segment"), {"sessions": "sum", "views": "sum", "bounces": "sum", "duration_ms": "sum"}),
    "goals": (("site_id", "date", "goal"), {"conversions": "sum", "value": "money"}),
    "funnel_steps": (("site_id", "date", "funnel", "position"), {"sessions": "sum"}),
}
#: Tables that start hourly and fold to days (hour -1).
HOURLY = ("pages", "page_visitors", "page_sketches", "page_bitmaps", "sessions", "sources", "events")
PRO = ("campaigns", "geo", "events", "scroll", "search", "outbound", "segments", "goals", "funnel_steps")

_TYPES = {
    "site_id": "int", "date": "date", "hour": "int", "channel": "int", "major": "int", "device_type": "int", "bucket": "int", "position": "int", "element_id": "int", "sketch": "binary", "bits": "binary", "range": "bigint", "number": "bigint",
}
_WAYS = {"sum": "bigint", "credit": "decimal(12,4)", "money": "decimal(14,2)"}


def rollup_schema(name: str) -> str:
    """The columns of a rollup, for one that has no rows yet."""
    keys, measures = ROLLUPS[name]
    return ", ".join([*(f"{k} {_TYPES.get(k, 'string')}" for k in keys), *(f"{m} {_WAYS.get(way) or _TYPES[m]}" for m, way in measures.items())])
