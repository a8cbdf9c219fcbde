"""Reports that belong together on one screen or in one message, each part a lazy DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from footfall.operators.goals import Definitions
from footfall.plans import export, viz
from footfall.plans.reports import Reports

Parts = dict[str, DataFrame]


def dashboard(r: Reports, limit: int = 10) -> Parts:
    """Totals with changes, the trend (by hour for a single day), and the busiest pages, sources and devices."""
    return {
        "summary": r.summary(),
        "trend": r.hourly_trend() if r.range.is_hourly else r.trend(),
        "pages": r.top_pages(limit),
        "channels": viz.shares(r.channels(), "sessions"),
        "sources": r.sources(limit),
        "devices": r.devices("device_type"),
    }


def page_detail(r: Reports, path: str) -> Parts:
    out = {"totals": r.page_totals(path), "trend": r.paths_trend([path]), "sources": r.page_sources(path), "since": r.page_sources_since()}
    if "events" in r.cube.tables:
        out |= {"events": r.events(path=path), "outbound": r.outbound(path=path)}
    return out


def mailed(r: Reports, definitions: Definitions, limit: int = 10) -> Parts:
    """What a summary by mail holds."""
    return {"summary": r.summary(), "pages": r.top_pages(limit), "sources": r.sources(limit), "goals": r.goals(definitions)}


def api(r: Reports, limit: int = 10) -> Parts:
    return {"totals": r.totals(), "pages": r.top_pages(limit), "sources": r.sources(limit), "channels": r.channels()}


def exports(r: Reports, definitions: Definitions | None = None, entries: DataFrame | None = None, limit: int = export.MAX_ROWS) -> Parts:
    """The tables offered as files; devices and content come as one table each, named by a column."""
    r = replace(r, most=export.MAX_ROWS)
    out = {
        "pages": r.top_pages(limit), "sources": r.sources(limit), "trend": r.trend(),
        "devices": export.by_name({k: r.devices(k) for k in ("browser", "os", "device_type")}, "group"),
    }
    if entries is not None:
        out["content"] = export.by_name({k: r.content(entries, k, limit) for k in ("section", "entry_type", "author")}, "group")
    if definitions is not None:
        out["goals"] = r.goals(definitions)
    return {name: export.for_csv(rows) for name, rows in out.items()}


def overview(r: Reports) -> Parts:
    """A small widget: totals and the line of daily views."""
    series = r.trend().select("date", "views").withColumnRenamed("views", "value")
    return {"totals": r.totals(), "line": viz.sparkline(series)}
