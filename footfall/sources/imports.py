"""Pre-aggregated history from exported reports, at daily grain (hour -1)."""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from footfall.functions.traffic import CHANNELS, DEVICE_TYPES
from footfall.operators import uniques
from footfall.operators.rollups import Cube
from footfall.operators.store import IMPORTED, Store
from footfall.schema import rollup_schema
from footfall.settings import Settings

# An exported report's placeholders for "no value", its datasets and their Pro subset.
PLACEHOLDERS = ("", "(not set)", "(direct)", "(none)", "(organic)", "(referral)", "(data not available)")
DATASETS = ("pages", "totals", "sources", "campaigns", "devices", "geo", "events")
PRO_DATASETS = ("campaigns", "geo", "events")
# End of fixed values.
MAX_SEEDED = 100_000

_CELLS = "array<struct<value:string>>"
RESPONSE = (
    "dimensionHeaders array<struct<name:string>>, metricHeaders array<struct<name:string>>, "
    f"rows array<struct<dimensionValues:{_CELLS},metricValues:{_CELLS}>>"
)


def normalize(responses: DataFrame) -> DataFrame:
    """(date, dims map, metrics map) rows from report responses in column `value`; rows with a bad date go."""
    parsed = responses.select(F.from_json("value", RESPONSE).alias("r")).select("r.dimensionHeaders", "r.metricHeaders", F.explode("r.rows").alias("row"))

    def zipped(headers: str, cells: str) -> Column:
        pairs = F.zip_with(headers, cells, lambda h, c: F.struct(h["name"].alias("k"), F.coalesce(c["value"], F.lit("")).alias("v")))
        return F.map_from_entries(F.filter(pairs, lambda p: p["k"].isNotNull()))

    rows = parsed.select(zipped("dimensionHeaders", "row.dimensionValues").alias("dims"), zipped("metricHeaders", "row.metricValues").alias("metrics"))
    given = F.element_at("dims", "date")
    date = F.when(given.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(given, F.lit("yyyyMMdd"))))
    return rows.withColumn("date", date).where("date is not null")


def is_placeholder(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(*PLACEHOLDERS)


def _dim(name: str) -> Column:
    return F.coalesce(F.element_at("dims", name), F.lit(""))


def _metric(name: str) -> Column:
    return F.coalesce(F.element_at("metrics", name).try_cast("double"), F.lit(0.0))


def _whole(x: Column) -> Column:
    return F.round(x).cast("long")


def channel(group: Column) -> Column:
    g = F.trim(group)
    paid = g.contains("Paid")
    return (
        F.when(g.isin("", "Direct", "Unassigned"), CHANNELS["Direct"])
        .when(g.contains("Search"), F.when(paid, CHANNELS["Campaign"]).otherwise(CHANNELS["Search"]))
        .when(g.contains("Social"), F.when(paid, CHANNELS["Campaign"]).otherwise(CHANNELS["Social"]))
        .when(g == "Referral", CHANNELS["Referral"])
        .otherwise(CHANNELS["Campaign"])
    )


def _or_unknown(x: Column) -> Column:
    return F.when(is_placeholder(x), "Unknown").otherwise(F.trim(x))


def _campaign_value(x: Column) -> Column:
    return F.when(is_placeholder(x), "").otherwise(F.lower(F.trim(x)))


def dataset(rows: DataFrame, name: str, site_id: int = 1) -> DataFrame:
    """One dataset's rollup rows, added up by key; pages carry `visitors`, the number to seed."""
    site, daily = F.lit(site_id).alias("site_id"), F.lit(-1).alias("hour")
    sessions = _whole(_metric("sessions"))
    bounces = _whole(sessions * _metric("bounceRate"))
    if name == "pages":
        path = F.trim(_dim("pagePath"))
        path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        out = rows.where(F.trim(_dim("pagePath")) != "").select(
            site, "date", daily, path.alias("path"), _whole(_metric("screenPageViews")).alias("views"),
            _whole(_metric("userEngagementDuration") * 1000).alias("dwell_ms"), _whole(_metric("activeUsers")).alias("visitors"),
        )
        keys, sums = ("site_id", "date", "hour", "path"), ("views", "dwell_ms", "visitors")
    elif name == "totals":
        out = rows.select(
            site, "date", daily, sessions.alias("sessions"), bounces.alias("bounces"),
            _whole(_metric("userEngagementDuration") * 1000).alias("duration_ms"), _whole(_metric("screenPageViews")).alias("pageviews"),
        )
        keys, sums = ("site_id", "date", "hour"), ("sessions", "bounces", "duration_ms", "pageviews")
    elif name == "sources":
        host = F.when(is_placeholder(_dim("sessionSource")), "").otherwise(_dim("sessionSource"))
        out = rows.select(site, "date", daily, channel(_dim("sessionDefaultChannelGroup")).alias("channel"), host.alias("host"), sessions.alias("sessions"), bounces.alias("bounces"))
        keys, sums = ("site_id", "date", "hour", "channel", "host"), ("sessions", "bounces")
    elif name == "campaigns":
        credit = "decimal(12,4)"
        out = rows.select(
            site, "date", *(_campaign_value(_dim(d)).alias(c) for c, d in (("source", "sessionSource"), ("medium", "sessionMedium"), ("campaign", "sessionCampaignName"))),
            F.lit("").alias("term"), F.lit("").alias("content"), _metric("sessions").cast(credit).alias("sessions"),
            (_metric("sessions") * _metric("bounceRate")).cast(credit).alias("bounces"),
        ).where("source <> '' or campaign <> ''")
        keys, sums = ("site_id", "date", "source", "medium", "campaign", "term", "content"), ("sessions", "bounces")
    elif name == "devices":
        kind, category = F.lit(DEVICE_TYPES["Unknown"]), F.lower(F.trim(_dim("deviceCategory")))
        for label in ("Desktop", "Mobile", "Tablet"):
            kind = F.when(category == label.lower(), DEVICE_TYPES[label]).otherwise(kind)
        out = rows.select(site, "date", _or_unknown(_dim("browser")).alias("browser"), F.lit(0).alias("major"), _or_unknown(_dim("operatingSystem")).alias("os"), kind.alias("device_type"), sessions.alias("sessions"))
        keys, sums = ("site_id", "date", "browser", "major", "os", "device_type"), ("sessions",)
    elif name == "geo":
        country = F.upper(F.trim(_dim("countryId")))
        out = rows.where(country.rlike("^[A-Z]{2}$")).select(site, "date", country.alias("country"), F.when(is_placeholder(_dim("region")), "").otherwise(_dim("region")).alias("region"), sessions.alias("sessions"))
        keys, sums = ("site_id", "date", "country", "region"), ("sessions",)
    elif name == "events":
        out = rows.where(F.trim(_dim("eventName")) != "").select(
            site, "date", daily, F.trim(_dim("eventName")).alias("event_name"), F.lit("").alias("path"), _whole(_metric("eventCount")).alias("count"), F.lit(0).cast("decimal(14,2)").alias("value"),
        )
        keys, sums = ("site_id", "date", "hour", "event_name", "path"), ("count", "value")
    else:
        raise ValueError(f"unknown dataset: {name}")
    return out.groupBy(*keys).agg(*(F.sum(m).cast(out.schema[m].dataType).alias(m) for m in sums))


def datasets(pro: bool = True) -> tuple[str, ...]:
    return DATASETS if pro else tuple(d for d in DATASETS if d not in PRO_DATASETS)


def seeded_visitors(pages: DataFrame) -> DataFrame:
    """Synthetic visitor rows for imported pages, as many as reported, up to MAX_SEEDED; the same at every run."""
    n = F.least("visitors", F.lit(MAX_SEEDED))
    keys = ("site_id", "date", "hour", "path")
    each = pages.where("visitors > 0").select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
    return each.select(*keys, F.substring(F.sha2(F.concat_ws("|", *keys, "i"), 256), 1, 16).alias("visitor_hash"))


#: The rollup that each dataset adds to.
ROLLUP_OF = {"pages": "pages", "totals": "sessions", "sources": "sources", "campaigns": "campaigns", "devices": "devices", "geo": "geo", "events": "events"}


def _filled(rows: DataFrame, rollup: str) -> DataFrame:
    """The rollup's columns; what an import does not report is zero, or null for elements."""
    types = dict(part.split(" ", 1) for part in rollup_schema(rollup).split(", "))
    zero = lambda c: F.lit(None) if c == "element_id" else F.lit(0)
    return rows.select(*((F.col(c) if c in rows.columns else zero(c)).cast(t).alias(c) for c, t in types.items()))


def loaded_dates(store: Store, name: str, site_id: int) -> list[str]:
    """The ledger: the dates of a dataset that imports have added, from the markers of their batches."""
    source = f"{IMPORTED}{name}"
    return sorted({d for n in store.written(source) for note in [store.note(n, source)] if note.get("site_id") == site_id for d in note["dates"]})


def _free(store: Store, rows: DataFrame, name: str, site_id: int) -> DataFrame:
    """Rows of dates that neither the site's own hits nor an import of this dataset have counted."""
    taken = [F.lit(d).cast("date") for d in sorted({*store.own_days(site_id), *loaded_dates(store, name, site_id)})]
    return rows.where(~F.col("date").isin(taken)) if taken else rows


def add(store: Store, rows: DataFrame, name: str, site_id: int = 1, settings: Settings | None = None) -> list[str]:
    """Add one dataset's rows (date, dims, metrics) as the next batch of its source; the dates that it added.

    The batch's marker is the ledger's entry, so an import that dies adds nothing and can be run again, and a date
    comes in once whatever reports it is in.
    """
    settings, source = settings or Settings(), f"{IMPORTED}{name}"
    free = _free(store, dataset(rows, name, site_id), name, site_id).persist()
    try:
        dates = [r["day"] for r in free.select(F.col("date").cast("string").alias("day")).distinct().orderBy("day").collect()]  # days of a report
        if dates:
            tables = {ROLLUP_OF[name]: _filled(free, ROLLUP_OF[name])}
            if name == "pages":
                tables |= _seeds(seeded_visitors(free), settings)
            if not store.write_delta(max(store.written(source), default=-1) + 1, Cube(tables), source, {"site_id": site_id, "dates": dates}):
                raise RuntimeError(f"another import of {name} came between")
        return dates
    finally:
        free.unpersist()


def _seeds(visitors: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Synthetic visitors in the form that the site counts in; bitmaps number real ones only, so imports add none."""
    if settings.unique_counter == "hll":
        return {"page_sketches": uniques.sketch(visitors, ["site_id", "date", "hour", "path"], "visitor_hash", settings.hll_precision)}
    return {} if settings.unique_counter == "bitmap" else {"page_visitors": visitors}


def load(store: Store, folder: str, site_id: int = 1, pro: bool = True, settings: Settings | None = None) -> dict[str, str]:
    """Add `folder/<dataset>/*`, each file one page of a dataset's report, to a store; by dataset what went wrong.

    A dataset is added as a whole or not at all, and one that fails leaves the others alone. Days that the store
    counts itself are left out, and so are dates of a dataset that are there already.
    """
    out, spark = {}, store.spark
    for name in datasets(pro):
        try:
            add(store, normalize(spark.read.text(f"{folder}/{name}", wholetext=True)), name, site_id, settings)
        except Exception as e:  # noqa: BLE001  one dataset's fault is not the others'
            out[name] = str(e).split("\n")[0]
    return out


# reports as a source


@dataclass
class Page(InputPartition):
    offset: int
    limit: int


class ReportPages(DataSource):
    """A report by its pages: spark.read.format("report_pages"), one response in column `value` for each page.

    Options: `fetch`, "module:function" of a function (dataset, start, end, offset, limit) that asks for a page and
    returns the response as JSON text with `rowCount` in it; `dataset`, `start`, `end`; `limit`, rows of a page. The
    driver asks once for the number of rows; each page is then asked for by a task of its own, again if it is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "report_pages"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._options, self._limit = options, int(options.get("limit", 10_000))

    def _ask(self, offset: int, limit: int) -> str:
        module, _, function = self._options["fetch"].partition(":")
        return getattr(importlib.import_module(module), function)(self._options["dataset"], self._options["start"], self._options["end"], offset, limit)

    def partitions(self) -> list[Page]:
        total = int(json.loads(self._ask(0, 1)).get("rowCount") or 0)
        return [Page(at, self._limit) for at in range(0, total, self._limit)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        if partition.limit:
            yield (self._ask(partition.offset, partition.limit),)


def fetched(spark: SparkSession, fetch: str, name: str, start: dt.date, end: dt.date, limit: int = 10_000) -> DataFrame:
    """Rows (date, dims, metrics) of a dataset's report, its pages asked for by tasks."""
    spark.dataSource.register(ReportPages)
    options = {"fetch": fetch, "dataset": name, "start": start.isoformat(), "end": end.isoformat(), "limit": str(limit)}
    return normalize(spark.read.format("report_pages").options(**options).load())
