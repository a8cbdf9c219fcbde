"""Consent, journeys, and what a person may ask to see or to have erased."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRANTED_VALUES = ("granted", "true", "1", "yes", "allow")


def consent_state(available: Column, gpc: Column, own_cookie: Column, manager_cookie: Column, granted: tuple[str, ...] = GRANTED_VALUES) -> Column:
    """denied, granted or unknown from the browser's signal, our own cookie and a consent manager's."""
    manager = F.lower(F.trim(manager_cookie))
    return (
        F.when(~F.coalesce(available, F.lit(False)) | F.coalesce(gpc, F.lit(False)), "denied")
        .when(F.coalesce(own_cookie, F.lit("")) != "", "granted")
        .when(manager.isin(*granted), "granted")
        .when(manager_cookie.isNotNull() & (manager != ""), "denied")
        .otherwise("unknown")
    )


def decisions(choices: DataFrame, objects: Column) -> DataFrame:
    """Log rows of what visitors chose: (id, site_id, visitor_id, state, method, recorded_at).

    choices: (id, site_id, visitor_id, choice, method, ts, ...) with choice grant or deny. A grant from a browser that
    objects (`objects`) is none; a refusal always counts.
    """
    state = F.when(F.col("choice") == "deny", "denied").when((F.col("choice") == "grant") & ~objects, "granted")
    return choices.select("id", "site_id", "visitor_id", state.alias("state"), "method", F.col("ts").alias("recorded_at")).where("state is not null")


def withdrawn(journey: DataFrame, log: DataFrame) -> DataFrame:
    """Journeys without the rows, up to their refusal, of visitors who refused: what they did after a later grant stays."""
    refused = log.where("state = 'denied' and visitor_id is not null").groupBy("site_id", "visitor_id").agg(F.max("recorded_at").alias("_until"))
    joined = journey.join(refused, ["site_id", "visitor_id"], "left")
    return joined.where(F.col("_until").isNull() | (F.col("occurred_at") > F.col("_until"))).select(*journey.columns)


def latest_consent(log: DataFrame) -> DataFrame:
    """(site_id, visitor_id, state): each visitor's last word by time, then id."""
    return log.groupBy("site_id", "visitor_id").agg(F.max_by("state", F.struct("recorded_at", "id")).alias("state"))


def journeys(hits: DataFrame, log: DataFrame, existing: DataFrame | None = None, keep_user: bool = False) -> DataFrame:
    """A row for each view of a consenting visitor, numbered on within (visitor, session).

    A visitor whose last word is a refusal is left out whatever the hits say.
    """
    denied = latest_consent(log).where("state = 'denied'").select("site_id", "visitor_id")
    own = hits.where("visitor_id is not null and kind = 'view' and count_view").join(denied, ["site_id", "visitor_id"], "left_anti")
    keys = ("site_id", "visitor_id", "session_key")
    rows = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq")))
    if existing is not None:
        last = existing.groupBy(*keys).agg(F.max("sequence").alias("_last"))
        rows = rows.join(last, list(keys), "left")
    else:
        rows = rows.withColumn("_last", F.lit(0))
    user = F.col("user_id") if keep_user else F.lit(None).cast("int")
    return rows.select(*keys, (F.col("_n") + F.coalesce("_last", F.lit(0))).cast("int").alias("sequence"), "path", user.alias("user_id"), F.col("ts").alias("occurred_at"))


def subject(journey: DataFrame, log: DataFrame, visitor_id: str) -> tuple[DataFrame, DataFrame]:
    """What is held on one visitor: journey and consent history, oldest first."""
    return journey.where(F.col("visitor_id") == visitor_id).orderBy("occurred_at", "sequence"), log.where(F.col("visitor_id") == visitor_id).orderBy("recorded_at", "id")


def erased(journey: DataFrame, visitors: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Journeys without those of the visitors (visitor_id) and users (user_id) given."""
    out = journey
    if visitors is not None:
        out = out.join(visitors.select("visitor_id").distinct(), "visitor_id", "left_anti")
    if users is not None:
        out = out.join(users.select("user_id").distinct(), "user_id", "left_anti")
    return out.select(*journey.columns)


def recent(rows: DataFrame, column: str, today: dt.date, days: int) -> DataFrame:
    """Rows of the last `days` days; 0 keeps all."""
    if days == 0:
        return rows
    return rows.where(F.to_date(column) >= F.lit((today - dt.timedelta(days=days)).isoformat()).cast("date"))


def counts(journey: DataFrame, log: DataFrame) -> DataFrame:
    """By site: consenting visitors, journey rows, grants and denials."""
    seen = journey.groupBy("site_id").agg(F.countDistinct("visitor_id").alias("visitors"), F.count(F.lit(1)).alias("rows"))
    said = log.groupBy("site_id").agg(F.count(F.when(F.col("state") == "granted", 1)).alias("grants"), F.count(F.when(F.col("state") == "denied", 1)).alias("denials"))
    zero = F.lit(0).cast("long")
    return seen.join(said, "site_id", "full").select("site_id", *(F.coalesce(c, zero).alias(c) for c in ("visitors", "rows", "grants", "denials")))


def allowed_sites(rows: DataFrame, sites: list[int]) -> DataFrame:
    return rows.where(F.col("site_id").isin(sites))
