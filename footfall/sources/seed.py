"""Synthetic hits for trials: any number of them, made by Spark, the same for the same seed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall.functions.traffic import session_key, visitor_hash
from footfall.schema import HIT

PAGES = {"/": 30, "/blog": 14, "/pricing": 9, "/blog/first-steps": 8, "/docs": 7, "/about": 5, "/contact": 3}
REFERRERS = {"": 50, "https://www.google.com/": 28, "https://duckduckgo.com/": 6, "https://old.reddit.com/r/php": 6, "https://partner.example/": 5}
AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/600 (KHTML, like Gecko) Chrome/130.0 Safari/600": 5,
    "Mozilla/5.0 (iPhone; CPU iPhone OS 18_0 like Mac OS X) AppleWebKit/619 (KHTML, like Gecko) Version/18.0 Mobile/22A1 Safari/619": 4,
    "Mozilla/5.0 (Linux; rv:132.0) Gecko/20241001 Firefox/132.0": 2,
}
HOURS = (1, 1, 1, 1, 1, 2, 3, 5, 8, 9, 9, 8, 8, 9, 9, 8, 7, 6, 6, 7, 7, 5, 3, 2)


def _drawn(name: str, seed: int, *of: str) -> Column:
    """A number from 0 up to 1, fixed by the columns named."""
    return F.pmod(F.xxhash64(*(of or ("seq",)), F.lit(name), F.lit(seed)), F.lit(1 << 30).cast("long")) / (1 << 30)


def _weighted(draw: Column, weights: dict) -> Column:
    total, upto, out = sum(weights.values()), 0, None
    for value, w in weights.items():
        upto += w
        case = draw < upto / total
        out = F.when(case, F.lit(value)) if out is None else out.when(case, F.lit(value))
    return out.otherwise(F.lit(next(iter(weights))))


def hits(spark: SparkSession, visits: int, start: dt.date, days: int, seed: int = 1, site_id: int = 1, weekend: float = 0.55, pages: dict = PAGES) -> DataFrame:
    """About `visits` visits of one to five views over the days; weekends have `weekend` times a weekday's visits."""
    base = spark.range(visits).select(F.col("id").alias("visit"))
    day = F.date_add(F.lit(start.isoformat()).cast("date"), F.floor(_drawn("day", seed, "visit") * days).cast("int"))
    kept = base.withColumn("day", day).where(~F.dayofweek("day").isin(1, 7) | (_drawn("rest", seed, "visit") < weekend))
    begun = F.unix_timestamp(F.col("day").cast("timestamp")) + _weighted(_drawn("hour", seed, "visit"), dict(enumerate(HOURS))) * 3600 + F.floor(_drawn("second", seed, "visit") * 3600)
    each = kept.withColumn("begun", begun.cast("long")).withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(_drawn("length", seed, "visit") * 5).cast("int"))))
    rows = each.withColumn("seq", F.col("visit") * 8 + F.col("step"))
    visitor = visitor_hash(F.lit(f"seed{seed}"), F.floor(F.col("visit") / 3).cast("string"), F.lit(""), F.lit(site_id))
    made = {
        "seq": F.col("seq"), "site_id": F.lit(site_id), "path": _weighted(_drawn("page", seed), pages), "visitor_hash": visitor, "session_key": session_key(visitor, F.lit(site_id)),
        "ts": F.timestamp_seconds(F.col("begun") + F.col("step") * 40), "referrer": F.when(F.col("step") == 0, _weighted(_drawn("from", seed, "visit"), REFERRERS)).otherwise(""),
        "user_agent": _weighted(_drawn("agent", seed, "visit"), AGENTS), "accept_language": F.lit(""), "dwell_ms": F.floor(_drawn("dwell", seed) * 90_000), "count_view": F.lit(True),
        "country_code": _weighted(_drawn("country", seed, "visit"), {"DE": 4, "US": 3, "GB": 2, "FR": 1}), "region": F.lit(""), "kind": F.lit("view"), "segments": F.create_map(),
    }
    return rows.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(HIT)))
