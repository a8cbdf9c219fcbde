"""Hits as newline-delimited JSON: decoding, encoding and the checks every hit passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.traffic import valid_visitor
from footfall.functions.values import dwell, event_value, scroll_bucket
from footfall.schema import WIRE

KINDS = ("view", "event", "outbound", "download", "crawler")


def decode(lines: DataFrame, *kept: str) -> DataFrame:
    """Hits and a flag `malformed` from a column `value` of JSON lines (batch or stream); columns `kept` stay as they are.

    Missing keys take their defaults, a bad segment map costs only the segments, and a line that cannot be
    read or has no site or no valid visitor is flagged, not dropped.
    """
    wire = F.from_json("value", WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # a generator, so that a line is read once and not for every field
    h = lines.where(F.trim("value") != "").select(*kept, F.inline(F.array(wire)))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    kind = F.when(F.col("kd").isin(*KINDS), F.col("kd")).otherwise("view")
    out = h.select(
        F.coalesce("si", F.lit(0)).alias("site_id"), text("p").alias("path"), text("v").alias("visitor_hash"), text("k").alias("session_key"),
        F.timestamp_seconds(F.coalesce("ts", F.lit(0))).alias("ts"), F.col("e").alias("element_id"), text("r").alias("referrer"),
        text("ua").alias("user_agent"), text("al").alias("accept_language"), dwell(F.coalesce("d", F.lit(0))).alias("dwell_ms"),
        (~F.coalesce("nv", F.lit(False))).alias("count_view"), F.col("vid").alias("visitor_id"), F.col("uid").alias("user_id"),
        F.when(F.coalesce(F.col("cm.s"), F.lit("")) != "", F.struct(*(text(f"cm.{k}").alias(k) for k in "smcto"))).alias("campaign"),
        text("cc").alias("country_code"), text("rg").alias("region"), kind.alias("kind"), F.when(kind != "crawler", F.col("en")).alias("event_name"),
        event_value(F.col("ev")).alias("event_value"), F.col("tg").alias("target"), scroll_bucket(F.col("sb")).alias("scroll_bucket"),
        F.coalesce("sg", F.create_map().cast("map<string,string>")).alias("segments"),
        F.lit(None).cast("string").alias("search_term"), F.when(kind == "crawler", text("en")).alias("crawler"),
        F.col("_corrupt_record").isNotNull().alias("unreadable"), *kept,
    )
    bad = F.col("unreadable") | (F.col("site_id") == 0) | ~valid_visitor(F.col("visitor_hash"), F.col("kind"))
    return out.withColumn("malformed", bad).drop("unreadable")


def usable(decoded: DataFrame) -> DataFrame:
    """The hits to count; `decoded.where("malformed")` has the others."""
    return decoded.where(~F.col("malformed")).drop("malformed")


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))


def encode(hits: DataFrame) -> DataFrame:
    """Column `value` of JSON lines; defaults are left out."""

    def unless(column: Column, default: Column) -> Column:
        return F.when(column != default, column)

    c, empty = F.col, F.lit("")
    wire = F.struct(
        c("site_id").alias("si"), unless(c("path"), empty).alias("p"), unless(c("visitor_hash"), empty).alias("v"),
        unless(c("session_key"), empty).alias("k"), F.unix_timestamp("ts").alias("ts"), c("element_id").alias("e"),
        unless(c("referrer"), empty).alias("r"), unless(c("user_agent"), empty).alias("ua"), unless(c("accept_language"), empty).alias("al"),
        unless(c("dwell_ms"), F.lit(0)).alias("d"), F.when(~c("count_view"), F.lit(True)).alias("nv"), c("visitor_id").alias("vid"),
        c("user_id").alias("uid"), c("campaign").alias("cm"), unless(c("country_code"), empty).alias("cc"), unless(c("region"), empty).alias("rg"),
        unless(c("kind"), F.lit("view")).alias("kd"), F.when(c("kind") == "crawler", c("crawler")).otherwise(c("event_name")).alias("en"), c("event_value").cast("string").alias("ev"),
        c("target").alias("tg"), c("scroll_bucket").alias("sb"), F.when(F.size("segments") > 0, c("segments")).alias("sg"),
    )
    return hits.select(F.to_json(wire).alias("value"))


def write(hits: DataFrame, path: str, max_line: int = 4096) -> None:
    """Append hits as text files; lines over `max_line` bytes are not written."""
    encode(hits).where(F.octet_length("value") <= max_line).write.mode("append").text(path)
