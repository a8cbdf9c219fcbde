"""Shapes that charts need: dense series, folded tails, shares and the hour-of-week grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "Other"


def dense(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(key, date, value): each key on every day of the calendar, duplicates added up, other days dropped.

    The days of a key are made from the calendar's ends, so nothing is crossed.
    """
    ends = calendar.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    sums = rows.groupBy("key", "date").agg(F.sum("value").alias("value"))
    inside = sums.join(calendar, "date", "left_semi")
    keys = rows.select("key").distinct().crossJoin(F.broadcast(ends))  # one row
    grid = keys.select("key", F.explode(F.sequence("_a", "_b")).alias("date"))
    return grid.join(inside, ["key", "date"], "left").select("key", "date", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def fold_to_top(rows: DataFrame, keep: int = 4) -> DataFrame:
    """Series (key, date, value) with all but the largest keys added up as OTHER; ties by key."""
    totals = rows.groupBy("key").agg(F.sum("value").alias("_total"))
    top = totals.orderBy(F.col("_total").desc(), "key").limit(keep).select("key", F.lit(True).alias("_top"))
    named = rows.join(F.broadcast(top), "key", "left").withColumn("key", F.when(F.col("_top"), F.col("key")).otherwise(OTHER))  # `keep` rows
    return named.groupBy("key", "date").agg(F.sum("value").alias("value"))


def shares(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows with `share`, their part of the whole in per cent; zeros where there is no whole."""
    whole = rows.agg(F.sum(value).alias("_whole"))
    share = F.when(F.col("_whole") > 0, F.col(value) / F.col("_whole") * 100).otherwise(F.lit(0.0))
    return rows.crossJoin(F.broadcast(whole)).withColumn("share", share).drop("_whole")  # one row


def bucket(value: Column, largest: Column) -> Column:
    """0 for nothing, else 1 to 6 by the square root of the share of the largest."""
    level = F.greatest(F.lit(1), F.round(F.sqrt(value / largest) * 6).cast("int"))
    return F.when((value > 0) & (largest > 0), level).otherwise(0)


def heatmap(rows: DataFrame, week_start: int = 1) -> DataFrame:
    """All 168 cells of the week from (date, hour, views): position of the day from `week_start` (0 is Sunday)."""
    spark = rows.sparkSession
    views = rows.where("hour between 0 and 23 and date is not null").groupBy((F.dayofweek("date") - 1).alias("weekday"), "hour").agg(F.sum("views").alias("views"))
    cells = spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    filled = cells.join(views, ["weekday", "hour"], "left").withColumn("views", F.coalesce("views", F.lit(0).cast("long")))
    largest = F.max("views").over(Window.partitionBy())
    return filled.select(((F.col("weekday") - week_start + 7) % 7).cast("int").alias("row"), "weekday", "hour", "views", bucket(F.col("views"), largest).alias("bucket"))


def sparkline(series: DataFrame, width: int = 100, height: int = 24) -> DataFrame:
    """One row, `points`: the polyline of (date, value) scaled to a box; a flat line for a flat series."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda p: p["value"].cast("double"))
    one = series.agg(ordered.alias("v"))
    step = F.when(F.size("v") > 1, F.lit(float(width)) / (F.size("v") - 1)).otherwise(0.0)
    top = F.array_max("v")
    y = lambda x: F.when(top > 0, F.lit(float(height)) - x / top * height).otherwise(F.lit(float(height)))
    points = F.transform("v", lambda x, i: F.concat_ws(",", F.round(step * i, 2).cast("string"), F.round(y(x), 2).cast("string")))
    return one.select(F.array_join(points, " ").alias("points"))
