"""Distinct visitors as sets, as bitmaps or as mergeable sketches. Scopes are united, never added.

Bitmaps count exactly and do not grow with traffic: every visitor gets a number once, and a scope holds a bit for each
of its visitors, 32,768 to a range. Numbers run on in the order of arrival and hashes change with the salt, so the
visitors of a day lie in few ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sketch(rows: DataFrame, keys: list[str], column: str, precision: int = 12) -> DataFrame:
    """One sketch for each scope; values that are no visitor hash are left out."""
    usable = rows.where(F.col(column).rlike("^[0-9A-Fa-f]{16}$"))
    return usable.groupBy(*keys).agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def united(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates of the union of sketches by coarser keys; sketches of different precision are refused."""
    return sketches.where("sketch is not null").groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", False)).alias("uniques"))


def numbered(visitors: DataFrame, after: int = 0, groups: int = 64) -> DataFrame:
    """`visitors`, rows that differ, with `number`: after + 1 and on, without gaps.

    Rows are counted and numbered in groups by hash, and each group's numbers follow those of the groups before it, so
    no task orders all of them.
    """
    group = F.pmod(F.xxhash64(*visitors.columns), F.lit(groups)).cast("int")
    rows = visitors.withColumn("_group", group)
    ahead = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # over `groups` rows
    starts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).select("_group", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_group").orderBy(*visitors.columns))
    found = rows.withColumn("_place", place).join(F.broadcast(starts), "_group")
    return found.select(*visitors.columns, (F.lit(after) + F.col("_before") + F.col("_place")).cast("long").alias("number"))


def bitmaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each scope and range of visitor numbers; rows without a number are left out."""
    known = rows.where("number is not null")
    return known.groupBy(*keys, F.bitmap_bucket_number("number").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def counted(bits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct visitors by coarser keys: the scopes' bits are united by range and then counted."""
    united_bits = bits.groupBy(*keys, "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    total: Column = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("long"))
    return united_bits.groupBy(*keys).agg(total.alias("uniques"))


def exact(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.countDistinct(column).alias("uniques"))


def error_bound(precision: int) -> float:
    """Relative standard error of a sketch."""
    return 1.04 / 2 ** (precision / 2)
