"""Journeys in files that erasures find by filters, and results of reports that are kept."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from footfall.operators import journeys
from footfall.operators.journeys import Journeys
from footfall.operators.rollups import Cube
from footfall.operators.store import Store
from footfall.plans.cache import ReportCache
from footfall.plans.ranges import DateRange

DAYS = DateRange(dt.date(2026, 7, 10), dt.date(2026, 7, 11))
TODAY = dt.date(2026, 7, 20)


def _rows(spark, start, count):
    ids = spark.range(start, start + count)
    text = F.format_string("%016x", F.xxhash64("id"))
    return ids.select(
        F.lit(1).alias("site_id"), text.alias("visitor_id"), F.lit("s").alias("session_key"), F.lit(1).alias("sequence"), F.lit("/").alias("path"), F.col("id").cast("int").alias("user_id"),
        F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id")).alias("occurred_at"),
    )


@pytest.fixture
def held(spark, tmp_path):
    own = Journeys(spark, str(tmp_path / "journeys"))
    for n in range(3):
        assert own.append(n, _rows(spark, n * 4000, 4000).repartition(4, "visitor_id"))
    assert not own.append(2, _rows(spark, 0, 10))
    return own


def test_erasure_rewrites_files_that_hold_the_subject(spark, held):
    before = set(held._files(held.manifest()))
    assert len(before) == 12 and held.rows().count() == 12_000
    subject = held.rows().where("user_id = 4321").select("visitor_id").collect()[0][0]
    assert held.erase(visitors=spark.createDataFrame([(subject,), ("nobody",), (None,)], "visitor_id string")) == 1
    after = set(held._files(held.manifest()))
    assert len(before & after) == 11 and held.rows().count() == 11_999 and held.rows().where("user_id = 4321").count() == 0
    assert held.purge() == 1 and held.purge() == 0 and held.rows().count() == 11_999
    assert held.erase(visitors=spark.createDataFrame([(subject,)], "visitor_id string")) == 0


def test_erasure_of_users_and_of_many(spark, held, monkeypatch):
    assert held.erase(users=spark.createDataFrame([(5,), (9999,)], "user_id int")) == 2
    monkeypatch.setattr(journeys, "LOOKED_UP", 3)
    many = held.rows().where("user_id % 100 = 0").select("visitor_id")
    assert held.erase(visitors=many) > 0
    assert held.rows().count() == 12_000 - 2 - 120 and held.rows().where("user_id % 100 = 0").count() == 0
    assert held.erase(visitors=many.limit(0)) == 0


def test_small_files_are_joined(held, spark):
    sizes = held._sizes(held.manifest())
    assert set(sizes) == set(held._files(held.manifest())) and all(sizes.values())
    reading, rows = held.rows(), lambda: sorted(map(tuple, held.rows().collect()))
    before = rows()
    assert held.join_small(min(sizes.values())) == 0  # none is less than half of that
    assert held.join_small(sum(sizes.values()) // 3) == 12 and 3 <= len(held._files(held.manifest())) <= 4
    assert rows() == before and reading.count() == 12_000  # the files of who began before are still there
    own = held.rows().groupBy("_metadata.file_path").agg(F.min("visitor_id").alias("a"), F.max("visitor_id").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(own, own[1:], strict=False))  # each visitor in one
    assert held.purge() == 12 and rows() == before
    subject = spark.createDataFrame([(before[0][1],)], "visitor_id string")
    assert held.erase(visitors=subject) == 1 and held.rows().count() == 11_999
    held.join_small()
    assert len(held._files(held.manifest())) == 1 and held.join_small() == 0 and held.rows().count() == 11_999
    # one visitor of many rows is still cut, and rows without a visitor stay
    hot = held.rows().withColumn("visitor_id", F.when(F.col("user_id") > 5, "hot"))
    held.append(3, hot.repartition(8))
    small = [n for f, n in held._sizes(held.manifest()).items() if f.split("/")[1].startswith(str(held.manifest()["fence"]))]
    assert len(small) == 8 and held.join_small(2 * max(small) + 2) >= 8
    files = held.rows().where("visitor_id = 'hot'").select("_metadata.file_path").distinct().count()
    assert files > 1 and held.rows().where("visitor_id is null").count() + held.rows().where("visitor_id = 'hot'").count() == 11_999


def test_filters_are_in_the_files(held):
    """A column of random names, about as many as rows: only a Bloom filter can tell that one is not there."""
    import pyarrow.parquet as pq

    path = f"{held.root}/{held._files(held.manifest())[0]}"
    meta = pq.ParquetFile(path).metadata
    written = held.spark.read.parquet(path).select("visitor_id")
    own = meta.row_group(0).column(meta.schema.names.index("visitor_id"))
    assert own.statistics.min < "8" < own.statistics.max
    # the scan hands on no row for a name between its limits that is not in the file
    plan = written.where("visitor_id = '8000000000000000'")
    assert plan.collect() == []
    metrics = plan._jdf.queryExecution().executedPlan().collectLeaves()
    assert any(metrics.apply(i).metrics().apply("numOutputRows").value() == 0 for i in range(metrics.size()))


def test_retention_and_empty_journeys(spark, held, tmp_path):
    cut = F.timestamp_seconds(F.lit(1_780_000_000 + 4000))
    assert held.retain(F.col("occurred_at") >= cut) == 4 and held.rows().count() == 8000
    none = Journeys(spark, str(tmp_path / "none"))
    assert none.rows().count() == 0 and none.purge() == 0 and none.retain(F.lit(True)) == 0
    assert none.erase(visitors=spark.createDataFrame([("x",)], "visitor_id string")) == 0


def _pages(spark, day, views):
    return Cube({"pages": spark.createDataFrame([(1, day, 5, p, v, 0, 0, 0, 0, None) for p, v in views], "site_id int, date date, hour int, path string, views long, dwell_ms long, entrances long, exits long, bounces long, element_id int")})


def _kept(store, read, period=DAYS, today=TODAY, **more):
    return ReportCache(store).report("top", ("pages",), read, 1, period, today, **more)


def test_results_are_kept_until_their_days_change(spark, tmp_path):
    own, asked = Store(spark, str(tmp_path / "store")), []

    def read(r):
        asked.append(r)
        return r.top_pages(10)

    own.write_delta(0, _pages(spark, DAYS.start, [("/b", 3), ("/a", 7)]))

    def paths(**more):
        return [(r["path"], r["views"]) for r in ReportCache(own).report("top", ("pages", "page_visitors"), read, 1, DAYS, TODAY, **more).collect()]

    assert paths() == paths() == [("/a", 7), ("/b", 3)] and len(asked) == 1
    files = ReportCache(own).report("top", ("pages", "page_visitors"), read, 1, DAYS, TODAY).inputFiles()
    assert files and all("/results/" in f for f in files)
    own.write_delta(1, _pages(spark, dt.date(2026, 7, 15), [("/a", 1)]))  # a day out of range
    assert paths() == [("/a", 7), ("/b", 3)] and len(asked) == 1
    own.write_delta(2, _pages(spark, DAYS.end, [("/b", 9)]))  # late hits
    assert paths() == [("/b", 12), ("/a", 7)] and len(asked) == 2
    own.rewrite(lambda name, rows: rows)
    assert paths() == [("/b", 12), ("/a", 7)] and len(asked) == 3
    paths(arguments=(5,)), paths(counter="hll")
    assert len(asked) == 5
    paths(), paths(arguments=(5,))
    assert len(asked) == 5


def test_today_is_not_kept_and_results_run_out(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"))
    own.write_delta(0, _pages(spark, DAYS.start, [("/a", 1)]))
    read = lambda r: r.rows("pages").select("path", "views")
    assert _kept(own, read, today=DAYS.end).count() == 1 and own._names("results") == []
    assert _kept(own, read).count() == 1 and len(own._names("results")) == 1
    assert ReportCache(own).tidy() == 0 and ReportCache(own, life=0).tidy() == 1 and own._names("results") == []
    assert _kept(own, read).count() == 1
