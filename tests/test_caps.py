"""What looking over a batch's values costs."""

from pyspark.sql import functions as F

from footfall import queries
from footfall.operators import rollups
from footfall.operators.rollups import Cube
from footfall.operators.store import Store
from footfall.settings import Settings
from footfall.streaming import ingest
from test_analytics import frame, hit


def test_tasks_do_not_grow_with_tables_times_partitions(spark):
    tables = {
        "pages": "1 AS site_id, DATE '2024-01-05' AS date, concat('/', id % 3) AS path", "page_visitors": "1 AS site_id, DATE '2024-01-05' AS date, concat('/', id % 5) AS path",
        "search": "1 AS site_id, DATE '2024-01-05' AS date, concat('t', id % 2) AS term",
    }
    cube = Cube({n: spark.range(0, 100, 1, 60).selectExpr(*cols.split(", ", 2)) for n, cols in tables.items()})
    spark.sparkContext.setJobGroup("caps", "caps")
    try:
        assert rollups.over_cap(cube, 4, lambda name: None) == ["path"]
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("caps") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= 2 * spark.sparkContext.defaultParallelism


def test_batches_of_caps_by_arrival_read_their_hits_once(spark, tmp_path, monkeypatch):
    count, whole = spark.sparkContext.accumulator(0), queries.adapter.hits

    def counted(path):
        count.add(1)
        return path

    monkeypatch.setattr(queries.adapter, "hits", lambda spark, sf: whole(spark, sf).withColumn("path", F.udf(counted, "string")("path")))
    events = spark.range(0, 300, 1, 2).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 600) AS ts", "id % 7 AS user_id", "element_at(array('view', 'click', 'signup', 'error'), cast(id % 4 + 1 AS int)) AS event_type",
        "cast(id AS double) AS value", "concat('{\"k\": ', id % 40, '}') AS props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = queries.queries()["caps_by_arrival"](spark, str(tmp_path)).collect()
    assert {r["value"] for r in rows} > {"__other__"}
    assert count.value <= 300


def test_tasks_of_a_small_batch_do_not_grow_with_shuffle_partitions(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup("batch", "batch")
    try:
        assert ingest.apply(Store(spark, str(tmp_path / "store")), frame(spark, [hit(1), hit(2, 60), hit(3, 9_000)]), 0, Settings())
        tracker = spark.sparkContext.statusTracker()
        stages = {s: tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("batch") for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert stages and sum(s.numCompletedTasks for s in stages.values() if s) <= 15 * 40
