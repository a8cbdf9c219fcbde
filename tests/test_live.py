"""Sessions in managed state."""

import datetime as dt
import json
import os

from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from footfall.operators import sessions as ses
from footfall.operators.store import Store
from footfall.settings import Settings
from footfall.sources import hits as wire
from footfall.streaming import guard, ingest, live, slices
from test_analytics import START, V, frame, hit

PART = {"visitor_hash": V, "entry_path": "", "last_path": "", "referrer": "", "user_agent": "", "max_scroll": 0}


def _point(at, seq, view):
    return PART | {"started_at": at, "last_seen_at": at, "pageviews": int(view), "first_seq": seq, "last_seq": seq, "entry_path": f"/{seq}", "last_path": f"/{seq}"}


@hyp(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=12), st.integers(0, 12))
def test_runs_do_not_depend_on_batches(rows, cut):
    points = [_point(at, i, view) for i, (at, view) in enumerate(sorted(rows))]
    whole = live.joined(points, 10)
    first = live.joined(points[:cut], 10)
    assert live.joined(first[-1:] + points[cut:], 10) == whole[len(first[:-1]) :] and first[:-1] == whole[: len(first[:-1])]
    for a, b in zip(whole, whole[1:], strict=False):
        assert b["started_at"] - a["last_seen_at"] >= 10
    assert sum(r["pageviews"] for r in whole) == sum(view for _, view in rows)


def _take(spark, tmp_path, rows):
    if rows:
        wire.write(frame(spark, rows), str(tmp_path / "in"))
    live.follow(spark, str(tmp_path / "in"), str(tmp_path / "closed"), str(tmp_path / "check"), 1800, "0 seconds").awaitTermination()
    closed = spark.read.schema(live.CLOSED).parquet(str(tmp_path / "closed")).collect()
    seen = sorted((r["visitor_hash"][0], r["entry_path"], r["last_path"], r["pageviews"], r["max_scroll"]) for r in closed)
    now = sorted((r["visitor_hash"][0], r["pageviews"], r["last_seen_at"]) for r in live.open_now(spark, str(tmp_path / "check")).collect())
    return seen, now


def _guard(spark, root, batches, limit=3, ttl=1800):
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, guard.ARRIVAL).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = guard.guarded(spark.readStream.schema(guard.ARRIVAL).parquet(f"{root}/in"), limit, ttl, "1 second")
        with live.managed_state(spark):
            query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted((r["seq"], r["count_view"]) for r in spark.read.parquet(f"{root}/out").collect())


def test_nonces_are_claimed_once_and_expire(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    row = lambda seq, s, served, nonce, visitor=V: (1, visitor, at(s), seq, served, nonce, True, f"v{seq}")
    rows = [
        row(1, 0, True, "a"), row(2, 1, False, "a"), row(3, 2, False, "a"), row(4, 3, False, None), row(5, 4, False, "b"),  # the fourth beacon of a minute goes
        row(6, 70, True, "c"), row(7, 71, False, "c", "f" * 16), row(8, 1870, False, "c"), row(9, 1871, False, "c"), row(10, 2000, True, "d"), row(11, 3801, False, "d"),
    ]
    want = [(2, False), (3, True), (4, True), (7, True), (8, False), (9, True), (11, True)]
    for n, cuts in enumerate(((11,), (1, 2, 5, 7, 10))):
        parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True)]
        assert _guard(spark, str(tmp_path / str(n)), parts) == want
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "1" / "check"))
    assert all("d" not in r["value"]["nonces"] and "a" not in r["value"]["nonces"] for r in held.collect())  # what was never claimed has been let go


def test_a_timer_closes_what_is_idle(spark, tmp_path):
    other = "f" * 16
    at = lambda s: START + dt.timedelta(seconds=s)
    seen, now = _take(spark, tmp_path, [hit(1, -5, kind="event", event_name="x"), hit(2, 0, "/a"), hit(3, 60, "/b", scroll_bucket=50), hit(4, 70, "/z", visitor="c" * 16, kind="crawler", crawler="B")])
    assert seen == [] and now == [("0", 2, at(60))]
    seen, now = _take(spark, tmp_path, [hit(5, 900, "/x", visitor=other), hit(6, 1000, "/c")])  # the visitor goes on
    assert seen == [] and now == [("0", 3, at(1000)), ("f", 1, at(900))]
    seen, now = _take(spark, tmp_path, [hit(7, 1000 + 1799, "/y", visitor=other)])
    assert seen == [("f", "/x", "/x", 1, 0)] and now == [("0", 3, at(1000)), ("f", 1, at(2799))]  # a gap of the window and more
    seen, now = _take(spark, tmp_path, [hit(8, 2800, "/w", visitor=other)])  # nothing of the first visitor, whose window has passed
    assert seen == [("0", "/a", "/c", 3, 50), ("f", "/x", "/x", 1, 0)] and now == [("f", 2, at(2800))]
    assert _take(spark, tmp_path, []) == (seen, now)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_batches_of_so_many_bytes(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    line = json.dumps({"si": 1, "p": "/a", "v": "a" * 16, "k": "b" * 32, "ts": 1_780_000_000})
    for n in range(6):
        (spool / f"{n}.txt").write_text((line + "\n") * 10)
    size = (spool / "0.txt").stat().st_size
    for name, budget, batches in (("two", 2 * size, [20, 20, 20]), ("least", 1, [10] * 6)):
        took = []
        stream = ingest.hit_stream(spark, str(spool), bytes_per_trigger=budget).writeStream.option("checkpointLocation", str(tmp_path / name))
        stream.foreachBatch(lambda rows, n, took=took: took.append(rows.count())).trigger(availableNow=True).start().awaitTermination()
        assert took == batches


def _spool(folder, name, hits, age, per_line=1_780_000_000):
    lines = [json.dumps({"si": 1, "p": f"/{i}", "v": "a" * 16, "k": "b" * 32, "ts": per_line + i}) for i in hits]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))
    os.utime(folder / name, (1_790_000_000 + age,) * 2)


def test_slices_stop_inside_a_file(spark, tmp_path, monkeypatch):
    spool, root, check = tmp_path / "spool", str(tmp_path / "store"), str(tmp_path / "check")
    _spool(spool, "z.txt", range(50), 0)  # older, though its name is later
    _spool(spool, "a.txt", range(50, 57), 60)
    with open(spool / "z.txt", "a") as f:
        f.write("no json\n")
    os.utime(spool / "z.txt", (1_790_000_000,) * 2)
    s = Store(spark, root)
    monkeypatch.setattr(slices, "FEW_BLOCKS", 1)  # the blocks are met by a shuffle
    seen = lambda: sorted(int(r["path"][1:]) for r in s.table("pages").collect())
    assert ingest.drain(spark, str(spool), root, check, Settings(), 1, 20) == 1
    assert seen() == list(range(20)) and s.malformed() == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)  # other splits than those of the first run
    try:
        assert ingest.drain(spark, str(spool), root, check, Settings(), None, 33) == 2  # the plan of the first run holds
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen() == list(range(57)) and s.malformed() == 1
    notes = [s.note(n) for n in s.written()]
    assert [(n["epoch"], n["slice"], n["slices"]) for n in notes] == [(0, 0, 3), (0, 1, 3), (0, 2, 3)]
    assert not s._exists("slices/0")
    # one visitor, whose session goes on from slice to slice
    assert [r["pageviews"] for r in s.open_sessions(2, ses.SUMMARY).collect()] == [57]
    assert ingest.drain(spark, str(spool), root, check, Settings()) == 0
    _spool(spool, "b.txt", range(57, 60), 120)
    ingest.roll_up(spark, str(spool), root, check, Settings()).awaitTermination()  # whole batches go on where slices ended
    assert seen() == list(range(60)) and s.note(3)["epoch"] == 1 and s.written() == [0, 1, 2, 3]


def test_a_slice_that_fails_is_set_aside_alone(spark, tmp_path):
    spool, root, check = tmp_path / "spool", str(tmp_path / "store"), str(tmp_path / "check")
    _spool(spool, "a.txt", range(6), 0)

    def broken(hits):
        if hits.where("path = '/3'").count():
            raise ValueError("a hook fails")
        return hits

    assert ingest.drain(spark, str(spool), root, check, Settings(), None, 2, attempts=1, hooks=ingest.Hooks(broken)) == 3
    s = Store(spark, root)
    assert s.failed() == ["batch=1"] and sorted(r["path"] for r in s.table("pages").collect()) == ["/0", "/1", "/4", "/5"]
    assert ingest.retry_failed(s, str(spool)) == 1
    assert ingest.drain(spark, str(spool), root, check, Settings(), None, 2) == 1
    assert s.table("pages").count() == 6


def test_slices_of_nothing(spark, tmp_path):
    spool, root = tmp_path / "spool", str(tmp_path / "store")
    spool.mkdir()
    (spool / "bad.txt").write_text("no json\n\n")
    assert ingest.drain(spark, str(spool), root, str(tmp_path / "check"), Settings()) == 1
    s = Store(spark, root)
    assert s.malformed() == 1 and s.table("pages").isEmpty() and s.note(0)["slices"] == 1


def test_every_block_has_its_place(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, lines in enumerate((300, 0, 1, 200)):
        (folder / f"{n}.txt").write_text("".join(f"{n}-{i}\n" for i in range(lines)))
        os.utime(folder / f"{n}.txt", (1_790_000_000 - n,) * 2)
    wanted = [f"{n}-{i}" for n, lines in ((3, 200), (2, 1), (0, 300)) for i in range(lines)]
    for size in (100, 10_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = slices.placed(spark.read.text(str(folder)).select("value", F.col("_metadata").alias("file"))).orderBy("place").collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r["value"] for r in got] == wanted and [r["place"] for r in got] == list(range(501))


def test_a_visitor_of_many_beacons_is_in_no_one_place(spark, tmp_path):
    """What a step is given at once are the rows of an hour or of a part of the nonces; the result is that of one place."""
    rows = [(1, V, START + dt.timedelta(seconds=60 * (n // 2)), n, n % 2 == 0, f"n{n // 2 % 90}", True, "") for n in range(1200)]
    assert _guard(spark, str(tmp_path / "all"), [rows]) == [(n, False) for n in range(1, 1200, 2)]
    stream = guard.guarded(spark.readStream.schema(guard.ARRIVAL).parquet(str(tmp_path / "all" / "in")), 3, 1800)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "hour#" in plan and "part#" in plan
