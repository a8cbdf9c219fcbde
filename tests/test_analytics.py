"""Sessions, goals, funnels, caps, the store and streaming on hand-written hits."""

import datetime as dt
import json
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from footfall.operators import governance, rollups, sessions, store, uniques
from footfall.operators.goals import Definitions, Funnel, Goal, reached_step
from footfall.operators.rollups import Cube
from footfall.plans import export, viz
from footfall.schema import HIT
from footfall.settings import Settings
from footfall.sources import hits as wire
from footfall.sources import imports, requests
from footfall.streaming import ingest
from report_server import pages_of_a_report

START = dt.datetime(2026, 7, 16, 10)
V = "0123456789abcdef"


def hit(seq, seconds=0, path="/", visitor=V, **more):
    row = dict(
        seq=seq, site_id=1, path=path, visitor_hash=visitor, session_key=visitor * 2, ts=START + dt.timedelta(seconds=seconds), element_id=None, referrer="", user_agent="",
        accept_language="", dwell_ms=0, count_view=True, visitor_id=None, user_id=None, campaign=None, country_code="", region="", kind="view", event_name=None,
        event_value=None, target=None, scroll_bucket=None, segments={}, search_term=None, crawler=None,
    )
    return row | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], HIT)


def test_gap_of_the_window_starts_a_session(spark):
    rows = sessions.sessions(frame(spark, [hit(1, 0, "/a"), hit(2, 1799, "/b"), hit(3, 1799 + 1800, "/c")]), 1800).orderBy("session_no").collect()
    assert [(r["entry_path"], r["last_path"], r["pageviews"], r["is_bounce"], r["duration_ms"]) for r in rows] == [("/a", "/b", 2, False, 1_799_000), ("/c", "/c", 1, True, 0)]


def test_what_is_no_session(spark):
    rows = [hit(1, 0, kind="event", event_name="x"), hit(2, 5, kind="crawler", visitor="f" * 16), hit(3, 9000, "/x", count_view=False)]
    assert sessions.sessions(frame(spark, rows), 1800).count() == 0


def test_leading_events_are_trimmed_and_first_values_win(spark):
    c = lambda s: (s, "", "", "", "")
    rows = [
        hit(1, 0, kind="event", event_name="x"), hit(2, 10, "/in", campaign=c("a"), segments={"plan": "free"}), hit(3, 20, "/mid", campaign=c("b"), segments={"plan": "pro", "role": "x"}),
        hit(4, 30, "/out", campaign=c("a"), scroll_bucket=75, country_code="DE", region="BE"),
    ]
    s = sessions.sessions(frame(spark, rows), 1800).first()
    assert (s["entry_path"], s["pageviews"], s["max_scroll"], s["country_code"]) == ("/in", 3, 75, "DE")
    assert [x["s"] for x in s["campaigns"]] == ["a", "b"] and s["segments"] == {"plan": "free", "role": "x"}


@pytest.mark.parametrize(("goals", "reached"), [([], 0), (["a"], 1), (["a", "b"], 2), (["a", "b", "c"], 3), (["c", "a", "b"], 2), (["a", "c"], 1), (["a", "x", "b", "y", "c"], 3), (["b"], 0)])
def test_funnel_walk(spark, goals, reached):
    row = spark.createDataFrame([(goals, [])], "goals array<string>, conversions array<string>")
    assert row.select(reached_step(("a", "b", "c"), dict.fromkeys("abc", "url")).alias("n")).first()["n"] == reached


def test_funnel_gates(spark):
    row = spark.createDataFrame([(["a", "b"], ["long"]), (["a", "b"], [])], "goals array<string>, conversions array<string>")
    got = row.select(reached_step(("a", "long", "b"), {"a": "url", "long": "duration", "b": "url"}).alias("n")).collect()
    assert [r["n"] for r in got] == [3, 1]
    assert row.select(reached_step(("a", "gone", "b"), {"a": "url", "b": "url"}).alias("n")).first()["n"] == 1


def test_goals_of_a_session(spark):
    d = Definitions((Goal("view", "url", "/p/*"), Goal("buy", "event", "buy"), Goal("el", "element", "7"), Goal("stay", "duration", "60"), Goal("deep", "scroll", "50"), Goal("off", "url", "*", enabled=False), Goal("other", "url", "*", site_id=2)))
    rows = [hit(1, 0, "/x", element_id=7), hit(2, 50, "/p/1?a=1"), hit(3, 61, "/p/2", kind="event", event_name="buy", scroll_bucket=50)]
    s = sessions.sessions(frame(spark, rows), 1800, d).first()
    assert s["goals"] == ["el", "view", "buy"] and s["conversions"] == ["view", "buy", "el", "stay", "deep"]


def test_definitions():
    d = Definitions((Goal("a", "url", "/"), Goal("b", "url", "/b"), Goal("c", "url", "/c")), (Funnel("f", ("a", "b", "c")),))
    d.delete_goal("b")
    assert d.funnels["f"].steps == ("a", "c")
    d.delete_goal("c")
    assert not d.funnels
    for bad in (lambda: Funnel("f", ("a",)), lambda: Funnel("f", ("a", "a")), lambda: Goal("x", "scroll", "30"), lambda: Goal("x", "nope", "1"), lambda: d.save_funnel(Funnel("g", ("a", "zz")))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("model", ["first-click", "last-click", "linear"])
def test_weights_add_up(spark, model):
    rows = spark.range(3).select(F.sum(rollups.attribution_weight(F.col("id"), F.lit(3), model)).alias("w"))
    assert float(rows.first()["w"]) == pytest.approx(1, abs=2e-4)


def test_first_values_are_admitted(spark):
    rows = spark.createDataFrame([(1, dt.date(2026, 7, 16), f"/p{i}", i) for i in (5, 3, 1, 2, 4, 1)], "site_id int, date date, value string, seq long")
    allowed = rollups.admitted(rows, 2)
    assert {r["value"] for r in allowed.collect()} == {"/p1", "/p2"}
    later = rollups.admitted(rows.where("seq > 3"), 3, allowed)
    assert {r["value"] for r in later.collect()} == {"/p1", "/p2", "/p4"}
    out = rollups.capped(rows.withColumnRenamed("value", "path"), "path", allowed)
    assert out.where("path = '__other__'").count() == 3


@hyp(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20_000), st.booleans()), min_size=1, max_size=12), st.integers(0, 12))
def test_batches_do_not_matter(spark, rows, cut):
    all_hits = [hit(i, s, f"/{p}", count_view=c, dwell_ms=p) for i, (p, s, c) in enumerate(rows)]
    fold = lambda part: rollups.fold_hits(frame(spark, part), Settings(enable_pro=False))
    whole = fold(all_hits)
    parts = [p for p in (all_hits[:cut], all_hits[cut:]) if p]
    merged = fold(parts[0]) if len(parts) == 1 else fold(parts[0]).merged(fold(parts[1]))
    key = lambda d: sorted(map(str, d.select("date", "hour", "path", "views", "dwell_ms").collect()))
    assert key(merged["pages"]) == key(whole["pages"])


def _pages(spark, *rows):
    text = "site_id int, date date, hour int, path string, views long, dwell_ms long, entrances long, exits long, bounces long, element_id int"
    return Cube({"pages": spark.createDataFrame([(1, d, h, p, v, 0, 0, 0, 0, e) for d, h, p, v, e in rows], text)})


def test_store_replays_and_compacts(spark, tmp_path):
    s, old, new = store.Store(spark, str(tmp_path / "store")), dt.date(2026, 7, 1), dt.date(2026, 7, 15)
    first = _pages(spark, (old, 9, "/a", 4, None), (old, 10, "/a", 5, 7), (new, 9, "/a", 1, None))
    for _ in range(2):  # a replay
        s.write_delta(0, first)
    s.write_delta(1, _pages(spark, (old, 10, "/a", 1, None)))
    views = lambda: {(r["date"], r["hour"]): (r["views"], r["element_id"]) for r in s.table("pages").collect()}
    assert views() == {(old, 9): (4, None), (old, 10): (6, 7), (new, 9): (1, None)}
    for _ in range(2):
        s.compact(dt.date(2026, 7, 16), Settings())
        assert views() == {(old, -1): (10, 7), (new, 9): (1, None)}
    s.write_delta(1, _pages(spark, (old, 10, "/a", 1, None)))  # folded already
    s.write_delta(2, _pages(spark, (old, 11, "/a", 10, None)))  # late
    assert views()[old, 11] == (10, None)
    s.compact(dt.date(2026, 7, 16), Settings())
    s.tidy()
    assert views() == {(old, -1): (20, 7), (new, 9): (1, None)}
    s.retain(dt.date(2026, 8, 10), Settings(retention_months=1))
    assert set(views()) == {(new, 9)}


def test_hit_codec(spark, tmp_path):
    rows = frame(spark, [hit(1, dwell_ms=5, segments={"a": "b"}), hit(2, kind="event", event_name="e", event_value=None, count_view=False)])
    wire.write(rows, str(tmp_path / "spool"))
    with open(tmp_path / "spool" / "bad.txt", "w") as f:
        f.write('not json\n\n{"si":0,"v":"' + V + '"}\n{"si":1,"v":"bad"}\n{"si":1,"v":"' + V + '","ts":1,"d":99999999,"sb":33}\n')
    got = wire.read(spark, str(tmp_path / "spool"))
    assert got.where("malformed").count() == 3
    good = {r["kind"] + str(r["dwell_ms"]): r for r in wire.usable(got).collect()}
    assert set(good) == {"view5", "event0", "view3600000"} and good["view5"]["segments"] == {"a": "b"} and not good["event0"]["count_view"]
    assert json.loads(wire.encode(rows).where("value like '%\"d\"%'").first()["value"])["d"] == 5


def test_streams(spark, tmp_path):
    spool, root = str(tmp_path / "in"), str(tmp_path / "store")
    wire.write(frame(spark, [hit(i, i * 60, f"/{i % 2}") for i in range(6)]), spool)
    for _ in range(2):  # the second run finds nothing new
        ingest.roll_up(spark, spool, root, str(tmp_path / "check"), Settings()).awaitTermination()
        assert store.Store(spark, root).table("pages").agg(F.sum("views")).first()[0] == 6
    wire.write(frame(spark, [hit(9, 90_000, "/late", visitor="f" * 16)]), spool)
    ingest.roll_up(spark, spool, root, str(tmp_path / "check"), Settings()).awaitTermination()
    assert store.Store(spark, root).table("pages").agg(F.sum("views")).first()[0] == 7


def _same(a, b, columns):
    key = lambda d: sorted(map(str, d.select(*columns).collect()))
    assert key(a) == key(b)


CAMPAIGN = lambda s: (s, "m", "c", "", "")
VISIT = [
    hit(1, -50, kind="event", event_name="early"), hit(2, 0, "/a", referrer="https://www.google.com/", country_code="DE", region="BE", segments={"plan": "free"}),
    hit(3, 60, "/b", campaign=CAMPAIGN("x"), segments={"plan": "pro", "role": "r"}), hit(4, 70, kind="event", event_name="signup", event_value=Decimal("2.50")),
    hit(5, 900, "/c", campaign=CAMPAIGN("y"), scroll_bucket=75), hit(6, 950, "/c", campaign=CAMPAIGN("x")), hit(7, 4000, "/d", element_id=5),
    hit(8, 10, "/a", visitor="e" * 16), hit(9, 20, "/search?q=Red%20Shoes", visitor="e" * 16),
]
DEFS = Definitions((Goal("s", "event", "signup", value="3.00"), Goal("b", "url", "/b"), Goal("long", "duration", "600"), Goal("deep", "scroll", "75")), (Funnel("f", ("b", "s", "long")),))


@pytest.mark.parametrize("cuts", [(2, 5)])
def test_sessions_in_the_store_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = sorted(VISIT, key=lambda r: (r["ts"], r["seq"]))
    rows = [r | {"seq": i} for i, r in enumerate(rows)]
    s, options = store.Store(spark, str(tmp_path / "store")), Settings(attribution="linear", segments=("plan", "role"))
    parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True)]
    for n, part in enumerate(parts):
        assert ingest.apply(s, frame(spark, part), n, options, DEFS)
        assert not ingest.apply(s, frame(spark, part), n, options, DEFS)  # a replay
    ingest.apply(s, frame(spark, []), len(parts), options, DEFS, as_of=int((START + dt.timedelta(days=2)).timestamp()))
    hits = ingest.with_search_term(frame(spark, rows), options)
    want = rollups.fold(hits, sessions.sessions(hits, 1800, DEFS, segments=("plan", "role")), options, DEFS)
    got = s.cube()
    for name in set(want.tables) - {"page_sources"}:
        _same(got[name], want[name], sorted(want[name].columns))
    assert got["search"].first()["term"] == "red shoes" and got["page_sources"].agg(F.sum("views")).first()[0] == 7


def test_first_element_of_a_page_wins(spark, tmp_path):
    s, day = store.Store(spark, str(tmp_path / "store")), dt.date(2026, 7, 15)
    for n, element in enumerate((None, 5, 9)):
        s.write_delta(n, _pages(spark, (day, 9, "/a", 1, element)))
    assert s.table("pages").first()["element_id"] == 5
    s.rewrite(lambda name, rows: rows)
    s.write_delta(3, _pages(spark, (day, 9, "/a", 1, 1)))
    assert (s.table("pages").first()["element_id"], s.table("pages").first()["views"]) == (5, 4)


def test_maintenance_rewrites_touched_days_only(spark, tmp_path):
    s, days = store.Store(spark, str(tmp_path / "store")), [dt.date(2026, 7, d) for d in (1, 2, 14)]
    s.write_delta(0, _pages(spark, *((d, 9, "/a", 1, None) for d in days)))
    assert s.compact(dt.date(2026, 7, 16), Settings()) == [d.isoformat() for d in days]
    before = s.manifest()["versions"]["pages"]
    s.write_delta(1, _pages(spark, (days[1], 9, "/a", 2, None)))
    assert s.compact(dt.date(2026, 7, 16), Settings()) == ["2026-07-02"]
    after = s.manifest()["versions"]["pages"]
    assert [d for d in after if after[d] != before[d]] == ["2026-07-02"]
    assert s.compact(dt.date(2026, 7, 16), Settings()) == []
    s.tidy()
    assert {(r["date"], r["hour"], r["views"]) for r in s.table("pages").collect()} == {(days[0], -1, 1), (days[1], -1, 3), (days[2], 9, 1)}
    plan = s.table("pages", (F.col("site_id") == 1) & (F.col("date") == F.lit("2026-07-02").cast("date")))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "isnotnull(site_id" in plan
    with s.only_one(), pytest.raises(RuntimeError):
        s.compact(dt.date(2026, 7, 16), Settings())


def test_a_batch_that_comes_during_a_fold_counts_once(spark, tmp_path):
    s, day = store.Store(spark, str(tmp_path / "store")), dt.date(2026, 7, 15)
    s.write_delta(0, _pages(spark, (day, 9, "/a", 1, None)))
    more = [_pages(spark, (day, 9, "/a", 10, None))]

    def meanwhile(name, rows):
        if more:
            s.write_delta(1, more.pop())
        return rows

    before = s.snapshot()
    s.rewrite(meanwhile)
    assert s.manifest()["folded"] == {"hits": 0} and s.table("pages").first()["views"] == 11
    assert s.table("pages", at=before).first()["views"] == 1  # a reader's snapshot stays as it was
    s.tidy()
    assert s.table("pages", at=before).first()["views"] == 1
    s.rewrite(lambda name, rows: rows)
    s.tidy(0)
    assert s.table("pages").first()["views"] == 11 and s._names("delta/pages/feed=hits") == [] and len(s._names("manifest")) == 1


def test_a_stalled_maintainer_publishes_nothing(spark, tmp_path, monkeypatch):
    s, day = store.Store(spark, str(tmp_path / "store")), dt.date(2026, 7, 15)
    s.write_delta(0, _pages(spark, (day, 9, "/a", 1, None)))
    turns = []

    def stalled(name, rows):
        if not turns:
            turns.append(name)
            monkeypatch.setattr(store, "LEASE", -1)  # its lease runs out, another takes over and is done first
            s.write_delta(1, _pages(spark, (day, 9, "/a", 10, None)))
            s.rewrite(lambda name, rows: rows)
        return rows

    with pytest.raises(RuntimeError, match="maintains this store now"):
        s.rewrite(stalled)
    assert s.table("pages").first()["views"] == 11 and s.manifest()["fence"] == 2


def test_half_of_a_failed_batch_is_not_seen(spark, tmp_path):
    s, day = store.Store(spark, str(tmp_path / "store")), dt.date(2026, 7, 15)

    class Lost(dict):
        def items(self):
            yield "pages", _pages(spark, (day, 9, "/a", 7, None))["pages"]
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        s.write_delta(0, Cube(Lost()))
    ingest.set_aside(s, wire.decode(wire.encode(frame(spark, [hit(1)]))), 0, ValueError("bad"))
    assert s.table("pages") is None or s.table("pages").count() == 0
    assert s.note(0)["error"] == "bad" and s.failed() == ["batch=0"]
    s.write_delta(1, _pages(spark, (day, 9, "/a", 7, None)))
    assert s.table("pages").first()["views"] == 7
    first = s.note(1)["attempt"]
    assert not s.write_delta(1, _pages(spark, (day, 9, "/a", 70, None))) and s.note(1)["attempt"] == first
    assert not s._publish("batches/hits/1", {}) and s.note(1)["attempt"] == first


def test_passing_faults_stop_the_stream(spark, tmp_path):
    assert ingest.is_passing(OSError("disk full")) and not ingest.is_passing(ValueError("a hook fails"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "gone"))
    gone = spark.read.parquet(str(tmp_path / "gone"))
    for f in (tmp_path / "gone").glob("part*"):
        f.unlink()
    with pytest.raises(Exception) as missing:
        gone.collect()
    assert ingest.is_passing(missing.value)
    with pytest.raises(Exception) as wrong:
        spark.sql("select raise_error('x')").collect()
    assert not ingest.is_passing(wrong.value)


def test_a_batch_that_fails_is_set_aside(spark, tmp_path):
    spool, root = str(tmp_path / "in"), str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    wire.write(frame(spark, [hit(1, 0, "/a"), hit(2, 5, "/b")]), spool)
    with open(tmp_path / "in" / "bad.txt", "w") as f:
        f.write("no json\n")

    def broken(hits):
        raise ValueError("a hook fails")

    ingest.roll_up(spark, spool, root, str(tmp_path / "check"), Settings(), hooks=ingest.Hooks(broken)).awaitTermination()
    s = store.Store(spark, root)
    assert s.failed() == ["batch=0"] and s.malformed() == 1 and s.table("pages") is None
    assert ingest.retry_failed(s, spool) == 1
    ingest.roll_up(spark, spool, root, str(tmp_path / "check"), Settings(), hooks=ingest.Hooks(lambda h: h.where("path <> '/b'"))).awaitTermination()
    assert [r["path"] for r in s.table("pages").collect()] == ["/a"] and not s.failed()


def test_values_over_the_cap_fold(spark, tmp_path):
    s, options = store.Store(spark, str(tmp_path / "store")), Settings(dimension_cap=10)
    ingest.apply(s, frame(spark, [hit(i, i, f"/{i:02d}") for i in range(12)]), 0, options)
    ingest.apply(s, frame(spark, [hit(i, 20 + i, f"/{i:02d}") for i in (3, 11, 20)]), 1, options)
    got = {r["path"]: r["views"] for r in s.table("pages").collect()}
    assert got == {f"/{i:02d}": 1 for i in range(10)} | {"/03": 2, "__other__": 4}


def test_every_dimension_is_admitted_by_arrival(spark, tmp_path):
    """Labels run against the order of arrival; sessions close in the batch after."""
    s, options = store.Store(spark, str(tmp_path / "store")), Settings(dimension_cap=10)
    rows = []
    for i in range(13):
        z, who = f"{20 - i:02d}", f"{i:016x}"
        rows += [hit(10 * i, i, "/", visitor=who, referrer=f"https://h{z}.example/", campaign=(f"s{z}", "m", f"c{z}", "", ""), segments={"k": z}, search_term=f"t{z}"),
                 hit(10 * i + 1, i, "/", visitor=who, kind="event", event_name=f"e{z}"), hit(10 * i + 2, i, "/", visitor=who, kind="outbound", target=f"https://o{z}.example/x"),
                 hit(10 * i + 3, i, "/", visitor="c" * 16, kind="crawler", crawler=f"b{z}")]
    for n, (a, b) in enumerate(((0, 24), (24, 52))):
        ingest.apply(s, frame(spark, rows[a:b]), n, options)
    ingest.apply(s, frame(spark, []), 2, options, as_of=4_102_444_800)
    first = {f"{20 - i:02d}" for i in range(10)}
    for table, column, begin, end in (
        ("sources", "host", "h", ".example"), ("page_sources", "host", "h", ".example"), ("campaigns", "source", "s", ""), ("campaigns", "campaign", "c", ""), ("segments", "segment", "k:", ""),
        ("search", "term", "t", ""), ("events", "event_name", "e", ""), ("outbound", "host", "o", ".example"), ("outbound", "target", "https://o", ".example/x"), ("crawlers", "crawler", "b", ""),
    ):
        got = {r[column] for r in s.table(table).select(column).distinct().collect()}
        assert got == {f"{begin}{z}{end}" for z in first} | {"__other__"}, (table, column)


def test_many_values_are_ranked_in_parts(spark):
    rows = spark.range(3000).select(F.lit(1).alias("site_id"), F.lit("2026-07-01").cast("date").alias("date"), F.format_string("v%05d", 2999 - F.col("id")).alias("value"), F.col("id").alias("seq"))
    got = {r["value"] for r in rollups.admitted(rows, 1200).collect()}
    assert got == {f"v{2999 - i:05d}" for i in range(1200)}
    plan = rollups.admitted(rows, 1200)._jdf.queryExecution().toString()
    assert "_part" in plan


def test_sketches_in_the_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    for n in range(2):
        ingest.apply(s, frame(spark, [hit(i, i, visitor=f"{i:016x}") for i in range(30)]), n, Settings(unique_counter="hll"))
    assert s.cube()["page_visitors"].count() == 0
    assert uniques.united(s.table("page_sketches"), []).first()["uniques"] == 30


def test_a_long_session(spark):
    """Time follows the number of hits of one session, not its square."""
    rows = spark.range(60_000).select(
        F.col("id").alias("seq"), F.lit(1).alias("site_id"), F.concat(F.lit("/"), F.col("id") % 50).alias("path"), F.lit(V).alias("visitor_hash"), F.lit("k").alias("session_key"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(None).cast("int").alias("element_id"), F.lit("").alias("referrer"), F.lit("").alias("user_agent"),
        F.lit(True).alias("count_view"), F.lit("view").alias("kind"), F.lit(None).cast("string").alias("event_name"), F.lit("").alias("country_code"), F.lit("").alias("region"),
        F.lit(None).cast("int").alias("scroll_bucket"), F.lit(None).cast("struct<s:string,m:string,c:string,t:string,o:string>").alias("campaign"),
        F.create_map(F.lit("n"), (F.col("id") % 3).cast("string"), F.lit("m"), F.lit("x")).alias("segments"),
    )
    began = time.monotonic()
    s = sessions.sessions(rows, 1800).first()
    assert s["pageviews"] == 60_000 and s["segments"] == {"n": "0", "m": "x"} and time.monotonic() - began < 60


def test_sketches(spark):
    rows = spark.range(8000).select((F.col("id") % 2).cast("int").alias("day"), F.substring(F.sha2(F.floor(F.col("id") / 2).cast("string"), 256), 1, 16).alias("v"))
    one = uniques.united(uniques.sketch(rows, ["day"], "v"), []).first()["uniques"]
    assert abs(one - 4000) < 3 * uniques.error_bound(12) * 4000
    assert uniques.exact(rows, [], "v").first()["uniques"] == 4000
    assert uniques.sketch(rows.withColumn("v", F.lit("bad")), ["day"], "v").count() == 0


def test_consent_and_erasure(spark):
    log = spark.createDataFrame([(1, 1, "a", "granted", "x", START), (2, 1, "a", "denied", "x", START), (3, 1, "b", "granted", "x", START)], "id long, site_id int, visitor_id string, state string, method string, recorded_at timestamp")
    rows = frame(spark, [hit(1, 0, visitor_id="a"), hit(2, 1, visitor_id="b"), hit(3, 2, visitor_id="b"), hit(4, 3)])
    j = governance.journeys(rows, log)
    assert {(r["visitor_id"], r["sequence"]) for r in j.collect()} == {("b", 1), ("b", 2)}
    more = governance.journeys(frame(spark, [hit(9, 50, visitor_id="b")]), log, j)
    assert [r["sequence"] for r in more.collect()] == [3]
    assert governance.erased(j, spark.createDataFrame([("b",)], "visitor_id string")).count() == 0
    cookies = spark.createDataFrame([(True, False, "x", None), (True, True, "x", None), (True, False, None, "YES"), (True, False, None, "no"), (True, False, None, None), (False, False, "x", None)], "a boolean, g boolean, o string, m string")
    assert [r[0] for r in cookies.select(governance.consent_state(*(F.col(c) for c in "agom"))).collect()] == ["granted", "denied", "granted", "denied", "unknown", "denied"]


def test_requests(spark):
    text = "method string, status int, content_type string, path string, section_id int, headers map<string,string>"
    base = ("GET", 200, "text/html; charset=utf-8", "/a", 1, {})
    rows = [base, ("POST", *base[1:]), ("GET", 404, *base[2:]), (*base[:3], "/_dynamic_include_1", 1, {}), (*base[:3], "/admin/x", 1, {}), (*base[:4], 9, {})]
    rows += [(*base[:5], h) for h in ({"sec-gpc": "1"}, {"purpose": "prefetch"}, {"sec-fetch-dest": "empty"}, {"sec-fetch-dest": "document"})]
    kept = requests.trackable(spark.createDataFrame(rows, text), Settings(exclude_paths=("/admin/*",), exclude_sections=(9,)))
    assert kept.count() == 2


def test_nonces_count_once(spark):
    text = "seq int, nonce string, visitor_hash string, ts timestamp, count_view boolean"
    beacons = spark.createDataFrame([(1, "n", V, START, True), (2, "n", V, START, True), (3, "m", V, START, True), (4, None, V, START, True)], text)
    served = spark.createDataFrame([("m", V, START - dt.timedelta(seconds=60))], "nonce string, visitor_hash string, ts timestamp")
    got = {r["seq"]: r["count_view"] for r in requests.count_once(beacons, served, 1800).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_geo_ranges(spark):
    nets = spark.createDataFrame([(16_777_216, 16_777_471, "AU", "QLD", None), (16_777_472, 50_331_647, "", "", "CN")], "first long, last long, country string, region string, registered string")
    hits = spark.createDataFrame([(1, "1.0.0.5"), (2, "1.0.1.0"), (3, "9.9.9.9"), (4, "bad")], "seq int, address string")
    got = {r["seq"]: (r["country_code"], r["region"]) for r in requests.locate(hits, nets).collect()}
    assert got == {1: ("AU", "QLD"), 2: ("CN", ""), 3: ("", ""), 4: ("", "")}


def test_imports(spark):
    body = {"dimensionHeaders": [{"name": "date"}, {"name": "pagePath"}], "metricHeaders": [{"name": "screenPageViews"}, {"name": "userEngagementDuration"}, {"name": "activeUsers"}],
            "rows": [{"dimensionValues": [{"value": "20260701"}, {"value": "x"}], "metricValues": [{"value": "3"}, {"value": "1.5"}, {"value": "2"}]}, {"dimensionValues": [{"value": "bad"}, {"value": "/"}], "metricValues": []}]}
    rows = imports.normalize(spark.createDataFrame([(json.dumps(body),)], "value string"))
    pages = imports.dataset(rows, "pages")
    r = pages.first()
    assert (r["path"], r["views"], r["dwell_ms"], r["hour"]) == ("/x", 3, 1500, -1) and imports.seeded_visitors(pages).count() == 2
    assert [imports.dataset(rows, d).count() for d in ("campaigns", "geo", "events")] == [0, 0, 0]
    assert imports.datasets(pro=False) == ("pages", "totals", "sources", "devices")


def test_report_pages_are_partitions(spark, monkeypatch):
    rows = imports.fetched(spark, "report_server:pages_of_a_report", "pages", dt.date(2026, 7, 1), dt.date(2026, 8, 31), 10)
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 25
    assert imports.fetched(spark, "report_server:pages_of_a_report", "geo", dt.date(2026, 7, 1), dt.date(2026, 8, 31)).count() == 0


def test_imports_come_in_once(spark, tmp_path):
    s, day = store.Store(spark, str(tmp_path / "store")), dt.date(2026, 7, 2)
    s.write_delta(0, _pages(spark, (day, 9, "/own", 5, None)))
    s.compact(dt.date(2026, 8, 30), Settings())
    for _ in range(2):  # as files, the second time in vain
        (tmp_path / "in" / "pages").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "pages" / "1.json").write_text(pages_of_a_report("pages", "", "", 0, 12))
        wrong = imports.load(s, str(tmp_path / "in"), pro=False)
        assert set(wrong) == {"totals", "sources", "devices"}
    rows = imports.fetched(spark, "report_server:pages_of_a_report", "pages", dt.date(2026, 7, 1), dt.date(2026, 8, 31), 10)
    assert imports.add(s, rows, "pages")[0] == "2026-07-13" and imports.add(s, rows, "pages") == []
    for _ in range(2):
        got = {(r["date"], r["path"]): r["views"] for r in s.table("pages").collect()}
        assert len(got) == 25 and got[day, "/own"] == 5 and (day, "/1") not in got and set(got.values()) == {2, 5}
        s.compact(dt.date(2026, 8, 30), Settings())
        s.tidy(0)
    assert s.own_days(1) == ["2026-07-02"] and s.own_days(2) == []
    assert s.table("page_visitors").count() == 24 * 3


def test_imported_visitors_are_counted_in_sketches(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    rows = imports.fetched(spark, "report_server:pages_of_a_report", "pages", dt.date(2026, 7, 1), dt.date(2026, 8, 31))
    imports.add(s, rows, "pages", settings=Settings(unique_counter="hll"))
    assert s.cube()["page_visitors"].count() == 0 and uniques.united(s.table("page_sketches"), ["path"]).where("uniques = 3").count() == 25


def test_bitmaps_in_the_store(spark, tmp_path):
    s, options = store.Store(spark, str(tmp_path / "store")), Settings(unique_counter="bitmap")
    name = lambda i: f"{i:016x}"
    parts = [[hit(i, i, f"/{i % 3}", visitor=name(i % 40)) for i in range(60)], [hit(i, 100 + i, f"/{i % 3}", visitor=name(30 + i % 20)) for i in range(40)], []]
    for n, part in enumerate(parts):
        ingest.apply(s, frame(spark, part), n, options)
        if n == 0:
            s.rewrite(lambda name, rows: rows)
    numbers = sorted(r["number"] for r in s.table("visitors").collect())
    assert numbers == list(range(1, 51)) and s.note(2)["visitors"] == 50
    every = [h for part in parts for h in part]
    got = {r["path"]: r["uniques"] for r in uniques.counted(s.table("page_bitmaps"), ["path"]).collect()}
    assert got == {p: len({h["visitor_hash"] for h in every if h["path"] == p}) for p in ("/0", "/1", "/2")}
    s.compact(dt.date(2026, 7, 30), options)
    assert uniques.counted(s.table("page_bitmaps"), []).first()["uniques"] == 50 and s.table("page_visitors") is None
    assert s.table("page_bitmaps").count() == 3


def test_forms_and_beacons(spark):
    forms = spark.createDataFrame([(1, "contact", "https://x.example/about?x=1", False, START), (2, "contact", None, None, START), (3, "spam", None, True, START)], "id int, handle string, referrer string, is_spam boolean, ts timestamp")
    assert sorted((r["event_name"], r["path"]) for r in requests.form_events(forms).collect()) == [("form:contact", "/"), ("form:contact", "/about")]
    text = "seq int, site_id int, ts timestamp, address string, salt string, user_agent string, path string, kind string, event_name string, event_value string, target string, scroll string, dwell string, referrer string, engagement boolean"
    agent = "Mozilla/5.0 Firefox/130.0"
    rows = [
        (1, 1, START, "10.0.0.1", "s", agent, "/a?b=2&utm_source=x", "view", None, None, None, "60", "5000", "https://t.co/y", False),
        (2, 1, START, "10.0.0.1", "s", agent, "/a", "view", None, None, None, None, "100", None, True),
        (3, 1, START, "10.0.0.1", "s", agent, "/a", "event", None, None, None, None, None, None, None), (4, 1, START, "10.0.0.1", "s", "SomeBot/1.0", "/a", "view", None, None, None, None, None, None, None),
    ]
    got = {r["seq"]: r for r in requests.beacon_hits(spark.createDataFrame(rows, text), Settings()).collect()}
    assert set(got) == {1, 2, 4} and got[1]["path"] == "/a?b=2" and got[1]["campaign"]["s"] == "x" and got[1]["count_view"] and not got[2]["count_view"]
    assert got[4]["kind"] == "crawler" and got[1]["visitor_hash"] == got[2]["visitor_hash"] and got[1]["session_key"] == got[2]["session_key"]


def test_export(spark):
    rows = spark.createDataFrame([("=SUM(A1)", -5, 1.239), (" @x", 1, 2.0), ("fine", 0, 0.0)], "a string, n int, x double")
    assert [tuple(r) for r in export.for_csv(rows).collect()] == [("'=SUM(A1)", -5, 1.24), ("' @x", 1, 2.0), ("fine", 0, 0.0)]
    assert json.loads(export.envelope(rows, 1, "a", "b").first()["value"])["rows"][2]["a"] == "fine"


def test_heatmap_and_sparkline(spark):
    rows = spark.createDataFrame([(dt.date(2026, 7, 13), 9, 36), (dt.date(2026, 7, 14), 9, 1), (dt.date(2026, 7, 14), -1, 99)], "date date, hour int, views long")
    got = {(r["row"], r["hour"]): r["bucket"] for r in viz.heatmap(rows).collect()}
    assert len(got) == 168 and got[0, 9] == 6 and got[1, 9] == 1 and sum(got.values()) == 7
    line = spark.createDataFrame([(dt.date(2026, 7, 1), 0), (dt.date(2026, 7, 2), 10)], "date date, value long")
    assert viz.sparkline(line).first()["points"] == "0.0,24.0 100.0,0.0"
