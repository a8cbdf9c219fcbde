"""Column functions on hand-written cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from footfall.functions import traffic, urls, values
from footfall.plans.ranges import DateRange, months_before
from footfall.settings import Settings


def _map(spark, values_, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalized_paths(spark):
    cases = {
        "": "/blog", "utm_source=a&gclid=b": "/blog", "b=2&a=1": "/blog?a=1&b=2", "a=1&amp;utm_source=x": "/blog?a=1", "amp;amp;b=2": "/blog?b=2",
        "a=1&a=2": "/blog?a=2", "q=a%20b": "/blog?q=a+b", "_ga=1&token=2": "/blog", "x=50%": "/blog?x=50%25",
    }
    assert _map(spark, cases, lambda q: urls.normalize_path(F.lit("blog"), q)) == list(cases.values())
    assert _map(spark, ["a=1"], lambda q: urls.normalize_path(F.lit("//x"), q, strip_query=True)) == ["/x"]
    assert _map(spark, ["a=1&b=2"], lambda q: urls.normalize_path(F.lit("x"), q, exclude=("a",))) == ["/x?b=2"]


def test_beacon_paths(spark):
    cases = {"/de/news/p3": "news", "/de//a%20b/": "a b", "/other": "other", "/de": "", "/de/de/x": "de/x", "/a+b": "a+b"}
    assert _map(spark, cases, lambda p: urls.beacon_path(p, "de")) == list(cases.values())
    assert _map(spark, ["/ok", "no", "/a://b", "/a\nb", "/" + "x" * 1024, None], urls.usable_path) == [True, False, False, False, False, False]


def test_campaigns(spark):
    got = _map(spark, ["utm_source=News%20Letter&utm_medium=Mail", "utm_medium=x", "", "a=1&amp;utm_source=B&amp;amp;utm_campaign=C", None], urls.campaign)
    assert [g and (g["s"], g["m"], g["c"]) for g in got] == [("news letter", "mail", ""), None, None, ("b", "", "c"), None]


@pytest.mark.parametrize(
    ("referrer", "name"),
    [("", "Direct"), ("not a url", "Direct"), ("https://www.google.co.uk/x", "Search"), ("https://news.google.de", "Search"), ("https://notgoogle.com", "Referral"),
     ("https://t.co/a", "Social"), ("https://out.reddit.com", "Social"), ("https://example.org", "Referral"), ("https://bing.com.evil.org", "Referral")],
)
def test_channels(spark, referrer, name):
    assert _map(spark, [referrer], lambda r: traffic.label(traffic.channel(r, F.lit(False)), traffic.CHANNELS)) == [name]
    assert _map(spark, [referrer], lambda r: traffic.channel(r, F.lit(True))) == [traffic.CHANNELS["Campaign"]]


def test_devices_and_bots(spark):
    chrome = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/126.0.0.0 Safari/537.36"
    ipad = "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Mobile/15E148 Safari/604.1"
    got = _map(spark, [chrome, ipad, "", chrome.replace("126", "73469"), None], traffic.device)
    assert [(g["browser"], g["major"], g["os"], g["type"]) for g in got] == [("Chrome", 126, "Windows", 1), ("Safari", 16, "iPad", 3), ("Unknown", 0, "Unknown", 0), ("Chrome", 0, "Windows", 1), ("Unknown", 0, "Unknown", 0)]
    agents = [chrome, "", "Mozilla/5.0 (compatible; Googlebot/2.1)", chrome.replace("Chrome", "HeadlessChrome"), None]
    assert _map(spark, agents, traffic.is_bot) == [False, True, True, True, True]
    assert _map(spark, agents[1:4], traffic.crawler_name) == ["Unknown", "Googlebot", "Headlesschrome"]
    assert _map(spark, ["10", "90", "x", None], lambda s: traffic.is_bot(F.lit(chrome), score=s)) == [True, False, False, False]


def test_values(spark):
    assert [str(v) if v is not None else None for v in _map(spark, ["1.005", "1e20", "-1e20", "nan", "abc", None], values.event_value)] == ["1.01", "1000000000.00", "-1000000000.00", None, None, None]
    assert _map(spark, ["-5", "10", "99999999", "x"], values.dwell) == [0, 10, 3_600_000, 0]
    assert _map(spark, ["25", "30", "100"], values.scroll_bucket) == [25, None, 100]
    assert _map(spark, ["javascript:x", "https://a.b/c", "ftp://a", ""], values.target) == [None, "https://a.b/c", None, None]
    assert _map(spark, [0, 4], lambda x: values.ratio(F.lit(1), x), "int") == [0.0, 25.0]
    assert _map(spark, [0, 4], lambda x: values.delta(F.lit(6), x), "int") == [None, 50.0]
    assert values.clamp_limit(0) == 1 and values.clamp_limit(999) == 200


def test_segments(spark):
    declared = tuple(values.Segment(k, from_beacon=k != "b") for k in "abcdefg") + (values.Segment("plan", ("Free", "Pro")),)
    rows = spark.createDataFrame([({k: k.upper() for k in "abcdefg"}, {"c": "Server", "plan": "pro"})], "beacon map<string,string>, server map<string,string>")
    got = rows.select(values.resolve_segments(F.col("beacon"), F.col("server"), declared).alias("s")).first()["s"]
    assert got == {"a": "a", "c": "server", "d": "d", "e": "e", "f": "f"}
    assert _map(spark, ["PRO", "none", " "], lambda v: values.segment_value(v, declared[-1])) == ["Pro", None, None]


@pytest.mark.parametrize(("pattern", "path", "hit"), [("/blog/*", "/blog/a/b", True), ("/blog/?", "/blog/ab", False), ("/x[12]", "/x2", True), ("/x[!12]", "/x2", False), ("/a.b", "/axb", False)])
def test_globs(spark, pattern, path, hit):
    assert _map(spark, [path], lambda p: p.rlike(urls.glob(pattern))) == [hit]


def test_ranges():
    today = dt.date(2026, 7, 16)
    assert DateRange.preset("7d", today).days == 7 and DateRange.preset("nonsense", today).token == "30d"
    assert DateRange.preset("12mo", today).start == dt.date(2025, 7, 17)
    r = DateRange.parse("2026-07-10:2026-07-01", today)
    assert (r.start, r.end) == (dt.date(2026, 7, 1), dt.date(2026, 7, 10)) and r.previous().end == dt.date(2026, 6, 30) and r.previous().days == r.days
    assert DateRange.parse("2020-01-01:2030-01-01", today).days == 400 and not DateRange.is_valid("2026-02-30:2026-03-01")
    assert months_before(dt.date(2026, 3, 31), 1) == dt.date(2026, 3, 3) and months_before(dt.date(2026, 7, 16), 26) == dt.date(2024, 5, 16)


def test_settings_keep_their_bounds():
    for bad in ({"hll_precision": 10}, {"session_window": 59}, {"dimension_cap": 5}, {"retention_months": 27}, {"attribution": "x"}, {"unique_counter": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(ValueError):
        Settings.named(nothing=1)
