"""Networks and crawlers by tables, against plain versions."""

import ipaddress
import random

from pyspark.sql import functions as F

from footfall.sources import crawlers, geo

MALFORMED = ["", "bad", "1.2.3", "1.2.3.256", "01.2.3.4", ":", "::1::", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::1", "12345::", "1::2:3:4:5:6:7:8", "::1.2.3.400", "1.2.3.4:5", None]
ODD = ["1.2.3.4", "::", "::1", "2001:DB8::ff", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1::", "1:2:3:4:5:6:1.2.3.4"]
PLACES = "network string, country string, region string, registered string"


def _plain(text):
    ip = ipaddress.ip_address(text.split("%")[0])
    return (ip.ipv4_mapped or ip) if ip.version == 6 else ip


def test_address_bits(spark):
    draw = random.Random(5)
    texts = ODD + [str(ipaddress.IPv6Address(draw.getrandbits(128) & draw.choice([-1, ~0xFFFF << 48, 0xFFFF << 100, 0xFFFF]) & (2**128 - 1))) for _ in range(40)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in texts + MALFORMED], "a string").select("a", geo.address_bits(F.col("a"))).collect()}
    for x in texts:
        assert got[x] == f"{_plain(x).version}{int(_plain(x)):0{_plain(x).max_prefixlen}b}", x
    assert all(got[x] is None for x in MALFORMED)


def test_longest_network(spark):
    draw = random.Random(6)
    nets = [(f"10.{draw.randrange(4)}.{draw.randrange(256)}.{draw.randrange(256)}", draw.choice([8, 12, 16, 17, 20, 24, 30, 32])) for _ in range(60)]
    nets += [(f"2001:db8:{draw.randrange(4):x}:{draw.randrange(4):x}::{draw.randrange(16):x}", draw.choice([12, 32, 48, 62, 64, 125, 128])) for _ in range(60)]
    nets = sorted({str(ipaddress.ip_network(f"{a}/{n}", strict=False)) for a, n in nets})
    rows = [(n, "" if k % 7 == 0 else f"C{k}", f"R{k}", None if k % 2 else "REG") for k, n in enumerate(nets)]
    asked = [f"10.{draw.randrange(5)}.{draw.randrange(256)}.{draw.randrange(256)}" for _ in range(100)] + [f"2001:db8:{draw.randrange(5):x}:{draw.randrange(5):x}::{draw.randrange(16):x}" for _ in range(100)]
    asked += ["::ffff:10.1.2.3", "10.1.2.3", "10.1.2.3", "nowhere", None]
    hits = spark.createDataFrame(list(enumerate(asked)), "country_code int, address string").withColumnRenamed("country_code", "seq").withColumn("region", F.lit("old"))
    got = {r["seq"]: (r["country_code"], r["region"]) for r in geo.locate(hits, spark.createDataFrame(rows, PLACES)).collect()}
    assert len(got) == len(asked)
    for k, text in enumerate(asked):
        try:
            ip = _plain(text)
        except (ValueError, AttributeError):
            assert got[k] == ("", "")
            continue
        held = [(ipaddress.ip_network(n).prefixlen, c or g or "", r) for n, c, r, g in rows if ip in ipaddress.ip_network(n)]
        best = max(held, default=(0, "", ""))
        assert got[k] == ((best[1], best[2]) if best[1] else ("", "")), text


def test_networks_said_twice_and_none(spark):
    hits = spark.createDataFrame([(1, "10.0.0.1")], "seq int, address string")
    twice = spark.createDataFrame([("10.0.0.0/8", "FR", "b", None), ("::ffff:10.0.0.0/104", "DE", "z", None), ("10.0.0.0/40", "XX", "", None), (None, "XX", "", None)], PLACES)
    assert geo.locate(hits, twice).collect()[0][2:] == ("DE", "z")
    assert geo.locate(hits, twice.limit(0)).collect()[0][2:] == ("", "")
    assert geo.locate(hits.limit(0), twice).count() == 0


def test_crawlers_by_table(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# fetchers\nacme bot\tAcme\nacme\tAcme (other)\nZed-Reader\n\nbot\tAny bot\n")
    table = crawlers.from_file(spark, str(tmp_path / "names.txt"))
    agents = ["Mozilla/5.0 (compatible; ACME-Bot/2.1)", "acme/1", "acmebot", "zed reader", "Reader Zed", "Mozilla/5.0 Firefox/130.0", "", None, "x " * 20_000 + "acme", "OtherBot/1.0", "bot acme"]
    hits = spark.createDataFrame(list(enumerate(agents)), "seq int, user_agent string").withColumn("crawler", F.lit("old"))
    got = {r["seq"]: r["crawler"] for r in crawlers.identify(hits, table).collect()}
    assert got == {0: "Acme", 1: "Acme (other)", 2: "Acmebot", 3: "Zed-Reader", 4: None, 5: None, 6: "Unknown", 7: "Unknown", 8: "Acme (other)", 9: "OtherBot", 10: "Acme (other)"}
    none = {r["seq"]: r["crawler"] for r in crawlers.identify(hits, table.limit(0)).collect()}
    assert none[0] == "ACME-Bot" and none[1] is None


def test_crawlers_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(crawlers, "BROADCAST", 10)
    table = spark.range(50).select(F.concat(F.lit("fetcher "), F.col("id").cast("string")).alias("phrase"), F.concat(F.lit("F"), F.col("id").cast("string")).alias("name"))
    hits = spark.range(200).select(F.concat(F.lit("Fetcher/"), (F.col("id") % 60).cast("string")).alias("user_agent"))
    got = crawlers.identify(hits, table)
    assert got.count() == 200
    assert {r[0] for r in got.select("crawler").distinct().collect()} == {f"F{n}" for n in range(50)} | {"Fetcher"}  # the rule's name
