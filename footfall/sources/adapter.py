"""Hits, content and definitions from the star-schema tables, by one fixed mapping.

`HITS_SQL` is the same mapping as SQL, for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.traffic import session_key, visitor_hash
from footfall.functions.urls import search_term
from footfall.functions.values import event_value
from footfall.operators.goals import Definitions, Funnel, Goal

AGENTS = (
    "Mozilla/5.0 (Windows NT 11.0; ARM64) AppleWebKit/600.1 (KHTML, like Gecko) Chrome/131.0.6778.33 Safari/600.1",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 18_1_1 like Mac OS X) AppleWebKit/619.2.8 (KHTML, like Gecko) Version/18.1 Mobile/22B91 Safari/619.2",
    "Mozilla/5.0 (Wayland; Linux aarch64; rv:133.0) Gecko/20241127 Firefox/133.0",
    "Mozilla/5.0 (iPad; CPU OS 15_8_3 like Mac OS X) AppleWebKit/613.3.9 (KHTML, like Gecko) Version/15.6 Mobile/19H386 Safari/613.3",
    "Mozilla/5.0 (Windows NT 6.3; WOW64) AppleWebKit/600.1 (KHTML, like Gecko) Chrome/109.0.5414.168 Safari/600.1 Edg/109.0.1518.140",
)
REFERRERS = ("", "https://www.google.com/search", "https://m.facebook.com/", "https://blog.example.org/a", "", "https://t.co/x")

DEFINITIONS = Definitions(
    (
        Goal("early", "url", "/p/[0-4]*", value="1.50"),
        Goal("signup", "event", "signup", value="10.00"),
        Goal("purchase", "event", "purchase", value="25.25"),
        Goal("five", "element", "6", value="2.00"),
        Goal("hour", "duration", "3600", value="0.10"),
        Goal("deep", "scroll", "75", value="0.00"),
    ),
    (Funnel("buy", ("early", "signup", "purchase")), Funnel("read", ("early", "hour", "purchase"))),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a generator, so that the JSON is read once and not wherever its number is used
    number = F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", number)
    k, u, seq, kind = F.col("k"), F.col("user_id"), F.col("event_id"), F.col("event_type")
    path = F.when(k % 10 == 9, "/search").otherwise(F.concat(F.lit("/p/"), k.cast("string")))
    query = F.when(k % 10 == 9, F.concat(F.lit("q=Term%20"), (k % 7).cast("string"))).otherwise("")
    visitor = visitor_hash(F.lit("salt"), u.cast("string"), F.lit(""), F.lit(1))
    error = kind == "error"
    campaign = F.when(
        (u % 6 == 4) | (seq % 11 == 0),
        F.struct(*(x.alias(n) for n, x in (("s", F.concat(F.lit("src"), (k % 3).cast("string"))), ("m", F.lit("mail")), ("c", F.concat(F.lit("c"), (seq % 4).cast("string"))), ("t", F.lit("")), ("o", F.lit(""))))),
    )
    return e.select(
        seq.alias("seq"), F.lit(1).alias("site_id"), path.alias("path"), visitor.alias("visitor_hash"), session_key(visitor, F.lit(1)).alias("session_key"),
        F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ts"),
        F.when(kind.isin("view", "click"), k + 1).alias("element_id"), _pick(REFERRERS, u % 6).alias("referrer"), _pick(AGENTS, u % 5).alias("user_agent"),
        F.lit("").alias("accept_language"), (seq % 600 * 100).cast("long").alias("dwell_ms"), (seq % 13 != 0).alias("count_view"),
        F.when(u % 2 == 0, F.concat(F.lit("v"), u.cast("string"))).alias("visitor_id"), u.cast("int").alias("user_id"), campaign.alias("campaign"),
        _pick(("DE", "FR", "US", ""), u % 4).alias("country_code"), F.concat(F.lit("R"), (u % 3).cast("string")).alias("region"),
        F.when(kind.isin("view", "click"), "view").when(error & (k % 2 == 1), "crawler").when(error, "outbound").otherwise("event").alias("kind"),
        F.when(kind.isin("signup", "purchase"), kind).alias("event_name"), F.when(kind.isin("signup", "purchase"), event_value(F.col("value"))).alias("event_value"),
        F.when(error & (k % 2 == 0), F.concat(F.lit("https://Out"), (k % 7).cast("string"), F.lit(".example/x"), (k % 20).cast("string"))).alias("target"),
        F.when(kind == "click", (k % 4 + 1) * 25).alias("scroll_bucket"),
        F.create_map(F.lit("plan"), _pick(("free", "pro", "team"), u % 3), F.lit("role"), _pick(("reader", "editor"), seq % 2)).alias("segments"),
        search_term(path, query).alias("search_term"), F.when(error & (k % 2 == 1), F.concat(F.lit("Bot"), (k % 5).cast("string"))).alias("crawler"),
    )


def entries(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Elements with section, entry type, title and the suppliers that wrote them (several each).

    of: (element_id) of those asked for, all if not given; others go before anything is grouped or joined.
    """
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_brand").alias("section"), F.col("p_type").alias("entry_type"), F.col("p_name").alias("title"))
    wrote = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("element_id"), F.col("l_suppkey").alias("s_suppkey"))
    if of is not None:
        part, wrote = part.join(of, "element_id", "left_semi"), wrote.join(of, "element_id", "left_semi")
    wrote = wrote.distinct()
    names = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("author"))
    return part.join(wrote.join(names, "s_suppkey"), "element_id", "left").select("element_id", "section", "entry_type", "title", "author")


def consent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.lit(1).alias("site_id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_id"),
        F.when(F.col("event_id") % 3 == 0, "denied").otherwise("granted").alias("state"), F.lit("banner").alias("method"),
        F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("recorded_at"),
    )


def _case(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({at} + 1)::INT]"


HITS_SQL = f"""
e AS (SELECT *, (props->>'k')::INT AS k FROM events),
h AS (SELECT event_id AS seq, 1 AS site_id, CASE WHEN k % 10 = 9 THEN '/search' ELSE '/p/' || k END AS path,
  substr(sha256('salt|' || user_id || '||1'), 1, 16) AS visitor_hash,
  cast(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN event_type IN ('view', 'click') THEN k + 1 END AS element_id,
  {_case(REFERRERS, "user_id % 6")} AS referrer, {_case(AGENTS, "user_id % 5")} AS user_agent, event_id % 600 * 100 AS dwell_ms,
  event_id % 13 <> 0 AS count_view, CASE WHEN user_id % 2 = 0 THEN 'v' || user_id END AS visitor_id, user_id,
  CASE WHEN user_id % 6 = 4 OR event_id % 11 = 0 THEN 'src' || k % 3 || '|mail|c' || event_id % 4 END AS campaign,
  {_case(("DE", "FR", "US", ""), "user_id % 4")} AS country, 'R' || user_id % 3 AS region,
  CASE WHEN event_type IN ('view', 'click') THEN 'view' WHEN event_type = 'error' AND k % 2 = 1 THEN 'crawler'
       WHEN event_type = 'error' THEN 'outbound' ELSE 'event' END AS kind,
  CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS event_name,
  CASE WHEN event_type IN ('signup', 'purchase') THEN value::DECIMAL(14,2) END AS event_value,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'https://Out' || k % 7 || '.example/x' || k % 20 END AS target,
  CASE WHEN event_type = 'click' THEN (k % 4 + 1) * 25 END AS scroll_bucket,
  {_case(("free", "pro", "team"), "user_id % 3")} AS plan, {_case(("reader", "editor"), "event_id % 2")} AS role,
  CASE WHEN k % 10 = 9 THEN 'term ' || k % 7 END AS search_term,
  CASE WHEN event_type = 'error' AND k % 2 = 1 THEN 'Bot' || k % 5 END AS crawler
  FROM e),
hd AS (SELECT *, make_timestamp(ts * 1000000)::DATE AS date, hour(make_timestamp(ts * 1000000))::INT AS hour FROM h)
"""
