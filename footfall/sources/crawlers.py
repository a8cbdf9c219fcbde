"""Crawlers by a table of names: agents are cut into words once and joined with the table by equality.

The table (phrase, name) is a parameter and may hold thousands of crawlers. A phrase matches an agent that has its words
one after the other; words are runs of letters a-z and digits, in any case. Of several phrases that match, the longest
names the crawler, then the first by alphabet. Agents that the table does not know are left to the general rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import traffic
from footfall.functions.values import once

#: A table of up to so many phrases is broadcast, a larger one is shuffled.
BROADCAST = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """A table from lines `phrase<tab>name`; a line without a name is its own, empty lines and `#` lines are none."""
    said = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    return lines.select(said[0].alias("phrase"), F.coalesce(F.get(said, F.lit(1)), said[0]).alias("name"))


def _runs(own: Column, n: int) -> Column:
    """All runs of n words."""
    starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(own, i, F.lit(n)), " "))


def _phrases(own: Column, sizes: list[int]) -> Column:
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *(_runs(own, n) for n in sizes)))


def named(agents: DataFrame, table: DataFrame) -> DataFrame:
    """(user_agent, name) of the distinct agents that the table knows; null and empty phrases know none."""
    cut = table.select(words(F.col("phrase")).alias("_w"), "name").where("size(_w) > 0")
    known = cut.groupBy(F.array_join("_w", " ").alias("_phrase"), F.size("_w").alias("_n")).agg(F.min("name").alias("name"))
    sizes = sorted(r[0] for r in known.select("_n").distinct().collect())  # lengths of phrases in words
    small = known.limit(BROADCAST + 1).count() <= BROADCAST
    asked = agents.select("user_agent").where("user_agent is not null").distinct()
    runs = asked.select("user_agent", F.explode(once(words(F.col("user_agent")), lambda own: _phrases(own, sizes))).alias("_phrase"))
    met = runs.join(F.broadcast(known) if small else known, "_phrase")
    order = F.struct((-F.length("_phrase")).alias("length"), F.col("_phrase").alias("phrase"))
    return met.groupBy("user_agent").agg(F.min_by("name", order).alias("name"))


def identify(hits: DataFrame, table: DataFrame, threshold: int = 30, score: Column | None = None) -> DataFrame:
    """The hits with `crawler`: the table's name for their agent, else the general rule's, null for people.

    A column `crawler` that the hits have is replaced. Each distinct agent is looked up once.
    """
    own = [c for c in hits.columns if c != "crawler"]
    found = named(hits, table).withColumnRenamed("name", "_name")
    agent = F.col("user_agent")
    rule = F.when(traffic.is_bot(agent, score=score, threshold=threshold), traffic.crawler_name(agent, score, threshold))
    return hits.select(*own).join(found, "user_agent", "left").select(*own, F.coalesce("_name", rule).alias("crawler"))
