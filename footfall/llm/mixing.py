"""Mixing sources to target weights, over fixed-length blocks of words. DataFrame functions only.

Each source's words form one stream: its documents in the order of bucket, id and size. The stream is cut into
blocks of `block` words; only a source's last block may be short. A source's words in the mix are whole passes
over its blocks and a part of one more pass. Every slot of the mix (source, pass, number) is drawn to an output
shard by itself, so a source's counts over the shards are one multinomial draw; within a pass, the slot's number
goes through a pseudorandom permutation of the source's full blocks (swap-or-not rounds, a bijection for every
length). The short block comes last, and the last slot of a part is cut to the word. Slots and documents meet by
block index.

Positions come from three levels (document in its bucket, bucket in its source, source), so no source, however
large, is ever ordered in one task.

Defined results: a null text has size 0 and nothing is taken from it; a null source is a source of its own and
comes last; sources of size 0 have target 0; an empty mix has targets 0; rows that repeat are documents of their
own; rows with a null doc_id are
spread over the buckets by their number; other columns are kept out; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import WORD_PATTERN, shuffle_width, stored

WEIGHTS = (5, 2, 1)
BLOCK = 128
SHARE = 1.5
MOST = 2
ROUNDS = 16
PRIME = 2_147_483_647
CHUNK = 4096
SHARD_WORDS = 1 << 20
BUCKET_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def numbered(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, src, size, row) of every row, and all its columns as struct `doc` if asked for.

    Written once, so that all later steps read the same row numbers.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"), word_count(F.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("row"), *([F.struct("*").alias("doc")] if keep else []),
    )
    return stored(rows, "numbered")


def source_targets(rows: DataFrame) -> DataFrame:
    """(src, source_size, target) for each source; this table has one row for each source, as its windows have.

    Targets rise with the weights up to a common level; a source stops at MOST times its size. Ordered by the
    level at which they stop, the first source that stays below its own stop fixes the level.
    """
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy((F.col("src") == "n").asc(), F.col("src").asc())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    stops = sizes.select("src", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("stop"))
    everything = Window.partitionBy()
    up = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("src").asc())
    steps = stops.select(
        "*",
        F.row_number().over(up).alias("k"),
        (
            (F.sum("source_size").over(everything) * SHARE - (F.sum("stop").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("stop")))
            / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.struct("k", "level"))
    level = F.coalesce(F.min(fits).over(everything)["level"], F.lit(0.0))
    return steps.select("src", "source_size", F.least(F.col("stop").cast("double"), level * F.col("weight")).alias("target"))


def placed(rows: DataFrame, buckets: int) -> DataFrame:
    """Each row with `start`, the words of its source before it."""
    mixed = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.col("row")), F.lit(PRIME)) * 48271 % PRIME % buckets
    dealt = rows.select("*", mixed.alias("bucket"))
    totals = dealt.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bases, ["src", "bucket"])
        .withColumn("start", F.col("base") + F.col("within"))
        .drop("bucket", "base", "within")
    )


def _drawn(salt: str, digits: int) -> Column:
    """A number of so many hexadecimal digits, fixed by source, pass and round."""
    key = F.concat_ws(":", F.col("src"), F.col("pass").cast("string"), F.col("r").cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def _permuted(number: Column, length: Column, rounds: Column) -> Column:
    """Swap-or-not: each round pairs x with k - x and a keyed bit of the pair says whether they swap."""

    def swap(x: Column, r: Column) -> Column:
        other = (r["k"] + length - x) % length
        high = F.greatest(x, other)
        h = (r["a"] * (high % PRIME) + r["b"] * F.floor(high / PRIME).cast("long") + r["c"]) % PRIME
        return F.when(F.shiftright(h, 10).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(rounds, number, swap)


def slots(targets: DataFrame, block: int = BLOCK, shards: int = 1) -> DataFrame:
    """(src, pass, number, block, take, shard): every slot of the mix and the words it takes from its block."""
    size, words = F.col("source_size"), F.round("target").cast("long")
    full = F.floor(size / block).cast("long")
    passes = (
        targets.where((size > 0) & (words > 0))
        .select("src", size.alias("size"), full.alias("full"), words.alias("words"), F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass"))
        .withColumn("words", F.least(F.col("size"), F.col("words") - F.col("pass") * F.col("size")))
        .where("words > 0")
        .withColumn("slots", F.ceil(F.col("words") / block).cast("long"))
    )
    keyed = (
        passes.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("r"))
        .select(
            "src", "pass", "full", "words", "slots",
            F.struct(
                F.col("r"),
                (_drawn("k", 15) % F.greatest(F.col("full"), F.lit(1))).alias("k"),
                (_drawn("a", 7) + 1).alias("a"), (_drawn("b", 7) + 1).alias("b"), _drawn("c", 7).alias("c"),
            ).alias("round"),
        )
        .groupBy("src", "pass", "full", "words", "slots")
        .agg(F.array_sort(F.collect_list("round")).alias("rounds"))  # ROUNDS of them
    )
    chunks = keyed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK).cast("long"))).alias("chunk"))
    dealt = chunks.repartition(shuffle_width(targets.sparkSession), "src", "pass", "chunk")  # a given number, as few rows here make many
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1
    every = dealt.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("number"))
    number = F.col("number")
    made = every.select(
        "src", "pass", "number",
        F.when(number == F.col("full"), number).otherwise(_permuted(number, F.col("full"), F.col("rounds"))).alias("block"),
        F.least(F.lit(block).cast("long"), F.col("words") - number * block).alias("take"),
    )
    return sharded(made, shards)


def sharded(mix_slots: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """Slots with the output shard that each is drawn to, all shards alike likely."""
    return mix_slots.withColumn("shard", F.pmod(F.xxhash64("src", "pass", "number", F.lit(seed)), F.lit(shards).cast("long")))


def shard_counts(mix_slots: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """(shard, src, slots, words): the multinomial counts of each output shard."""
    return sharded(mix_slots, shards, seed).groupBy("shard", "src").agg(F.count(F.lit(1)).alias("slots"), F.sum("take").alias("words"))


def pieces(rows: DataFrame, mix_slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, src, pass, number, block, first, n, shard): the words of each row that the mix takes, first counted from 0."""
    end = F.col("start") + F.col("size")
    spread = rows.where("size > 0").select(
        "row", "src", "start", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long"))).alias("block"),
    )
    # slots are made from a small table, which tells the planner nothing of their number: never broadcast them
    met = spread.join(mix_slots.select("src", "pass", "number", "block", "take", "shard").hint("merge"), ["src", "block"])
    low, at = F.greatest(F.col("start"), F.col("block") * block), F.col("block") * block
    high = F.least(F.col("end"), at + F.col("take"))
    return met.where(high > low).select("row", "src", "pass", "number", "block", (low - F.col("start")).alias("first"), (high - low).alias("n"), "shard")


def _prepared(rows: DataFrame, block: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """The targets of the sources, and the pieces of every output shard, written shard by shard.

    A shard has about `shard_words` words, however large the mix is.
    """
    targets = source_targets(rows)
    words = targets.agg(F.coalesce(F.sum(F.round("target")), F.lit(0.0))).first()[0]
    at = placed(rows, 64 + rows.count() // BUCKET_ROWS)
    recipe = pieces(at, slots(targets, block, max(1, math.ceil(words / shard_words))), block)
    return targets, stored(recipe.repartition("shard"), "shards", by="shard")


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of (doc_id, source, text)."""
    rows = numbered(docs)
    targets, recipe = _prepared(rows, block, shard_words)
    taken = recipe.groupBy("row").agg(F.sum("n").alias("taken"))
    return (
        rows.join(targets, "src")
        .join(taken, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def _with_uses(docs: DataFrame, block: int, shard_words: int) -> DataFrame:
    """(doc, uses, words) of every row that the mix takes something of; a word keeps the white space after it."""
    rows = numbered(docs, keep=True)
    _, recipe = _prepared(rows.drop("doc"), block, shard_words)
    uses = F.array_sort(F.collect_list(F.struct("pass", "block", "first", "n", "number", "shard")))
    words = F.regexp_extract_all("doc.text", F.lit(WORD_PATTERN + r"[\x20\x09-\x0D]*"), F.lit(0))
    return rows.join(recipe.groupBy("row").agg(uses.alias("uses")), "row").withColumn("words", words)


def mixed_shards(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(source, pass, number, doc_id, first, text, shard): the words of every output shard, dealt by shard.

    Each row is what one slot takes of one document, from its word `first` on.
    """
    every = _with_uses(docs, block, shard_words).select(F.col("doc.source").alias("source"), F.col("doc.doc_id").alias("doc_id"), "words", F.explode("uses").alias("u"))
    text = F.array_join(F.slice("words", F.col("u.first").cast("int") + 1, F.col("u.n").cast("int")), "")
    return every.select("source", "u.pass", "u.number", "doc_id", "u.first", text.alias("text"), "u.shard").repartition("shard")


def write_shards(docs: DataFrame, path: str, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> None:
    """The mix as Parquet, a folder for each output shard."""
    mixed_shards(docs, block, shard_words).write.partitionBy("shard").parquet(path)


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents of the mix with the columns of `docs`: text is what the mix takes, n_chars follows it.

    A document is put together from all shards. A pass's words keep their order and the white space after them; two
    passes are a line end apart. Rows of which nothing is taken go.
    """
    rows = _with_uses(docs, block, shard_words)

    def of_pass(k: int) -> Column:
        own = F.filter("uses", lambda u: u["pass"] == k)
        return F.array_join(F.flatten(F.transform(own, lambda u: F.slice(F.col("words"), u["first"].cast("int") + 1, u["n"].cast("int")))), "")

    parts = F.filter(F.array(*(of_pass(k) for k in range(MOST))), lambda x: x != "")
    out = rows.withColumn("text", F.array_join(parts, "\n"))
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns))


#: The same results from DuckDB, over view `documents`.
ORACLE_SQL = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        row_number() OVER () AS rid FROM documents),
n AS (SELECT 64 + count(*) // {BUCKET_ROWS} AS buckets FROM d),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, source_size * {MOST} AS stop,
        [5, 2, 1][((row_number() OVER (ORDER BY src = 'n', src) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, row_number() OVER u AS k,
        (sum(source_size) OVER () * {SHARE}::DOUBLE - (sum(stop) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - stop))::DOUBLE
        / sum(weight) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW u AS (ORDER BY stop / weight, src)),
t AS (SELECT src, source_size, least(stop::DOUBLE, weight * coalesce((SELECT arg_min(level, k) FROM l WHERE level <= stop / weight), 0.0)) AS target FROM l),
b AS (SELECT d.*, ((coalesce(doc_id, rid) % {PRIME} + {PRIME}) % {PRIME}) * 48271 % {PRIME} % buckets AS bucket FROM d, n),
place AS (SELECT *, (sum(size) OVER (PARTITION BY src ORDER BY bucket, doc_id NULLS FIRST, size, rid) - size)::BIGINT AS start FROM b),
q AS (SELECT src, source_size, source_size // {BLOCK} AS f, pass,
        least(source_size, round(target)::BIGINT - pass * source_size) AS words
      FROM t, range({MOST}) p(pass) WHERE source_size > 0),
p AS (SELECT src, pass, f, words, number, number AS x, 0 AS r
      FROM q, LATERAL (SELECT unnest(range((words + {BLOCK - 1}) // {BLOCK})) AS number) WHERE words > 0
      UNION ALL
      SELECT src, pass, f, words, number,
        CASE WHEN number = f THEN number
             WHEN (((('0x' || substr(md5(src || ':' || pass || ':' || r || ':a'), 1, 7))::BIGINT + 1) * (greatest(x, o) % {PRIME})
               + (('0x' || substr(md5(src || ':' || pass || ':' || r || ':b'), 1, 7))::BIGINT + 1) * (greatest(x, o) // {PRIME})
               + ('0x' || substr(md5(src || ':' || pass || ':' || r || ':c'), 1, 7))::BIGINT) % {PRIME} >> 10) & 1 = 1 THEN o ELSE x END,
        r + 1
      FROM (SELECT *, (('0x' || substr(md5(src || ':' || pass || ':' || r || ':k'), 1, 15))::BIGINT % greatest(f, 1) + f - x) % greatest(f, 1) AS o
            FROM p WHERE r < {ROUNDS})),
u AS (SELECT src, x AS block, least({BLOCK}, words - number * {BLOCK}) AS take FROM p WHERE r = {ROUNDS}),
g AS (SELECT rid, sum(greatest(0, least(start + size, block * {BLOCK} + take) - greatest(start, block * {BLOCK})))::BIGINT AS taken
      FROM place JOIN u USING (src) WHERE block BETWEEN start // {BLOCK} AND (start + size - 1) // {BLOCK} GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN t USING (src) LEFT JOIN g USING (rid)
"""
