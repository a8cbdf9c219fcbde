"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import langid, licenses, mining, mixing, mtree, packing, partcodes, pii, qalsh, quality, sentencepiece, simhash, token_store, vectors
from footfall.llm.common import fold, table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_store.index_tokens(segments)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs.withColumn("held_out", held_out), weights).select(
        "doc_id", "held_out", F.col("quality_score").alias("score"), quality.good(F.col("quality_score")).cast("int").alias("predicted")
    )


def op4_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.clean(table(spark, sf_dir, "embeddings")).where(F.exists("vector", lambda c: c != 0))
    return vectors.top_k(rows, F.col("vec_id") % 20 == 0, qalsh.CollisionIndex, 20, "double", shard_rows=8192)


def op5_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.clean(table(spark, sf_dir, "embeddings")).withColumn("vector", mtree.rounded(F.col("vector")))
    return vectors.top_k(rows, F.col("vec_id") % 20 == 0, mtree.build, 20, "long")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.verified(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_file("word_bpe_49k.json")
    return packing.placements(packing.pack(table(spark, sf_dir, "documents"), tokenizer), tokenizer)


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partcodes.report(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine(mining.clean(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


_QUERIES = (
    op1_token_store, op2_license_scan, op3_quality, op4_collision_search, op5_mtree_search,
    op6_source_mix, op7_language_mixture, op8_simhash, op9_sentencepiece, op10_personal_data,
    op11_best_fit_packing, op12_part_codes, op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


#: Exact integer inner products of the rounded vectors, straight from their definition.
MTREE_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, r.vec_id, coalesce(list_inner_product(q.x, r.x), 0)::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.rid <> r.rid AND len(q.x) = len(r.x))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.ORACLE_SQL, "op5_mtree_search": MTREE_SQL, "op6_source_mix": mixing.ORACLE_SQL, "op12_part_codes": partcodes.ORACLE_SQL, "op13_hard_negatives": mining.ORACLE_SQL}
