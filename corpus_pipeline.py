"""From raw documents to token ids: five stages, each over everything the one before kept.

1. quality: score every text with the hashed word n-gram classifier and drop what it rejects.
2. near_duplicates: link texts whose five-word shingles have a Jaccard similarity of 0.8 or more; of each group the
   row with the smallest id stays.
3. personal_data: replace personal data by its kind in brackets.
4. source_mix: what the mix over the sources takes of each document, up to twice.
5. pieces: SentencePiece ids of every text.

All stages but the last return the columns of `documents`. Each is written as Parquet and read again, so a lost
executor never restarts an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import mixing, near, pii, quality, sentencepiece, simhash
from footfall.llm.common import only_result, stored, table
from footfall.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches one half. The classifier is fitted to labelled rows of `documents`.

    A null text is scored as an empty one; equal texts have equal scores, so rows that repeat stay or go together; a
    score of exactly one half stays; an empty table gives none; other columns pass, whatever their names.
    """
    weights = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(F.struct("*").alias("doc"), "text"), weights)
    return scored.where(quality.good(F.col("quality_score"))).select("doc.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, then the first by text; a null id is the greatest.

    Rows go by their number, so neither a null id nor one that rows share makes them one. Groups are reduced to their
    best row before anything is joined, so that no large group is ever in one place.
    """
    rows = near.numbered(docs)
    found = stored(near.near_copies(rows), "near")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    kept = found.groupBy("root").agg(F.min(order).alias("best")).select("best.row")
    gone = stored(found.select("row").join(kept, "row", "left_anti"), "gone")
    return rows.join(simhash.few(gone), "row", "left_anti").select("doc.*")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, each span of personal data replaced by its kind in brackets.

    A null text stays null, a text without spans stays as it is, rows that repeat are treated alike, overlapping
    spans become one; n_chars, where there, is the new text's length; an empty table gives none; other columns pass,
    whatever their names.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words, with the words that it takes, a pass after the other.

    Null and empty texts have no words, so their rows go; a null source is a source of its own; rows that repeat are
    documents of their own; ties of position are broken by id, size and row; an empty table gives none; other columns
    pass, whatever their names.
    """
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every row: null and empty texts have no ids, rows that repeat are encoded each, a null id is
    kept, an empty table gives none, other columns are left out.
    """
    return sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", hide_personal_data),
    ("source_mix", mix_sources),
    ("pieces", to_pieces),
]

#: The stages learn models from the rows, which SQL cannot; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage wrote for itself goes when the next has read its result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with only_result() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name))
    return docs
