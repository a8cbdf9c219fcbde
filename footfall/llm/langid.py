"""Language identification of texts that may mix languages.

A language is a distribution over hashed letter trigrams, counted over every learning text. A text's trigrams
are taken as drawn from a mixture of languages; expectation-maximisation estimates the shares. The set of
languages is the one of highest penalised likelihood among the best language alone and the two, three, ...
languages of the largest shares.

Defined results: a null text and one without a letter are `und` with score 0, as is every text where no language
was learned; letters are lower-cased, all that is neither letter nor mark separates words; of equal languages the
first by name is taken; rows with a null language are predicted and not learned from; repeated rows count each
time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import small_batches

BITS = 16
BUCKETS = 1 << BITS
ROUNDS = 8
_PIECE = 1 << 19  # characters handled at once


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: letter or mark; letter."""
    major = "".join(unicodedata.category(chr(i))[0] for i in range(0x110000))
    kinds = np.frombuffer(major.encode(), np.uint8)
    letter = kinds == ord("L")
    return letter | (kinds == ord("M")), letter


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every trigram, and by text whether it has a letter. Texts bring their own margins."""
    inner, letter = _letters()
    code = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in code])
    chars = np.concatenate(code)
    has = np.bincount(owner[letter[chars]], minlength=len(texts)) > 0
    kept = inner[chars]
    chars = np.where(kept, chars, 32)
    solid = kept.copy()
    solid[1:] |= kept[:-1] | (owner[1:] != owner[:-1])
    solid[0] = True
    chars, owner = chars[solid].astype(np.uint64), owner[solid]
    whole = (owner[2:] == owner[:-2]) & (chars[1:-1] != 32)
    with np.errstate(over="ignore"):
        h = (chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1]) * np.uint64(0x85EBCA77C2B2AE63) + chars[2:]
        h *= np.uint64(0x9FB21C651E98DF25)
    return owner[2:][whole], (h >> np.uint64(64 - BITS)).astype(np.int64)[whole], has


def grouped(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of texts of about _PIECE characters in all, with a space at both ends of each text.

    A longer text comes in pieces that share two characters, so that its trigrams are those of the whole.
    """
    rows, own, size = [], [], 0
    for i, t in enumerate(texts):
        t = f" {(t or '').lower()} "
        for at in range(0, max(len(t), 1), _PIECE):
            rows.append(i)
            own.append(t[max(0, at - 2) : at + _PIECE])
            size += len(own[-1])
            if size >= _PIECE:
                yield rows, own
                rows, own, size = [], [], 0
    if rows:
        yield rows, own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for rows, own in grouped(batch.column(0).to_pylist()):
            owner, bucket, _ = _trigrams(own)
            of = langs[np.array(rows)]
            for lang in dict.fromkeys(of):
                held = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(bucket[(of == lang)[owner]], minlength=BUCKETS)
    for lang, held in totals.items():
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(held[own])], names=["lang", "bucket", "n"]
        )


class Model:
    """Languages by name, and by bucket and language the likelihood, smoothed by half a count."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts.T.astype(float) + 0.5
        self.likelihood = smooth / smooth.sum(axis=0)


def train(docs: DataFrame) -> Model:
    """Counts over all rows of (text, lang) with a language; each task adds up its own rows first.

    The model has one number for each language and each of 65,536 buckets.
    """
    small_batches(docs.sparkSession)
    counted = docs.where("lang is not null").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    return Model(names, counts)


def _climb(p: np.ndarray, n: np.ndarray, owner: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after so many rounds of expectation-maximisation, and each text's log-likelihood under them."""
    total = np.add.reduceat(n, starts)
    for _ in range(rounds):
        part = p * share[owner]
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    fit = np.log(np.maximum((p * share[owner]).sum(axis=1), 1e-300))
    return share, np.add.reduceat(n * fit, starts)


def mixtures(owner: np.ndarray, bucket: np.ndarray, model: Model, texts: int, penalty: float = 4.0) -> np.ndarray:
    """Language shares by text (a row of zeros: no trigram)."""
    out = np.zeros((texts, len(model.names)))
    if not len(owner) or not model.names:
        return out
    key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    who, n = key // BUCKETS, n.astype(float)
    p = model.likelihood[key % BUCKETS]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rows, own = who[starts], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(who)]))
    alone = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.eye(len(model.names))[best]
    value = alone.max(axis=1)
    if len(model.names) > 1:
        share, _ = _climb(p, n, own, starts, np.full(alone.shape, 1 / len(model.names)), ROUNDS)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        price = penalty * np.log(np.maximum(np.add.reduceat(n, starts), 2))
        open_ = np.sort(share, axis=1)[:, -2] > 0.02
        for k in range(2, len(model.names) + 1):
            if not open_.any():
                break
            part = open_[own]
            kept = np.cumsum(open_) - 1
            first = np.flatnonzero(np.r_[True, np.diff(own[part]) != 0])
            cut = np.where(rank[open_] < k, share[open_], 0)
            cut /= np.maximum(cut.sum(axis=1, keepdims=True), 1e-300)
            tried, fit = _climb(p[part], n[part], kept[own[part]], first, cut, ROUNDS // 2)
            at = np.flatnonzero(open_)
            gain = fit - price[at] * (k - 1) > value[at]
            chosen[at[gain]] = tried[gain]
            value[at[gain]] = (fit - price[at] * (k - 1))[gain]
            open_[at[~gain]] = False
    out[rows] = chosen
    return out


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.names, "und"], object)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        top, score = np.full(len(texts), len(model.names)), np.zeros(len(texts))
        long = [i for i, t in enumerate(texts) if t is not None and len(t) > _PIECE // 4]  # lower case may be longer
        rest = [i for i, t in enumerate(texts) if t is not None and len(t) <= _PIECE // 4]
        runs = [(np.array(rest)[rows], [own]) for rows, own in ((np.array(r), o) for r, o in grouped([texts[i] for i in rest]))]
        runs += [(np.array([i]), [[x] for _, own in grouped([texts[i]]) for x in own]) for i in long]
        for rows, pieces in runs:
            found = [_trigrams(x) for x in pieces]
            share = mixtures(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), model, len(rows))
            has = np.logical_or.reduce([f[2] for f in found])
            sure = has & (share.sum(axis=1) > 0)
            if sure.any():
                top[rows[sure]], score[rows[sure]] = share[sure].argmax(axis=1), share[sure].max(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[top].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), *batch.columns[1:]],
            names=["lang_pred", "score", *batch.schema.names[1:]],
        )


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """lang_pred and score of every row's whole text, with the columns in `keep`."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict(shared.value, batches)

    rows = docs.select("text", *keep)
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"lang_pred string, score double, {kept}")
