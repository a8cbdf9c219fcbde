"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its hashed words, pairs of words, word shapes (runs of character kinds) and pairs of
shapes with a mark where a word repeats the one before. Each of the four groups weighs the same in every text:
a feature's value is its share of its group. A score is the sparse dot product of those values with the weights.

Training reads at most about `sample` labelled rows, a documented bound. Each learner passes over its share of
them with FTRL-Proximal updates; the learners' weights are averaged, which keeps a lost executor's damage to one
learner and needs no shared state. Everything else covers every row.

Defined results: a null text is empty; an empty text scores the bias alone; labels that are null or belong to no
document are ignored; several labels of one id count by their mean; repeated rows are scored each; without any
label all scores are 0.5; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import small_batches
from footfall.llm.hashing import mixed, runs, words_and_shapes

BITS = 18
BIAS = 1 << BITS
GROUPS = 4
SCALE = 4.0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value, a row for each occurrence; values of a group sum to SCALE."""
    owner, words, shapes = words_and_shapes([(x or "").encode("utf-8", "surrogatepass") for x in texts])
    if not len(owner):
        return owner, owner, np.zeros(0)
    same = owner[1:] == owner[:-1]
    with np.errstate(over="ignore"):
        pairs = mixed(words[:-1], 5) + words[1:]
        turns = mixed(shapes[:-1], 6) + shapes[1:] + (words[1:] == words[:-1]).astype(np.uint64)
    owners, numbers, values = [], [], []
    for salt, who, what in ((1, owner, words), (2, owner[1:][same], pairs[same]), (3, owner, shapes), (4, owner[1:][same], turns[same])):
        share = SCALE / np.maximum(np.bincount(who, minlength=len(texts)), 1)
        owners.append(who)
        numbers.append((mixed(what, salt) >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(share[who])
    return np.concatenate(owners), np.concatenate(numbers), np.concatenate(values)


class Learner:
    """FTRL-Proximal with per-coordinate rates; the last weight is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient**2


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        at, values = [], []
        for run in runs(len(t or "") for t in texts):
            own = texts[run]
            owner, number, value = features(own)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(own) + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found, inverse = np.unique(number[order[a:b]], return_inverse=True)
                at.append(np.append(found, BIAS).astype("<i4").tobytes())
                values.append(np.append(np.bincount(inverse, value[order[a:b]], len(found)), 1.0).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(at, pa.binary()), pa.array(values, pa.binary()), *batch.columns[2:]],
            names=["doc_id", "at", "value", "label", "learner"],
        )


def _fit(passes: int) -> Callable:
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label", "value"], kind="stable").sample(frac=1, random_state=7)
        data = [
            (np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(float), y)
            for a, v, y in zip(rows["at"], rows["value"], rows["label"], strict=True)
        ]
        learner = Learner()
        for _ in range(passes):
            for example in data:
                learner.learn(*example)
        w = learner.weights()
        own = np.flatnonzero(w)
        return pd.DataFrame({"number": own, "weight": w[own]})

    return fit


def train(docs: DataFrame, labels: DataFrame, sample: int = 16_000, learners: int = 4, passes: int = 3) -> np.ndarray:
    """Weights from labelled texts: docs (doc_id, text) and labels (doc_id, quality).

    Which rows a larger set of labels is cut down to depends on a hash of their ids alone. What comes to the
    driver is one weight for each of 2**18 + 1 features at most, whatever the input's size.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
    )
    total = known.count()
    span = 1 << 30
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(span)) < int(span * min(1.0, sample / max(total, 1))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("learner", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(learners)).cast("int"))
    sparse = rows.select("doc_id", "text", "label", "learner").mapInArrow(
        _sparse, "doc_id long, at binary, value binary, label double, learner int"
    )
    fitted = sparse.groupBy("learner").applyInPandas(_fit(passes), "number int, weight double")
    table = fitted.groupBy("number").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros(BIAS + 1)
    weights[table["number"].to_numpy(int)] = table["weight"].to_numpy() / learners
    return weights


def score_texts(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    owner, number, value = features(texts)
    dots = np.bincount(owner, weights[number] * value, len(texts)) + weights[BIAS]
    return 1 / (1 + np.exp(-np.clip(dots, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The columns of `docs` and a last one, quality_score, from column text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = texts.tolist()
        parts = [score_texts(own[run], shared.value) for run in runs(len(t or "") for t in own)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.select("*", scored(F.col("text")).alias("quality_score"))


def good(score_column: Column, threshold: float = 0.5) -> Column:
    return score_column >= threshold
