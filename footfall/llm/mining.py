"""Hard negatives by the threshold algorithm over sorted lists of components.

The table is cut into shards: a label with many rows has shards of its own, labels with few share one. A shard's index
holds its vectors and, for each dimension, its rows in the order of that component; it is built once and written. An
anchor reads the lists of a shard from the end that its component's sign makes the greater products, all lists in
step; rows met anywhere are scored at once from their vectors. What the lists' present places add up to is the most
that a row not met yet can score, so reading stops once that threshold lies strictly below the k-th score found in
each of the anchor's windows, or below the window where it holds fewer.

First an anchor meets the shards of its own label for its positives, then all shards for its windows. Anchors travel in
blocks, each packed once and sent once to a shard, so a task holds a shard and a block, whatever the table's size.

Defined results: rows with a null id or label, a null vector or a component that is null or not finite take no part;
rows that share an id are rows of their own; vectors meet only those of the same length; a row's own row is no
positive of it; ties go to the smaller id; an empty table gives no rows; scores are exact, those beyond a long fail.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import shuffle_width, small_batches, stored
from footfall.llm.simhash import few

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these shares of the positive's: (numerator, numerator, denominator).
SHARE = (50, 95, 100)
FIRST = 16  # places that are read from each list at first


def clean(vectors: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, dim, vector array<double>) of the rows that take part; components are whole numbers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    own = F.col("label") if label is None else label
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    whole = F.transform(x, lambda c: F.rint((c * scale) - F.pmod(c * scale, F.lit(1.0))))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), own.cast("string").alias("label"), F.size("embedding").alias("dim"), whole.alias("vector"))


class Lists:
    """The rows of a shard by (vec_id, row), and by dimension their places in the order of that component."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        most = x.shape[1] * float(abs(x).max() if x.size else 0) ** 2
        # with numbers as great as these, sums of products are exact in single or double precision
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        self.row, self.ids, self.labels = row, ids, labels
        self.x = x.astype(kind) if kind is not object else np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.uint16 if len(x) <= 1 << 16 else np.int64))
        self.value = np.ascontiguousarray(np.take_along_axis(x, self.order.T.astype(np.int64), axis=0).T)
        self.scored = 0

    def best(self, query: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each window (low, high) the positions and scores of its k best allowed rows."""
        n, exact = len(self.x), self.x.dtype == object
        kind = np.float64 if self.x.dtype == np.float32 and self.x.shape[1] * abs(query).max(initial=0) * abs(self.value).max(initial=0) >= 2**24 else self.x.dtype
        q = np.array([int(c) for c in query], object) if exact else query.astype(kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen, score = np.zeros(n, bool), np.zeros(n, object if exact else np.float64)
        depth, step, greatest = 0, FIRST, max(high for _, high in windows)
        while True:
            upto = min(n, depth + step)
            met = np.zeros(n, bool)
            if 2 * seen.sum() > n or not len(up) + len(down):
                met[:] = True  # few rows are left, or nothing tells them apart: no list need be read for them
            else:
                met[self.order[up, n - upto : n - depth].ravel()] = True
                met[self.order[down, depth:upto].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            score[new] = self.x[new] @ q
            seen |= met
            self.scored += len(new)
            if seen.all():
                return [self._window(score, allowed, low, high, k) for low, high in windows]
            depth, step = upto, step * 2
            # the most that a row not met can score, rounding included
            threshold = float(query[up] @ self.value[up, n - depth] + query[down] @ self.value[down, depth - 1])
            threshold += 1e-9 * float(abs(query) @ np.maximum(abs(self.value[:, 0]), abs(self.value[:, -1])))
            if threshold >= greatest:
                continue  # no score in a window can lie above it yet
            out = [self._window(score, seen & allowed, low, high, k) for low, high in windows]
            if all(threshold < (low if len(s) < k else s[-1]) for (low, _), (_, s) in zip(windows, out, strict=True)):
                return out

    def _window(self, score: np.ndarray, open_: np.ndarray, low: float, high: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(open_ & (score >= low) & (score <= high))
        if len(at) > 4 * k and score.dtype != object:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = np.array(sorted(at.tolist(), key=lambda i: (-score[i], i))[:k], np.int64) if score.dtype == object else at[np.lexsort((at, -score[at]))[:k]]
        return at, score[at]


def _big(kept: DataFrame, shard_rows: int) -> DataFrame:
    """(label, pieces) of labels that have shards of their own, which an eighth of a shard's rows give them."""
    counts = kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 8 >= shard_rows)
    return stored(counts.select("label", F.ceil(F.col("n") / shard_rows).cast("int").alias("pieces")), "labels")


def _index(kept: DataFrame, big: DataFrame, shard_rows: int, width: int) -> tuple[DataFrame, int]:
    """(shard, dim, index) of all rows, and the number of shards that labels with few rows share."""
    total = kept.count()
    shared = max(1, -(-total // shard_rows))
    placed = kept.join(few(big), "label", "left")
    piece = F.pmod(F.xxhash64("row", F.lit(2)), F.col("pieces").cast("long"))
    placed = placed.withColumn("shard", F.when(F.col("pieces").isNull(), _shared(shared)).otherwise(_own(piece))).drop("pieces")

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        own = Lists(pdf["row"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(object), np.stack(pdf["vector"].to_list()))
        return pdf.iloc[:1][["shard", "dim"]].assign(index=pickle.dumps(own, protocol=5))

    return stored(placed.repartition(width, "shard", "dim").groupBy("shard", "dim").applyInPandas(built, "shard long, dim int, index binary"), "lists"), shared


def _shared(shards: int) -> Column:
    return F.pmod(F.xxhash64("label"), F.lit(shards).cast("long"))


def _own(piece: Column) -> Column:
    return -1 - F.abs(F.shiftright(F.xxhash64("label", piece.cast("long")), 1))  # shards that meet by chance are one


def _blocks(anchors: DataFrame, block_rows: int, width: int) -> DataFrame:
    """(block, dim, payload): anchors with all their columns, up to about block_rows together."""
    number = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(max(1, -(-anchors.count() // block_rows))).cast("long"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][["block", "dim"]].assign(payload=pickle.dumps(pdf.drop(columns=["block", "dim"]), protocol=5))

    dealt = anchors.withColumn("block", number).repartition(width, "block", "dim")
    return stored(dealt.groupBy("block", "dim").applyInPandas(packed, "block long, dim int, payload binary"), "blocks")


def _met(blocks: DataFrame, index: DataFrame, run: Callable[[Lists, pd.DataFrame], pd.DataFrame], schema: str, width: int) -> DataFrame:
    """What `run` finds for every block (block, dim, shard, payload) in its shard."""

    def each(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for payload, held in zip(pdf["payload"], pdf["index"], strict=True):
                yield run(pickle.loads(held), pickle.loads(payload))  # noqa: S301  what this module wrote

    pairs = blocks.hint("merge").join(index, ["shard", "dim"]).repartition(width, "shard", "block")
    return pairs.select("payload", "index").mapInPandas(each, schema)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int, int] = SHARE,
    shard_rows: int = 4096, block_rows: int = 512,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that `clean` gives."""
    spark, width = rows.sparkSession, shuffle_width(rows.sparkSession)
    small_batches(spark, 1000)
    kept = stored(rows.withColumn("asks", F.coalesce(is_anchor, F.lit(False))), "vectors")
    big = _big(kept, shard_rows)
    index, shared = _index(kept, big, shard_rows, width)
    anchors = kept.where("asks").drop("asks")

    def same(held: Lists, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in own.itertuples():
            allowed = (held.labels == a.label) & (held.row != a.row)
            at, score = held.best(np.asarray(a.vector, float), allowed, [(-np.inf, np.inf)], positives)[0]
            out += [(a.row, int(held.ids[i]), int(held.row[i]), int(s)) for i, s in zip(at, score, strict=True)]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive", "positive_score"])

    home = anchors.join(few(big), "label", "left")
    pieces = F.when(F.col("pieces").isNull(), F.array(_shared(shared))).otherwise(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: _own(i)))
    at_home = home.withColumn("shard", F.explode(pieces)).drop("pieces")
    counted = at_home.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))
    dealt = at_home.join(counted, "shard").withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), F.col("blocks"))).drop("blocks")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][["shard", "block", "dim"]].assign(payload=pickle.dumps(pdf.drop(columns=["shard", "block", "dim"]), protocol=5))

    visits = dealt.repartition(width, "shard", "block", "dim").groupBy("shard", "block", "dim").applyInPandas(packed, "shard long, block long, dim int, payload binary")
    found = _met(visits, index, same, "row long, positive_id long, positive long, positive_score long", width)
    order = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id", "positive")
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))  # `positives` of each
    known = stored(anchors.join(lists, "row").select("row", F.col("vec_id").alias("anchor_id"), "label", "dim", "vector", F.col("found.place").alias("place"), F.col("found.positive_id").alias("positive_id"), F.col("found.positive_score").alias("positive_score")), "anchors")

    low, high, of = share

    def others(held: Lists, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in own.itertuples():
            scores = [int(p) for p in a.positive_score]
            windows = [(-(-low * p // of), high * p // of) for p in scores]
            best = held.best(np.asarray(a.vector, float), held.labels != a.label, windows, negatives)
            for place, p, n, (at, score) in zip(a.place, a.positive_id, scores, best, strict=True):
                out += [(a.row, int(place), a.anchor_id, int(p), n, int(held.ids[i]), int(held.row[i]), int(s)) for i, s in zip(at, score, strict=True)]
        return pd.DataFrame(out, columns=["row", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative", "negative_score"])

    blocks = _blocks(known, block_rows, width)
    every = blocks.join(F.broadcast(index.select("shard", "dim").groupBy("dim").agg(F.collect_list("shard").alias("shards"))), "dim")  # a number for each few thousand rows
    sent = every.select("block", "dim", "payload", F.explode("shards").alias("shard"))
    met = _met(sent, index, others, "row long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative long, negative_score long", width)
    best = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id", "negative")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Every pair's exact score, straight from the definition.
ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same, coalesce(list_inner_product(a.x, b.x), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.x) = len(b.x)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= {POSITIVES}),
n AS (SELECT p.rid, p.place, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND {SHARE[0]} * p.score <= {SHARE[2]} * s.score AND {SHARE[2]} * s.score <= {SHARE[1]} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
