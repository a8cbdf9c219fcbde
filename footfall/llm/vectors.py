"""What the vector searches share: clean vectors, shards with an index each, two rounds of visits, the final ranking.

The table is cut into cells around pivots, which are a bounded sample of its rows; a cell with too many rows is cut
into pieces. Each piece is a shard: its index is built once and stored as bytes in the shared folder. A query first
visits one shard of its own cell. What it finds there bounds how far its k best can be, and by the triangle
inequality it then visits those cells only whose distance less their radius is within that bound, so no cell with a
better vector is left out. Queries meet a shard's index in blocks, so tasks stay as large as `shard_rows` and
`block_rows` say, whatever the table's size, and a lost executor costs only its tasks.

One more component brings all vectors to the same norm, which makes the largest inner product the least distance.

Defined results: rows with a null id or vector, or a component that is null or not finite, take no part; rows that
share an id are rows of their own, as candidates and as queries, and only a query's own row is no candidate of it;
vectors meet only those of the same length, empty ones included; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import shuffle_width, small_batches, stored

#: The most pivots, which every task holds; with more rows, cells are cut into more pieces.
PIVOTS = 1024
SLACK = 1e-6


class Index(Protocol):
    def find(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, row positions and scores of each query's k best in this shard, or so many of them as
        the method promises; rows whose number is in `own` are left out, and so may be scores below `least`."""


#: row numbers, ids, vectors -> the index over them
Build = Callable[[np.ndarray, np.ndarray, np.ndarray], Index]


def clean(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, vector array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))


def _square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)


class Cells:
    """Pivots and radii of one vector length; distances in the space where all vectors have the norm `most`."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most
        self.last = np.sqrt(np.maximum(most - (pivots**2).sum(axis=1), 0))
        self.radius = np.full(len(pivots), np.inf)
        self.pieces = np.zeros(len(pivots), np.int64)

    def away(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Distance of vectors, or of queries, to every pivot."""
        size = (vectors**2).sum(axis=1)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.most - size, 0))
        square = (size if query else np.full(len(vectors), self.most))[:, None] + self.most - 2 * (vectors @ self.pivots.T + last[:, None] * self.last)
        return np.sqrt(np.maximum(square, 0))

    def wanted(self, vectors: np.ndarray, least: np.ndarray) -> np.ndarray:
        """By query and cell: whether the cell may hold a score of at least `least`."""
        size = (vectors**2).sum(axis=1) + self.most
        limit = np.sqrt(np.maximum(size - 2 * least, 0))
        return self.away(vectors, True) - self.radius <= (limit + SLACK * (1 + np.sqrt(size)))[:, None]


def _split(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
    """Row positions by vector length."""
    length = pdf["vector"].map(len).to_numpy()
    return {int(n): np.flatnonzero(length == n) for n in np.unique(length)}


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def _cells(kept: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """By vector length its cells. The pivots are the rows of the least hashes, at most PIVOTS of each length."""
    by_length = Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row")
    sizes = {r["dim"]: (r["n"], r["most"]) for r in kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(_square(F.col("vector"))).alias("most")).collect()}
    few = kept.select("dim", "row", "vector").withColumn("_n", F.row_number().over(by_length)).where(F.col("_n") <= PIVOTS).toPandas()
    out = {}
    for dim, at in _split(few).items():
        n, most = sizes[dim]
        number = min(PIVOTS, max(1, n // shard_rows))
        pivots = np.unique(_stack(few["vector"].iloc[at].iloc[:number]), axis=0)
        out[dim] = Cells(pivots, most)
    return out


def top_k(rows: DataFrame, is_query: Column, build: Build, k: int, score_type: str, shard_rows: int = 4096, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows but its own for each query, ties to smaller ids."""
    spark, width = rows.sparkSession, shuffle_width(rows.sparkSession)
    small_batches(spark, 2000)
    kept = stored(rows.select("row", "vec_id", "vector", F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    cells = _cells(kept, shard_rows)
    shared = spark.sparkContext.broadcast(cells)

    def placed(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            cell, gap = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim, at in _split(pdf).items():
                away = shared.value[dim].away(_stack(pdf["vector"].iloc[at]))
                cell[at] = away.argmin(axis=1)
                gap[at] = away.min(axis=1)
            yield pdf.assign(cell=cell, gap=gap)

    assigned = stored(kept.mapInPandas(placed, "row long, vec_id long, vector array<double>, dim int, asks boolean, cell int, gap double"), "assigned")
    for r in assigned.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect():  # PIVOTS of each length at most
        cells[r["dim"]].radius[r["cell"]] = r["radius"]
        cells[r["dim"]].pieces[r["cell"]] = -(-r["n"] // shard_rows)
    shared = spark.sparkContext.broadcast(cells)
    counts = spark.createDataFrame([(d, c, int(p)) for d, own in cells.items() for c, p in enumerate(own.pieces)], "dim int, cell int, pieces int")
    piece = F.pmod(F.xxhash64("row", F.lit(2)), F.col("pieces").cast("long")).cast("int")
    sharded = assigned.join(F.broadcast(counts), ["dim", "cell"]).withColumn("piece", piece)

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        own = build(pdf["row"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), _stack(pdf["vector"]))
        return pdf.iloc[:1][["dim", "cell", "piece"]].assign(index=pickle.dumps(own, protocol=5))

    keys = ("dim", "cell", "piece")
    index = stored(sharded.select(*keys, "row", "vec_id", "vector").repartition(width, *keys).groupBy(*keys).applyInPandas(built, "dim int, cell int, piece int, index binary"), "index")
    asked = sharded.where("asks").select(*keys, "row", F.col("vec_id").alias("query_id"), "vector", F.lit(float("-inf")).alias("least"))
    first = stored(_visited(asked, index, k, score_type, block_rows, width), "found")

    sofar = first.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("last"))
    known = asked.join(sofar, "row", "left").withColumn("least", F.when(F.col("n") >= k, F.col("last")).otherwise(float("-inf"))).drop("n", "last")

    def onward(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            to: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pdf)
            for dim, at in _split(pdf).items():
                wanted = shared.value[dim].wanted(_stack(pdf["vector"].iloc[at]), pdf["least"].to_numpy(float)[at])
                for i, own in zip(at, wanted, strict=True):
                    to[i] = np.flatnonzero(own).astype(np.int32)
            yield pdf.assign(to=to)

    routed = known.select("dim", "cell", "piece", "row", "query_id", "vector", "least").mapInPandas(
        onward, "dim int, cell int, piece int, row long, query_id long, vector array<double>, least double, to array<int>"
    )
    every = routed.withColumn("to", F.explode("to")).join(F.broadcast(counts.withColumnRenamed("cell", "to")), ["dim", "to"])
    every = every.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    more = every.where("to <> cell or at <> piece").select("dim", F.col("to").alias("cell"), F.col("at").alias("piece"), "row", "query_id", "vector", "least")
    found = first.union(_visited(stored(more, "visits"), index, k, score_type, block_rows, width))
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _visited(visits: DataFrame, index: DataFrame, k: int, score_type: str, block_rows: int, width: int) -> DataFrame:
    """(row, query_id, vec_id, score) of every visit: (dim, cell, piece, row, query_id, vector, least)."""
    keys = ["dim", "cell", "piece"]
    blocks = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = visits.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    copies = index.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    number = np.int64 if score_type == "long" else np.float64

    def run(own: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(shard):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": int, "query_id": int, "vec_id": int, "score": number})
        held = pickle.loads(shard["index"].iloc[0])  # noqa: S301  what `built` wrote
        numbers = own["row"].to_numpy(np.int64)
        q, r, score = held.find(_stack(own["vector"]), numbers, k, own["least"].to_numpy(float))
        return pd.DataFrame({"row": numbers[q], "query_id": own["query_id"].to_numpy(np.int64)[q], "vec_id": held.ids[r], "score": score.astype(number)})

    by = [*keys, "block"]
    left, right = dealt.repartition(width, *by), copies.repartition(width, *by)  # a given number, as few bytes here mean much work
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, f"row long, query_id long, vec_id long, score {score_type}")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
