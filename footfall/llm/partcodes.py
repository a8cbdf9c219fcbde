"""Vector codes of four parts, each the index of its nearest entry in a codebook of 256.

Entries are learned in rounds: every part goes to its nearest entry, then each entry becomes the mean of its parts. A
task takes the vectors of a batch, sorts the different parts of each position and walks the trie that they make: a
node is a prefix of components, and its distances to all entries are those of its parent and one square more, so parts
that begin alike share that work. The walk goes down depth first; below a node with few leaves it takes all nodes of a
level at once. At a leaf the nearest entry is chosen and the part is added to that entry's sums as often as it occurs.
Sums of all tasks are added up by Spark; only codebooks, whose size does not depend on the table, pass the driver.

All arithmetic is exact: 32 or 64 bits where the largest distance allows, else integers of any size.

Defined results: rows whose vector is null or holds a null or a component that is not finite are dropped, and so are
vectors whose length four does not divide; rows without an id are coded, after all others in order; rows that repeat
are coded each; vectors of each length have codebooks of their own, with fewer entries if fewer rows; nearest entries
and the first entries break ties by lower index and by the vector; an empty table gives no rows; other columns are
ignored; a total that exceeds a long fails.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import small_batches, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_LEAVES = 512  # of a subtree that is walked level by level
#: By length of vectors: (part, entry, component).
Codebooks = dict[int, np.ndarray]


def clean(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x array<double>) of the rows that take part; components are whole numbers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite & (F.size("embedding") % PARTS == 0))
    whole = F.transform(x, lambda c: F.rint((c * scale) - F.pmod(c * scale, F.lit(1.0))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("x"))


def first_entries(rows: DataFrame) -> Codebooks:
    """The vectors of the smallest ids of each length; Spark keeps no more than ENTRIES of each task's rows for it."""
    order = Window.partitionBy(F.size("x")).orderBy(F.col("vec_id").asc_nulls_last(), "x")
    few = rows.select("vec_id", "x", F.row_number().over(order).alias("n")).where(F.col("n") <= ENTRIES).orderBy("n").select("x").collect()
    out: dict[int, list[list[int]]] = {}
    for r in few:
        out.setdefault(len(r["x"]), []).append([int(c) for c in r["x"]])
    return {n: _narrow(np.array(own, object).reshape(len(own), PARTS, n // PARTS).transpose(1, 0, 2)) for n, own in out.items()}


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers where they fit."""
    return x.astype(np.int64) if not x.size or max(map(abs, x.ravel().tolist())) < 2**62 else x


def _exact(parts: np.ndarray, entries: np.ndarray) -> type:
    """The narrowest numbers that hold every distance."""
    if not parts.size or not entries.size:
        return np.int64
    most = parts.shape[1] * (int(abs(parts).max()) + int(abs(entries).max())) ** 2
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows in lexicographic order, where each row's is, and how often each occurs."""
    n, width = parts.shape
    if not width:
        return parts[:1], np.zeros(n, np.int64), np.array([n])
    low = parts.min()
    if parts.dtype != object and int(parts.max()) - int(low) < 2**32:
        keys = np.ascontiguousarray((parts - low).astype(">u4")).view(np.dtype((np.void, 4 * width))).ravel()  # bytes order as numbers do
        _, first, place, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return parts[first], place, count
    order = np.array(sorted(range(n), key=lambda i: tuple(parts[i].tolist())), np.int64)
    new = np.r_[True, (parts[order][1:] != parts[order][:-1]).any(axis=1)]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return parts[order[new]], place, np.bincount(place)


class Trie:
    """Different parts in lexicographic order; `nodes` counts the nodes whose distances a walk computed."""

    def __init__(self, leaves: np.ndarray, entries: np.ndarray):
        kind = _exact(leaves, entries)
        self.leaves, self.entries = leaves.astype(kind), np.ascontiguousarray(entries.astype(kind).T)
        self.parts_from = np.zeros(len(leaves), np.int64)  # where a leaf's prefix ceases to be that of the leaf before
        if len(leaves) > 1 and leaves.shape[1]:
            self.parts_from[1:] = (leaves[1:] != leaves[:-1]).argmax(axis=1)
        self.nearest, self.distance = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64 if kind != object else object)
        self.nodes = 0

    def walk(self) -> Trie:
        self._down(0, len(self.leaves), 0, np.zeros((1, self.entries.shape[1]), self.entries.dtype))
        return self

    def _down(self, low: int, high: int, depth: int, sofar: np.ndarray) -> None:
        """The subtree of leaves low to high, whose first `depth` components are the same and lie `sofar` away."""
        if high - low <= _LEAVES or depth == self.leaves.shape[1]:
            return self._levels(low, high, depth, sofar)
        column = self.leaves[low:high, depth]
        begins = np.r_[np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) + low, high]
        waiting = low
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a > _LEAVES or b - waiting > _LEAVES:
                if waiting < a:
                    self._levels(waiting, a, depth, sofar)
                waiting = a
            if b - a > _LEAVES:
                self.nodes += 1
                self._down(a, b, depth + 1, sofar + (self.leaves[a, depth] - self.entries[depth]) ** 2)
                waiting = b
        if waiting < high:
            self._levels(waiting, high, depth, sofar)

    def _levels(self, low: int, high: int, depth: int, sofar: np.ndarray) -> None:
        """All nodes of a level at once, each from its parent's distances."""
        new, begins = self.parts_from[low:high].copy(), np.zeros(1, np.int64)
        new[0] = -1
        away = np.broadcast_to(sofar, (1, sofar.shape[1]))
        for j in range(depth, self.leaves.shape[1]):
            own = np.flatnonzero(new <= j)
            if len(own) > len(begins):
                away = away[np.searchsorted(begins, own, side="right") - 1]
            step = self.leaves[low + own, j][:, None] - self.entries[j]
            step *= step
            away = away + step if len(away) != len(step) or not away.flags.writeable else np.add(away, step, out=away)
            begins = own
            self.nodes += len(own)
        if len(begins) < high - low:
            away = np.repeat(away, high - low, axis=0)
        best = away.argmin(axis=1) if away.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in away.tolist()])
        self.nearest[low:high] = best
        self.distance[low:high] = away[np.arange(high - low), best]


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length: rows, (row, part, component)."""
    lists = batch.column(column)
    length = lists.value_lengths().to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(length)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        own = flat[(ends[at] - n)[:, None] + np.arange(n)]
        whole = own.astype(np.int64) if not own.size or abs(own).max() < 2**62 else np.array([[int(c) for c in r] for r in own.tolist()], object)
        yield n, at, whole.reshape(len(at), PARTS, n // PARTS)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """What a task's parts add up to: (dim, part, entry, position, total); position -1 counts them."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for n, _, x in _vectors(batch, 0):
            for p in range(PARTS):
                leaves, _, count = distinct(x[:, p])
                nearest = Trie(leaves, books[n][p]).walk().nearest
                total = found.setdefault((n, p), np.zeros((books[n].shape[1], 1 + n // PARTS), object if x.dtype == object else np.int64))
                np.add.at(total, nearest, np.concatenate([count[:, None], leaves * count[:, None]], axis=1))
    rows = [(n, p, int(e), j - 1, int(total[e, j])) for (n, p), total in found.items() for e in np.flatnonzero(total[:, 0]) for j in range(total.shape[1])]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "part", "entry", "position", "total"])


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: parts to entries, entries to the means of their parts, rounded down; unused entries stay."""
    sums = rows.select("x").mapInArrow(functools.partial(_sums, books=books), "dim int, part int, entry int, position int, total long")
    out = {n: own.astype(object) for n, own in books.items()}
    totals = sums.groupBy("dim", "part", "entry", "position").agg(F.sum("total").alias("total")).collect()  # as many as the codebooks' numbers
    counts = {(r["dim"], r["part"], r["entry"]): r["total"] for r in totals if r["position"] < 0}
    for r in totals:
        if r["position"] >= 0:
            out[r["dim"]][r["part"], r["entry"], r["position"]] = r["total"] // counts[r["dim"], r["part"], r["entry"]]
    return {n: _narrow(own) for n, own in out.items()}


def learned(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    books = first_entries(rows)
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, error = np.zeros((batch.num_rows, PARTS), np.int64), np.zeros(batch.num_rows, object)
        for n, at, x in _vectors(batch, 2):
            for p in range(PARTS):
                leaves, place, _ = distinct(x[:, p])
                trie = Trie(leaves, books[n][p]).walk()
                code[at, p] = trie.nearest[place]
                error[at] += trie.distance[place].astype(object)
        text = [bytes(c).hex() for c in code.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(2).value_lengths(), pa.array(text, pa.string()), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "dim", "code", "error"])


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, dim, code, error) of every row."""
    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(functools.partial(_codes, books=books), f"vec_id long, label {kind}, dim int, code string, error long")


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with `vector`: the entries that the codes stand for, as they were before scaling."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.concatenate([books[n][p, e] for p, e in enumerate(bytes.fromhex(c))]) / scale for c, n in zip(batch.column("code").to_pylist(), batch.column("dim").to_pylist(), strict=True)]
            yield batch.append_column("vector", pa.array([x.astype(float) for x in own], pa.list_(pa.float64())))

    return codes.mapInArrow(back, f"{', '.join(f'{n} {t}' for n, t in codes.dtypes)}, vector array<double>")


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The written codes of all vectors that take part, and the codebooks that they stand on."""
    small_batches(vectors.sparkSession, 8192)
    rows = stored(clean(vectors), "whole")
    books = learned(rows, rounds)
    return stored(encoded(rows, books), "codes"), books


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    codes, books = compress(vectors)
    spark = vectors.sparkSession
    names = spark.createDataFrame([(n, digest(b)) for n, b in books.items()], "dim int, codebooks_sha256 string")
    by_label = codes.groupBy(F.struct("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = codes.select("vec_id", "code", "error", "dim", F.struct("label").alias("of")).join(by_label, "of")  # a struct equals another though it holds a null
    return rows.join(F.broadcast(names), "dim").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(n: int) -> str:
    """Round n: assignments to the entries c{n}, then the entries c{n+1}."""
    return f""",
a{n} AS (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT rid, x.p, c.e, (xx - 2 * coalesce(list_inner_product(x.x, c.x), 0) + cc)::BIGINT AS d FROM parts x JOIN c{n} c ON x.p = c.p) GROUP BY rid, p),
m{n} AS (SELECT p, e, pos, floor(sum(v) / count(*)) AS v FROM (SELECT a.p, a.e, unnest(x.x) AS v, generate_subscripts(x.x, 1) AS pos FROM a{n} a JOIN parts x ON a.rid = x.rid AND a.p = x.p) GROUP BY ALL),
l{n} AS (SELECT p, e, list(v ORDER BY pos) AS x FROM m{n} GROUP BY ALL),
c{n + 1} AS (SELECT p, e, x, coalesce(list_inner_product(x, x), 0) AS cc FROM (SELECT c.p, c.e, coalesce(l.x, c.x) AS x FROM c{n} c LEFT JOIN l{n} l ON c.p = l.p AND c.e = l.e))"""


#: For tables whose vectors have one length.
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT rid, p, x, coalesce(list_inner_product(x, x), 0) AS xx FROM (SELECT rid, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, range({PARTS}) t(p))),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept),
c0 AS (SELECT p, e, x, xx AS cc FROM parts JOIN firsts USING (rid) WHERE e < {ENTRIES}){"".join(_round_sql(n) for n in range(ROUNDS))},
z AS (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT rid, x.p, c.e, (xx - 2 * coalesce(list_inner_product(x.x, c.x), 0) + cc)::BIGINT AS d FROM parts x JOIN c{ROUNDS} c ON x.p = c.p) GROUP BY rid, p),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY rid),
book AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, pos)) AS h FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM c{ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), book
"""
