"""Micro-batches taken in by slices of so many hits, each a batch of the store by itself.

A stream's batch is some files, and one file may hold any number of hits. Where slices are asked for, the usable hits of a
micro-batch are written once to `root/slices/<epoch>/<attempt>/slice=<k>`, in the order in which their files came and
their lines stand in them, and `root/slices/<epoch>/plan` names the attempt when it is whole. Each slice is then taken in
under a number of its own whose marker says which slice of which micro-batch it was. A run that dies or has spent its
budget leaves the plan behind, so the next one goes on with the first slice that is not yet written and reads neither the
files nor the slices before it again. Slices follow the plan and not how Spark splits files, which may differ then.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall.operators.store import Store

#: Where each block of a file begins is broadcast up to so many blocks, which are counted first; beyond, joined by shuffle.
FEW_BLOCKS = 100_000


class BudgetSpent(Exception):
    """The run has taken in as many slices as it may."""


@dataclass
class Budget:
    """How many slices a run may take in (None: all), and how many it has."""

    most: int | None = None
    taken: int = 0
    spent: bool = False

    def take(self) -> None:
        if self.most is not None and self.taken >= self.most:
            self.spent = True
            raise BudgetSpent(f"{self.taken} slices taken in")
        self.taken += 1


@dataclass(frozen=True)
class Progress:
    """batch: the next number in the store; slice: the first slice of the micro-batch to take in, None if all are."""

    batch: int
    slice: int | None


def progress(store: Store, epoch: int) -> Progress:
    """How far a micro-batch has come. Markers that name no slice are of micro-batches that were taken in whole."""
    last = max(store.written(), default=-1)
    if last < 0:
        return Progress(0, 0)
    note = store.note(last)
    reached, part, parts = note.get("epoch", last), note.get("slice", 0), note.get("slices", 1)
    if reached > epoch or (reached == epoch and part + 1 >= parts):
        return Progress(last + 1, None)
    return Progress(last + 1, part + 1 if reached == epoch else 0)


def placed(lines: DataFrame) -> DataFrame:
    """`lines` of files, with their `file` metadata, and the `place` of each among all, from 0.

    Files come in the order of their last change, then by name. Only one row for each block of a file, with the number of
    its lines, is ordered in one task. Blocks are those that Spark reads at a time; no lines give none.
    """
    block = [F.col("file.file_modification_time").alias("_at"), F.col("file.file_path").alias("_path"), F.col("file.file_block_start").alias("_from")]
    marked = lines.select("*", *block, F.monotonically_increasing_id().alias("_id"))
    counts = marked.groupBy("_at", "_path", "_from").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")).persist()
    try:
        few = counts.count() <= FEW_BLOCKS
        before = Window.orderBy("_at", "_path", "_from").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_path", "_from", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_start"))
        met = marked.join(F.broadcast(starts) if few else starts, ["_path", "_from"])
        return met.withColumn("place", F.col("_start") + F.col("_id") - F.col("_first")).drop("_path", "_from", "_at", "_id", "_first", "_start")
    finally:
        counts.unpersist()


class Slices:
    """The slices of one micro-batch, on disk until all of them are taken in."""

    def __init__(self, store: Store, epoch: int):
        self.store, self.folder = store, f"slices/{epoch}"

    def plan(self) -> dict | None:
        return self.store._read_text(f"{self.folder}/plan") if self.store._exists(f"{self.folder}/plan") else None

    def cut(self, lines: DataFrame, hits: int) -> dict:
        """Write the lines by slices of `hits` hits, the last of which may be shorter; none give one empty slice."""
        attempt = uuid.uuid4().hex
        rows = placed(lines).withColumn("slice", F.floor(F.col("place") / hits).cast("int")).withColumnRenamed("place", "seq").drop("file")
        rows.write.partitionBy("slice").parquet(f"{self.store.root}/{self.folder}/{attempt}")
        written = [n for n in self.store._names(f"{self.folder}/{attempt}") if n.startswith("slice=")]
        self.store._publish(f"{self.folder}/plan", {"attempt": attempt, "slices": max(1, len(written)), "schema": rows.drop("slice").schema.json()})
        return self.plan()

    def read(self, plan: dict, part: int) -> DataFrame:
        schema, place = StructType.fromJson(json.loads(plan["schema"])), f"{self.folder}/{plan['attempt']}/slice={part}"
        spark = self.store.spark
        return spark.read.schema(schema).parquet(f"{self.store.root}/{place}") if self.store._exists(place) else spark.createDataFrame([], schema)

    def clear(self) -> None:
        self.store._delete(self.folder)
