"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every operator of this package: space and 09 to 0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, one machine may make a folder of its own; a cluster may not, as its executors would
    each write to their own disks.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="footfall-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


_PLACES: dict[int, tuple[DataFrame, str]] = {}  # what `stored` wrote, until it is released


def stored(df: DataFrame, name: str, rows_per_file: int | None = None, by: str | None = None) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    The files outlive executors, so a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = out, path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing still to be computed reads."""
    for df in frames:
        _, path = _PLACES.pop(id(df), (None, None))
        if path is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def only_result() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Everything stored inside goes at the end, but for the frame that the given function was called with."""
    before, kept = set(_PLACES), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(id(df))
        return df

    yield keep
    release(*(df for key, (df, _) in list(_PLACES.items()) if key not in before and key not in kept))


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of long texts small; a text is never split over batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
