"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two halves, and each half again into two quarters. Fingerprints that differ in at most two
bits agree in one half but for nothing, and in a quarter of the other but for one bit at most; or in one half but for
one bit, and in a quarter of the other but for nothing. So a fingerprint is indexed under 128 variants of 47 bits:
each half with each quarter of the other half, of which one bit is left out, and the first half of which one bit is
left out with each quarter of the second. Equality of variants finds candidates, the whole fingerprints verify them.

A variant of 47 bits is shared by chance by very few fingerprints even among 10**10, so what three or more share is a
cluster of near copies. There all pairs would grow with its square; its members are indexed by themselves and their
64 one-bit neighbours. They share such a key exactly when they differ in at most two bits, a key has at most 65
members, and links from its smallest member to the others keep everything that is reachable.

Defined results: A-Z are lower-cased, no other letter; a null text is empty; a text without words has
fingerprint zero and links like any other; with fewer than three words the whole sequence is the only shingle;
rows that repeat a doc_id are kept and share what any of them links to only through their own texts; a null
doc_id is never the smallest; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import shuffle_width, small_batches, stored
from footfall.llm.components import connected_components

HALF, QUARTER = 32, 16
#: Small tables are sent to all tasks up to this many rows (8 MB), larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 18  # hashes whose bits are counted at once


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of `words` words of the text, in order and with repeats."""
    from xxhash import xxh64_intdigest as digest

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return []
    line = b" ".join(own)
    if len(own) < words:
        return [digest(line, seed)]
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(own) - words + 1].tolist()
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for i in range(0, len(h), _CHUNK):
        part = h[i : i + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([majority(shingle_hashes(x.as_py())) for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """All variants: kind, left-out bit, the exact bits and the bits with one left out, hashed to a long."""

    def part(at: int, bits: int) -> Column:
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def keys(kind: int, exact: tuple[int, int], open_: tuple[int, int]) -> Column:
        own, other = part(*exact), part(*open_)
        masks = F.sequence(F.lit(0), F.lit(open_[1] - 1))
        every = (1 << open_[1]) - 1
        return F.transform(
            masks,
            lambda bit: F.xxhash64(F.lit(kind), bit, own, other.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit).bitwiseXOR(F.lit(every).cast("long")))),
        )

    quarters = [(at, QUARTER) for at in range(0, 64, QUARTER)]
    low, high = (0, HALF), (HALF, HALF)
    pairs = [*((low, q) for q in quarters[2:]), *((high, q) for q in quarters[:2]), *((q, low) for q in quarters[2:])]
    return F.flatten(F.array(*(keys(kind, exact, open_) for kind, (exact, open_) in enumerate(pairs))))


def few(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def variants(prints: DataFrame) -> DataFrame:
    """(fp, variant) of fingerprints, in as many tasks as a shuffle has.

    The key is a hash of fp, not fp: what was just grouped by fp would not be dealt out again, and its few bytes would
    be one task, which then makes 128 rows of each.
    """
    width = max(shuffle_width(prints.sparkSession), 1)
    return prints.repartition(width, F.xxhash64("fp")).select("fp", F.explode(_variants(F.col("fp"))).alias("variant"))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints that reach whatever is within two bits, step by step.

    `prints` holds each fingerprint once, in column fp. Variants are hashed to 64 bits; what meets by chance differs
    in more than two bits and goes like any other candidate.
    """
    indexed = variants(prints)
    shared = stored(
        indexed.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"),
        "variants",
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    paired = shared.where("n = 2").where(near).select("a", "b")
    crowded = indexed.join(few(shared.where("n > 2").select("variant")), "variant", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)))
    around = (
        crowded.select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .agg(F.collect_list("fp").alias("members"))  # at most 65
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return paired.union(around)


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of fingerprinted rows (doc_id, fp)."""
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(fingerprint_links(groups.select("fp")))
    linked = groups.join(roots, groups.fp == roots.a, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = linked.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprints are computed once and stored."""
    return components(stored(fingerprints(docs), "prints"))
