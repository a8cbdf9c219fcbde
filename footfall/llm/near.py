"""SimHash near-duplicates, verified: five-word shingles of Jaccard similarity 4/5 at least.

Texts with one set of shingles are one text from here on. The SimHash fingerprints of the sets find the close copies:
sets whose fingerprints are within two bits by their deletion variants (`simhash.fingerprint_links`) are compared.
At a similarity of 0.8 fingerprints are about ten bits apart, and variants that survive ten bits select nothing, so
what SimHash cannot reach has a second way: each set also has BANDS keys, each made of WIDTH min-hashes, and sets that
share a key are candidates too. Two sets of similarity s share no key with probability (1 - s^WIDTH)^BANDS: 7e-5 at
0.8, 1e-9 at 0.9. Whatever found a candidate, the exact similarity of its shingles decides.

Candidates are all pairs that share a key while these are few. Where they are many, the most central member of each
key is compared with the others and leaves; what its links have joined needs no comparison any more, so a large group
of copies costs its size, not its square. If many pairs are left, their sets share much, such as a common passage, but
less than enough. Then shingles are the keys: in one order of all shingles, rare ones first, similar sets have their
first common shingle so early that enough of both is left. Each set keeps the shingles up to there as keys, and a pair
shares a key only if what is left of both from there on can suffice (prefixes and positions, as in PPJoin). This loses
no similar pair, and common passages are at the end of the order. The order is by counts of shingles in 2**18 buckets,
which decide on the work alone: any order gives the same links. Keys that still have many pairs are gone through in
rounds, four times as many central members in each as in the one before, and no pair is left out.

Defined results: A-Z are lower-cased, no other letter; a null text is empty; texts without words are one group;
with fewer words than a shingle has, the whole sequence is the only shingle; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import release, small_batches, stored
from footfall.llm.components import connected_components
from footfall.llm.hashing import mixed
from footfall.llm.simhash import few, fingerprint_links, majority, shingle_hashes

WORDS = 5
AT_LEAST = (4, 5)
BANDS, WIDTH = 24, 5
#: All pairs are compared at once when they are up to this many for each set.
PAIRS_A_SET = 4
#: The most members of a key that are compared with all others in one round.
CENTRES = 999
_CHUNK = 1 << 10  # shingles that are min-hashed at once
_BUCKETS = 1 << 18  # of which the counts order shingles
_CLASS = 1.3  # sizes of one class differ by less than this factor, which is above AT_LEAST's 1.25
#: Whether a set can meet one of at least its own size here, and whether two sets can meet here.
_SHORT = f"{sum(AT_LEAST)} * left >= {2 * AT_LEAST[0]} * size"
_MEET = f"root <> other and {sum(AT_LEAST)} * least(left, other_left) >= {AT_LEAST[0]} * (size + other_size)"
#: Odd factors: each brings the shingles, 32 bits of their hashes, into an order of its own.
_FACTORS = np.random.default_rng(8).integers(0, 2**32, (BANDS * WIDTH, 1), np.uint32) | np.uint32(1)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): every row as a struct, with a number that it has again whenever the result is read.

    Files number their own rows; whatever is not just files is written first.
    """

    def placed(read: DataFrame) -> DataFrame:
        return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct("*").alias("doc"))

    try:
        if not docs._jdf.queryExecution().analyzed().children().isEmpty():
            raise AnalysisException("not a plain table")
        rows = placed(docs)
    except AnalysisException:
        rows = placed(stored(docs, "rows"))
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())
    # from Arrow, as rows from a list would start further Python workers on the executors, beside those of the stages
    named = pa.table({"number": pa.array(range(len(files)), pa.int64()), "file": pa.array(files, pa.string())})
    numbers = docs.sparkSession.createDataFrame(named)
    return rows.join(F.broadcast(numbers), "file").select((F.col("number") * F.lit(1 << 40) + F.col("at")).alias("row"), "doc")


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    own = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * WIDTH, 2**32 - 1, np.uint32)
    for i in range(0, len(own), _CHUNK):
        np.minimum(least, (own[None, i : i + _CHUNK] * _FACTORS).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            keys = mixed(keys + least[k::WIDTH], k + 1)
    return keys


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, prints, keys = [], [], [np.zeros(0, np.uint64)]
        for text in batch.column(3):
            own = shingle_set(text.as_py(), words)
            digests.append(blake2b(own.tobytes(), digest_size=16).digest())
            prints.append(majority(own))
            keys.append(band_keys(own))
        ends = pa.array(np.arange(len(digests) + 1, dtype=np.int32) * BANDS)
        bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))
        fp = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), fp, bands], names=["row", "doc_id", "mark", "digest", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingle_set(x.as_py(), words).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["row", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both * AT_LEAST[1] >= (len(x) + len(y) - both) * AT_LEAST[0])
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(_BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_BUCKETS, np.int64)
    for batch in batches:
        own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
        counts += np.bincount(_buckets(own), minlength=_BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lefts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for x in batch.column(1):
            own = np.frombuffer(x.as_py(), np.uint64)
            left = np.arange(len(own), 0, -1)
            left = left[left * AT_LEAST[1] >= len(own) * AT_LEAST[0]]
            first = own[np.lexsort((own, counts[_buckets(own)]))[: len(left)]]
            # similar sets have sizes of one class or of two that follow each other
            at = int(log(len(own) or 1, _CLASS))
            keys += [mixed(first, at), mixed(first, at + 1)]
            lefts += [left, left]
            sizes += [len(own), len(own)]
        times = np.array(list(map(len, lefts[1:])), np.int64)
        rows = np.repeat(batch.column(0).to_numpy().repeat(2), times)
        columns = [np.concatenate(keys).view(np.int64), rows, np.repeat(np.array(sizes, np.int64), times), np.concatenate(lefts)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "row", "size", "left"])


def _rare(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, row, size, left) of the sets of these rows: the shingles by which they meet all that is similar to them.

    left: how many of the set's `size` shingles are not before this one.
    """
    own = stored(sets.join(few(rows), "row", "left_semi"), "crowded")
    counts = np.zeros(_BUCKETS, np.int64)
    # one row for each bucket at most, whatever the input
    found = own.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    entries = stored(own.mapInArrow(partial(_prefixes, counts=counts), "key long, row long, size long, left long"), "entries")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr(f"if({_SHORT}, size, null)")).alias("least")).where("n > 1 and least is not null")
    out = stored(entries.join(shared.drop("n"), "key").where(f"{sum(AT_LEAST)} * left >= {AT_LEAST[0]} * (size + least)").drop("least"), "rare")
    release(own, entries)
    return out


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    pairs = stored(pairs.distinct(), "pairs")
    one, other = sets.toDF("a", "one"), sets.toDF("b", "other")
    met = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "one", "other")
    out = stored(met.mapInArrow(_similar, "a long, b long"), "similar")
    release(pairs)
    return out


def _close(firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash finds: one fingerprint, or fingerprints within two bits."""
    by_print = stored(firsts.groupBy("fp").agg(F.min("chosen").alias("least")), "prints")
    same = firsts.join(by_print, "fp").where("chosen <> least").select(F.col("least").alias("a"), F.col("chosen").alias("b"))
    links = fingerprint_links(by_print.select("fp"))
    one, other = by_print.toDF("a", "x"), by_print.toDF("b", "y")
    met = links.join(one, "a").join(other, "b")
    return same.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _hooked(links: DataFrame) -> DataFrame:
    """(a, root): what each set's least link leads to in two steps, which is in its component if not yet its root."""
    least = links.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("root"))
    on = least.toDF("by", "next")
    return least.join(on, least.root == on.by, "left").select("a", F.coalesce("next", "root").alias("root"))


def _components(members: DataFrame, sets: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(a, root) of sets that are linked to a smaller one. members: (key, row); links: what is linked already.

    While sets are compared, what is joined already is known by `_hooked` alone; only the end needs components, and
    the change to rare shingles as keys.
    """
    centres, before, rare = 1, [], False
    members = members.select("key", "row", *(F.lit(0).cast("long").alias(c) for c in ("size", "left")))
    while True:
        roots = _hooked(links)
        named = members.join(roots, members.row == roots.a, "left").select("key", "row", "size", "left", F.coalesce("root", "row").alias("root"))
        counted = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.expr(_SHORT)).alias("short"))
        sizes = counted.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"), F.sum("short").alias("short"))
        pairs = F.least((F.col("n") * F.col("n") - F.col("s")) / 2, (F.col("n") * F.col("short")).cast("double"))
        # keys whose members are not yet known to be joined
        live = stored(named.join(sizes.where("n * n > s and short > 0").select("key", "n", pairs.alias("pairs")), "key"), "live")
        release(*before)
        total = live.agg(F.coalesce(F.sum(F.col("pairs") / F.col("n")), F.lit(0.0))).first()[0]
        if total < 0.5:
            return connected_components(links)
        theirs = [F.col("root").alias("other"), F.col("size").alias("other_size"), F.col("left").alias("other_left")]
        if total <= most:
            other = live.select("key", F.col("row").alias("b"), *theirs)
            pairs = live.join(other, "key").where(f"row < b and {_MEET}").select(F.col("row").alias("a"), "b")
            return connected_components(links.union(_links(pairs, sets)))
        if centres > 1 and not rare:
            links = connected_components(links).select(F.col("root").alias("a"), F.col("a").alias("b"))
            members, rare = _rare(live.select("row").distinct(), sets), True
            before = [live, members]
            continue
        # the window keeps no more than CENTRES rows of a key and task, as Spark limits ranks before it shuffles
        central = live.groupBy("row").agg(F.sum("n").alias("score"))
        order = Window.partitionBy("key").orderBy(F.col("score").desc(), "row")
        chosen = live.join(central, "row").select("key", F.col("row").alias("a"), *theirs, F.row_number().over(order).alias("place"))
        middle = stored(chosen.where(F.col("place") <= centres).drop("place"), "centres")
        pairs = live.join(middle, "key").where(_MEET).select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b"))
        found = _links(pairs, sets)
        left = live.join(middle.select("key", F.col("a").alias("row")), ["key", "row"], "left_anti")
        members = left.select("key", "row", "size", "left")
        before = [live, middle]
        links, centres = links.union(found), min(4 * centres, CENTRES)


def near_copies(rows: DataFrame, words: int = WORDS, most: int | None = None) -> DataFrame:
    """(row, doc_id, mark, root) of numbered rows.

    Near copies share their root, the smallest row of their component; mark is a hash of the text.
    """
    small_batches(rows.sparkSession)
    text = F.col("doc.text")
    texts = rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketches = stored(texts.mapInArrow(partial(_sketches, words=words), "row long, doc_id long, mark long, digest binary, fp long, bands array<long>"), "sketches")
    firsts = stored(sketches.groupBy("digest").agg(F.min("row").alias("chosen"), F.first("fp").alias("fp")), "firsts")
    keyed = sketches.join(firsts, sketches.row == firsts.chosen, "left_semi").select("row", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stored(keyed.join(shared, "key", "left_semi"), "members")
    close = stored(_close(firsts), "close")
    asked = stored(members.select("row").union(close.select("a")).union(close.select("b")).distinct(), "asked")
    sets = stored(texts.join(few(asked), "row", "left_semi").select("row", "text").mapInArrow(partial(_sets, words=words), "row long, shingles binary"), "sets")
    links = _links(close, sets)
    release(asked, close)
    roots = stored(_components(members, sets, links, PAIRS_A_SET * firsts.count() if most is None else most), "roots")
    release(members, sets)
    by_digest = firsts.join(roots, firsts.chosen == roots.a, "left").select("digest", F.coalesce("root", "chosen").alias("root"))
    return sketches.drop("bands", "fp").join(by_digest, "digest").select("row", "doc_id", "mark", "root")
