"""Near copies against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import near, simhash

DOCS = "doc_id bigint, text string, source string"


def _edited(words: list[str], share: float, rng: random.Random) -> str:
    """The words, about one in so many of them changed, in runs as edits are."""
    own = list(words)
    for at in rng.sample(range(0, len(own), 10), round(share * len(own))):
        own[at] = f"new{rng.random()}"
    return " ".join(own)


def _jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def _components(texts: list[str]) -> list[int]:
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and _jaccard(texts[i], texts[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    for group in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(200)]
        out += [" ".join(base)] + [_edited(base, share, rng) for share in (0.005, 0.01, 0.015, 0.02, 0.03)]
    crowd = [f"c{rng.randrange(400)}" for _ in range(200)]
    return out + [_edited(crowd, 0.015, rng) for _ in range(20)] + [" ".join(crowd).upper()]


@pytest.mark.parametrize("most", [None, 0])
def test_near_copies_equal_all_pairs(spark, texts, most):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    found = near.near_copies(near.numbered(docs), most=most).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for i, r in enumerate(_components(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(found) == len(texts)


def test_stage_drops_copies_of_08(spark, texts):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert kept == set(_components(texts))


def test_stage_keeps_a_row_of_each_text(spark, texts):
    """Null and shared ids: each group of near copies keeps one row, whatever the ids of its rows."""
    alone = [texts[i] for i in (0, 6, 12, 18, 24)]
    rows = [(None, t, "s") for t in alone[:3]] + [(7, t, "s") for t in alone[3:]] + [(None, alone[0], "t"), (None, alone[4], "t"), (9, alone[3], "t"), (7, alone[3], "u")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == sorted([*((t, None) for t in alone[:3]), *((t, 7) for t in alone[3:])], key=lambda x: x[0])


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near.near_copies(near.numbered(docs)).count() == 0


def test_a_crowd_without_copies(spark):
    """One key, many members that are not similar: rounds grow with the logarithm of their number."""
    rng = random.Random(3)
    common = [f"t{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*common, *(f"o{rng.random()}" for _ in range(12))]), "s") for i in range(300)], DOCS)
    rows = near.numbered(docs).cache()
    texts = rows.select("row", F.col("doc.text").alias("text"))
    sets = texts.mapInArrow(lambda batches: near._sets(batches, 5), "row long, shingles binary")
    members, none = rows.select(F.lit(1).cast("long").alias("key"), "row"), spark.createDataFrame([], "a long, b long")
    rounds = []
    plain = near._links
    near._links = lambda pairs, sets: rounds.append(1) or plain(pairs, sets)
    try:
        assert near._components(members, sets, none, 0).count() == 0 and len(rounds) <= 6
    finally:
        near._links = plain


def test_a_passage_that_most_texts_hold(spark):
    """What shares a passage and is not similar is hardly compared; similar sets among it are still found."""
    rng = random.Random(7)
    common = [f"t{i}" for i in range(60)]
    texts = [" ".join([*common, *(f"o{rng.random()}" for _ in range(rng.randrange(11, 30)))]) for _ in range(300)]
    for i in range(0, 300, 10):
        words = texts[i].split()
        words[-1 - i % 3 : len(words)] = [f"n{rng.random()}" for _ in range(rng.randrange(1, 4))]
        texts.append(" ".join(words[i % 2 * 3 :]))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    compared, plain = [], near._links
    near._links = lambda pairs, sets: compared.append(pairs.distinct().count()) or plain(pairs, sets)
    try:
        found = near.near_copies(near.numbered(docs)).collect()
    finally:
        near._links = plain
    groups, want = {}, {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    for i, r in enumerate(_components(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(want) < 330
    assert sum(compared[2:]) < 3 * len(texts)


def test_sets_meet_in_their_prefixes(spark):
    """Every pair of similar sets shares an entry by which it may meet, whatever the counts that order shingles."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        base = rng.sample(range(1, 500), rng.randrange(2, 90))
        rows += [sorted(base), sorted(base[: -(-len(base) * 4 // 5)]), sorted({*base, *rng.sample(range(500, 600), len(base) // 5)})]
    arrays = [np.array(r, np.uint64) for r in rows]
    counts = np.random.default_rng(1).integers(0, 9, near._BUCKETS)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([a.tobytes() for a in arrays], pa.binary())], names=["row", "shingles"])
    met, by_key = set(), {}
    for e in pa.Table.from_batches(near._prefixes(iter([batch]), counts)).to_pylist():
        for o in by_key.setdefault(e["key"], []):
            if 9 * min(e["left"], o["left"]) >= 4 * (e["size"] + o["size"]):
                met.add((o["row"], e["row"]))
        by_key[e["key"]].append(e)
    similar = {(i, j) for j in range(len(rows)) for i in range(j) if 5 * len({*rows[i]} & {*rows[j]}) >= 4 * len({*rows[i]} | {*rows[j]})}
    assert len(similar) > 100 and similar <= met


def test_variants_are_dealt_out(spark):
    """What was just grouped by fingerprint is not left in one small partition, which becomes 128 times its size."""
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp")).groupBy("fp").count()
    assert simhash.variants(prints.select("fp")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_null_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, long, "s"), (4, long + " more", "s"), (5, long.replace("w1", "x1"), "s")], DOCS)
    groups = {}
    for r in near.near_copies(near.numbered(docs)).collect():
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3, 4], [5]]


def test_numbers_of_files_start_no_python_workers(spark, tmp_path):
    spark.createDataFrame([(i, str(i), "s") for i in range(6)], DOCS).repartition(3).write.parquet(str(tmp_path / "docs"))
    rows = near.numbered(spark.read.parquet(str(tmp_path / "docs")))
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.select("row").distinct().count() == 6
