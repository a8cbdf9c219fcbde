"""Output shards of the mix."""

from pyspark.sql import functions as F

from footfall.llm import mixing


def test_shards_are_on_the_main_path(spark, tmp_path):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i % 37 * 3)), f"s{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixing.write_shards(docs, f"{tmp_path}/mix", block=16, shard_words=900)
    got = spark.read.parquet(f"{tmp_path}/mix").collect()
    taken = mixing.mix(docs, block=16, shard_words=900).collect()
    words = {}
    for r in got:
        words.setdefault(r["doc_id"], []).extend(r["text"].split())
    assert all(len(words.get(r["doc_id"], [])) == r["taken"] for r in taken)
    targets = {r["target"]: 0 for r in taken}
    shards = -(-sum(round(t) for t in targets) // 900)
    assert shards > 5 and {r["shard"] for r in got} <= set(range(shards))
    want = mixing.shard_counts(mixing.slots(mixing.source_targets(mixing.numbered(docs)), 16), shards).collect()
    have = {}
    for r in got:
        n, w = have.setdefault((r["shard"], "s" + r["source"]), (set(), [0]))
        n.add((r["pass"], r["number"]))
        w[0] += len(r["text"].split())
    assert {k: (len(n), w[0]) for k, (n, w) in have.items()} == {(r["shard"], r["src"]): (r["slots"], r["words"]) for r in want}
    texts = {r["doc_id"]: sorted(r["text"].split()) for r in mixing.mixed_documents(docs, block=16, shard_words=900).collect()}
    assert texts == {k: sorted(v) for k, v in words.items()}
    assert "shard" in mixing.slots(spark.createDataFrame([("sa", 100, 150.0)], "src string, source_size long, target double")).where(F.col("shard") == 0).columns
