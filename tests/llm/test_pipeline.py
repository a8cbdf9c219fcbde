"""The pipeline's stages, one after the other, on a small table with planted cases."""

import random

import numpy as np
import pytest

import corpus_pipeline
from footfall.llm import sentencepiece
from footfall.llm.queries import tokenizer_file

WORDS = [a + b for a in "river stone winter garden letter window summer table bridge market forest candle".split() for b in ("", "s", "side", "light")]


def _text(seed: int, n: int = 60) -> str:
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) + ("." if i % 11 == 10 else "") for i in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, _text(i) + f" only{i}", "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, "BUY!! NOW!! PILLS!! CASH!! " * 10 + f"X{i}!!", "en", "s0", 0) for i in range(60)]
    rows += [(300 + i, rows[5][1], "en", "s1", 0) for i in range(20)]
    rows += [(400, _text(400) + " write to someone@example.org now", "en", "s2", 0), (401, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows if r[0] < 260], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        seen[name] = docs = docs.cache()
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["quality"] >= set(range(120)) | set(range(300, 320)) | {400} and not ids["quality"] & set(range(200, 260))
    assert 5 in ids["near_duplicates"] and not ids["near_duplicates"] & set(range(300, 320))
    assert seen["near_duplicates"].count() == len(ids["near_duplicates"])
    hidden = seen["personal_data"].where("doc_id = 400").first()["text"]
    assert "someone@example.org" not in hidden and "[EMAIL]" in hidden
    assert ids["source_mix"] <= ids["personal_data"] and len(ids["source_mix"]) > 0.5 * len(ids["personal_data"])


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    codec = sentencepiece.Codec(tokenizer_file("piece_bpe_32k.model"))
    assert rows and all(set(r.asDict()) == {"doc_id", "ids"} for r in rows)
    texts = {r["doc_id"]: codec.decode(np.array(r["ids"])) for r in rows}
    assert 400 in texts and "[EMAIL]" in texts[400] and "someone@example.org" not in texts[400]
    assert not any(200 <= i < 260 or 300 <= i < 320 for i in texts)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "source_mix", "pieces"]
