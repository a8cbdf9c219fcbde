"""The training-data operators against brute force, round trips and held-out accuracy, on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import langid, licenses, mixing, mtree, pii, qalsh, quality, sentencepiece, simhash, token_store, vectors
from footfall.llm.components import connected_components
from footfall.llm.queries import tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, src string, doc string, size string, _row string, marks string, new string, at string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: null and empty texts, null ids and sources, repeated rows, a long text, columns whose names clash
HARD = [  # the other columns' names are used inside the operators
    (3, "The quick brown fox jumps over the lazy dog.", "en", "a", 44, "x", "y"),
    (3, "The quick brown fox jumps over the lazy dog.", "en", "a", 44, "x", "y"),
    (1, None, None, None, None, None, None),
    (None, "ein Text ohne Nummer", "de", "b", 20, None, None),
    (2, "", "en", "a", 0, "", ""),
    (9, LONG, "en", "a", len(LONG), "", ""),
    (7, "  \t\n ", None, "b", 5, "", ""),
    (8, "été 日本 𝄞 ▁x\r\n", "fr", None, 12, "", ""),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, "d", "1", "r", "m", "n", "a") for r in HARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# token files


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_257, 2**32])
def test_pfor_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    ids[: n // 50] = top - 1
    data = token_store.encode_ids(ids)
    assert (token_store.decode_ids(data) == ids).all()
    assert (token_store.decode_ids(data, 1, 3) == ids[128:384]).all()


def test_pfor_stores_outliers_apart():
    ids = np.full(128 * 64, 3, np.uint32)
    ids[::128] = 50_000
    assert len(token_store.encode_ids(ids)) < 64 * (6 + 5 + 4) + 16


def test_token_files(spark, hard, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    segments = token_store.write_tokens(hard, path, segment_ids=1000)
    got = token_store.index_tokens(segments).orderBy("start").collect()
    order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (doc_id, text, *_) in zip(got, order, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.read_tokens(segments).count() == len(HARD)
    assert token_store.index_tokens(token_store.write_tokens(empty, path)).count() == 0


def test_pieces_give_whole_text_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    own = token_store.PieceEncoder(path, most=50)
    texts = [
        " a  b\n\t c", "", "   ", "a \n b", "don't stop <|endoftext|>x", "a  <|endoftext|> <|endof", "a\u00a0b\u3000c", "x ", "é𝄞 \r\n y  ", "foo.\nBar\n\nbaz's 12.5%!!", "ét",
        "² ½×÷ª", " \u00a0x \u2003y", "a \u201cq\u201d z", "\n", "\nA\n", None,
    ]
    letters = ["a", "B", "é", "×", "1", "'", "'s", " ", "  ", "\n", "\t", ".", "\u00a0", "\u3000", "ж", "漢", "\x1c", "😀"]
    random = np.random.default_rng(1)
    texts += ["".join(random.choice(letters, 9)) for _ in range(500)]
    for _ in range(2):
        ids, sizes = own(pa.array(texts))
        for t, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_ids_of_another_tokenizer(tmp_path):
    """Pre-tokens that are cut in another way: texts go to the library whole."""
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    other = Tokenizer(models.BPE(vocabulary, []))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    ids, sizes = token_store.PieceEncoder(str(tmp_path / "other.json"))(pa.array(["ab c", ""]))
    assert ids.tolist() == other.encode("ab c", add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0]


# licences


def test_licenses(spark, hard, empty):
    mit = licenses.LICENSE_TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace(" license", " licence") + "!"), (3, mit + " and more"), (4, "Words.\nReleased under the  MIT Licence\nmore"), (5, None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 6)] == ["MIT", "MIT", "", "", ""]
    assert (got[4]["n_notices"], got[4]["notices"]) == (1, "MIT")
    assert got[5]["digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(hard).count() == len(HARD) and licenses.scan(empty).count() == 0


def test_license_files_as_they_come(spark, tmp_path):
    """Every width from 40 to 100, with title, copyright line, list marks and comment signs."""
    import textwrap

    heads = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "Unlicense": "The Unlicense"}
    rows, want = [], []
    for name, text in licenses.LICENSE_TEXTS.items():
        for width in range(40, 101):
            wrapped = "\n\n".join(textwrap.fill(x, width, break_on_hyphens=width % 2 == 0) for x in text.split("\n"))
            notice = ("Copyright (c) 2020, Some One\nAll rights reserved.", "Copyright 1999-2024 The Authors", "(c) 2001 x", "Copyright Acme Inc.")[width % 4]
            rows.append(f"{heads.get(name, 'MIT License')}\n\n{notice}\n\n{wrapped}\n")
            want.append(name)
        starred = re.sub(r"(?m)^[0-9]\. ", "* ", text)
        rows += ["\n".join(" * " + x for x in starred.split("\n")), re.sub(r"(?m)^([0-9])\. ", r"(\1) ", text), text + "\nand one line more"]
        want += [name, name, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want
    (tmp_path / "Own-1.0.txt").write_text("You may do\nas you like.\n")
    own = licenses.scan(spark.createDataFrame([(1, "YOU MAY do as\nyou like")], "doc_id int, text string"), licenses.from_files(spark, str(tmp_path)))
    assert own.first()["license"] == "Own-1.0"


# quality


def _labelled(spark, n=240):
    good = [f"The {w} of this house was seen by many people in the {w} town, and they said so." for w in ("roof", "door", "garden", "floor")]
    bad = ["BUY!! NOW!! CHEAP!! PILLS!!", "spam spam spam spam spam", "x### y&&& z*** q$$$", "win | cash | now | click"]
    rows = [(i, (good if i % 2 else bad)[i // 2 % 4] + f" number{i}", i % 2) for i in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")


def test_quality_learns(spark, hard, empty):
    docs, labels = _labelled(spark)
    weights = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.score(docs, weights).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert all((r["quality_score"] >= 0.5) == bool(r["quality"]) for r in held)
    scores = [r["quality_score"] for r in quality.score(hard, weights).collect()]
    assert len(scores) == len(HARD) and all(0 <= s <= 1 for s in scores)
    assert quality.score(empty, weights).count() == 0
    none = quality.train(empty.select("doc_id", "text"), labels.limit(0))
    assert {r["quality_score"] for r in quality.score(hard, none).collect()} == {0.5}


def test_quality_score_is_the_sparse_dot_product():
    weights = np.random.default_rng(1).standard_normal(quality.BIAS + 1)
    texts = ["a b a b", "", None, "Long " * 400_000]
    got = quality.score_texts(texts, weights)
    owner, number, value = quality.features(texts[:1])
    want = 1 / (1 + np.exp(-(weights[number] @ value + weights[quality.BIAS])))
    assert got[0] == pytest.approx(want) and got[1] == got[2] == pytest.approx(1 / (1 + np.exp(-weights[quality.BIAS])))


# vectors


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, vector string")


def _exact(rows, k=20, **sizes):
    whole = rows.withColumn("vector", mtree.rounded(F.col("vector")))
    return vectors.top_k(whole, F.col("vec_id") % 20 == 0, mtree.build, k, "long", **sizes)


def _close(rows, k=20, **sizes):
    return vectors.top_k(rows.where(F.exists("vector", lambda c: c != 0)), F.col("vec_id") % 20 == 0, qalsh.CollisionIndex, k, "double", **sizes)


def _brute(rows, k, scale=None):
    v = {i: np.array(x, np.float32).astype(float) for i, x, *_ in rows}
    if scale:
        v = {i: np.floor(scale * x) for i, x in v.items()}
    return {(q, n): (i, s) for q in v if q % 20 == 0 for n, (s, i) in enumerate(sorted(((-float(np.cumsum(v[q] * v[i])[-1]), i) for i in v if i != q))[:k], 1) for s in [-s]}


def _vector_rows(n=700, dim=12):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim)) * rng.uniform(0.5, 2, (n, 1))
    x[100:180] = x[100]
    return [(i, [float(c) for c in np.float32(r)], 0, "clash") for i, r in enumerate(x)]


def test_mtree_is_exact(spark):
    rows = _vector_rows()
    got = _exact(vectors.clean(_vectors(spark, rows)), shard_rows=60, block_rows=20)
    want = _brute(rows, 20, 64)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == {k: (i, int(s)) for k, (i, s) in want.items()}


def test_collision_search_recall(spark):
    rows = _vector_rows()
    got = _close(vectors.clean(_vectors(spark, rows)), shard_rows=150).collect()
    want = _brute(rows, 20)
    pairs = {(q, i) for (q, _), (i, _) in want.items()}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & pairs) >= 0.95 * len(pairs)
    v = {i: np.array(x) for i, x, *_ in rows}
    assert all(r["score"] == pytest.approx(v[r["query_id"]] @ v[r["vec_id"]], abs=1e-12) for r in got)


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0, ""), (1, [0.5, 0.5], 0, ""), (1, [0.5, 0.5], 0, ""), (2, None, 0, ""), (3, [nan, 1.0], 0, ""), (4, [inf, 1.0], 0, ""), (5, [None, 1.0], 0, ""), (6, [0.0, 0.0], 0, ""), (None, [1.0, 1.0], 0, ""), (7, [1.0], 0, ""), (8, [], 0, "")]
    clean = vectors.clean(_vectors(spark, rows))
    got = _exact(clean).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 2048), (0, 2, 1, 2048), (0, 3, 6, 0)]
    assert [(r["vec_id"], r["score"]) for r in _close(clean).collect()] == [(1, 0.5), (1, 0.5)]
    assert _exact(clean.limit(0)).count() == 0 == _close(clean.limit(0)).count()


def test_rows_that_share_an_id(spark):
    """Each is a candidate, a zero vector does not hide another, and queries leave out their own row only."""
    rows = [(0, [1.0, 1.0], 0, ""), (0, [2.0, 0.0], 0, ""), (1, [0.0, 0.0], 0, ""), (1, [0.5, 0.5], 0, ""), (2, [0.25, 0.25], 0, "")]
    clean = vectors.clean(_vectors(spark, rows))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in _close(clean).collect())
    assert got == sorted([(0, 1, 0, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5), (0, 1, 0, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5)])
    assert len(_exact(clean).collect()) == 8


def test_bounds_spare_distances():
    """Best-first search computes few distances where vectors lie in groups; far cells are not visited."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16)) * 20
    x = np.floor(centres[rng.integers(0, 30, 3000)] * 3 + rng.standard_normal((3000, 16)) * 3)
    tree = mtree.MTree(np.arange(3000), np.arange(3000), x)
    q, r, score = tree.find(x[:50], np.arange(50), 5, np.full(50, -np.inf))
    for i in range(50):
        own = x @ x[i]
        own[i] = -np.inf
        assert sorted(score[q == i], reverse=True) == sorted(own, reverse=True)[:5]
    assert tree.computed < 0.5 * 50 * 3000
    cells = vectors.Cells(centres * 3, float((x**2).sum(axis=1).max()))
    away = cells.away(x)
    cells.radius = np.array([away[away.argmin(axis=1) == c, c].max() for c in range(30)])
    least = np.array([np.sort(x @ x[i])[-6] for i in range(50)])
    assert cells.wanted(x[:50], least).mean() < 0.5


def test_mtree_beyond_double_precision(spark):
    rows = [(0, [2.0**30, 1.0], 0, ""), (1, [2.0**20, 3.0], 0, ""), (2, [1.0, 1.0], 0, "")]
    got = _exact(vectors.clean(_vectors(spark, rows)), 2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**36 * 2**26 + 64 * 192), (2, 2**36 * 64 + 64 * 64)]


# mixing


def test_mix_keeps_its_bounds(spark, empty):
    rows = [(i, " ".join(["w"] * (i % 37 * 9)), f"s{min(i % 11, 3)}" if i % 13 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        t = by.setdefault(s, [0, 0, r["target"], r["source_size"]])
        t[0], t[1] = t[0] + r["taken"], t[1] + r["size"]
    assert all(abs(taken - target) <= 1 and size == whole and target <= 2 * size for taken, size, target, whole in by.values())
    assert sum(t[2] for t in by.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_permutes_blocks(spark):
    targets = spark.createDataFrame([("sa", 128 * 1000 + 5, 1.7 * (128 * 1000 + 5))], "src string, source_size long, target double")
    rows = mixing.slots(targets).collect()
    first = [r["block"] for r in rows if r["pass"] == 0]
    assert sorted(first) == list(range(1001)) and [r["block"] for r in sorted(rows, key=lambda r: r["number"]) if r["pass"] == 0] != sorted(first)
    second = [r["block"] for r in rows if r["pass"] == 1]
    assert len(set(second)) == len(second)
    assert abs(sum(r["take"] for r in rows) - 1.7 * (128 * 1000 + 5)) <= 0.5
    counts = mixing.shard_counts(mixing.slots(targets), 10).collect()
    assert len(counts) == 10 and sum(r["slots"] for r in counts) == len(rows)


def test_mixed_texts(spark, hard):
    got = mixing.mixed_documents(hard)
    assert got.columns == hard.columns
    sizes = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(hard).collect()}
    for r in got.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert any(i == r["doc_id"] and t == n for i, _, t in sizes) and r["n_chars"] == len(r["text"])


# language


def test_language_mixture(spark, hard, empty):
    words = {"en": "the house and garden with people", "de": "das haus und der garten mit leuten", "fr": "la maison et le jardin avec des gens"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(w.split(), 30)), lang) for i, (lang, w) in enumerate(list(words.items()) * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    probe = [(0, "the people and the garden", "en"), (1, "les gens avec le jardin " * 30 + "the house with people " * 15, "fr"), (2, "12345 !!", "und"), (3, None, "und"), (4, "der garten", "de"), (5, "das haus und " * 60_000, "de")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(probe, "doc_id bigint, text string, want string"), model, ["doc_id", "want"]).collect()}
    assert all(r["lang_pred"] == r["want"] and 0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["score"] == 1 and 0.4 < got[1]["score"] < 0.95 and got[2]["score"] == got[3]["score"] == 0
    assert langid.predict(hard, model, ["doc_id", "src"]).count() == len(HARD) and langid.predict(empty, model, ["doc_id"]).count() == 0
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.predict(hard, none, ["doc_id"]).collect()} == {"und"}


# near duplicates


def _fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(hard):
    got = sorted(r["fp"] % 2**64 for r in simhash.fingerprints(hard).collect())
    assert got == sorted(_fingerprint(r[1]) for r in HARD)


def test_links_are_complete(spark, empty):
    rng = np.random.default_rng(2)
    prints = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    prints += [prints[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))]
    prints += [prints[1] ^ sum(1 << int(b) for b in rng.choice(64, 5, replace=False)) for _ in range(120)]
    prints += [p ^ 3 for p in prints[5:20]] + [0, 0, 1 << 63, prints[7]]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")).collect()}
    root = list(range(len(prints)))
    for _ in range(len(prints)):
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and root[j] != root[i]:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[r] == r for r in root) and all(root[i] == root[j] for i, a in enumerate(prints) for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2):
            break
    assert got == dict(enumerate(root))
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)]
    got = {r["a"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1400)}


def test_near_duplicates_edges(hard):
    got = simhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD)
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {1: 1, 2: 1, 7: 1}


# SentencePiece


def test_pieces_equal_the_library(spark, hard, empty):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_file("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    texts = [r[1] for r in HARD] + [" a  b\n\tc", "aaaa aaaaaaa", "<s> </s> <0x0A>", "1234567 12.5%%%", "Hello, world! int main() { return 0; }"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(docs, path).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t or "") for t in texts]
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(sentencepiece.encode(docs, path), path).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]
    assert sentencepiece.verified(hard, path).where("restored").count() == len(HARD) - 1  # the one with a space mark
    assert sentencepiece.verified(empty, path).count() == 0


def test_unigram_takes_the_best_sum():
    path = tokenizer_file("piece_bpe_32k.model")
    codec = sentencepiece.Codec(path, "unigram")

    def best(text):
        table = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            for start in range(end):
                i = codec._ids.get(text[start:end])
                if i is not None and start in table:
                    value = table[start][0] + codec._score[i]
                    if end not in table or value > table[end][0]:
                        table[end] = (value, [*table[start][1], i])
        return table[len(text)][0]

    for text in ("▁information", "▁unbelievable", "▁xyzzy"):
        assert sum(codec._score[i] for i in codec.segment(text)) == best(text)


# personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _base(text):
    out = [("email", *m.span()) for m in _EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


TRICKY = [
    "a@b.c_x@d.com a@b.cc@d.e x@y.z..w @q.r a@b", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.2.3 1.2.3.45.6", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 12",
    "+1 (988) 555-2485 +49 30 1234567 +1234 +12345678901234567 +1--5", "𝄞𝄞 me@x.org 日本 4111111111111111", "a" * 20_000 + "@b.com" + ".c" * 9_000, "1 " * 9_000 + "1.1.1.1",
    'password=b7db7aa4a5fcc78305 token = "1beb58b8af68854f0e01" (988) 555-2485 name (at) host (dot) com 123-45-6789', "", None,
]


def test_base_spans(spark, empty):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TRICKY)], "doc_id bigint, text string, kind string")
    for r in pii.report(docs).collect():
        spans = _base(TRICKY[r["doc_id"]] or "")
        text = ",".join("{}:{}:{}".format(*s) for s in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), TRICKY[r["doc_id"]][:60]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        own = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {(k, int(a), int(b)) for k, a, b in own} >= set(spans)
    assert pii.report(empty).count() == 0


def test_votes_decide(spark):
    cards = ["4111111111111111"] * 40 + [f"{n:016d}" for n in range(9_000_000_000_000_001, 9_000_000_000_000_200)]
    rows = [(i, f"number {c} here, token = \"1beb58b8af68854f0e0{i}\"") for i, c in enumerate(cards)]
    got = pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(("card" in r["spans"]) == (r["n_card"] > 0) and "secret" in r["spans"] for r in got)


def test_redaction(spark, hard):
    rows = [(1, "mail a@b.com or +1 (988) 555-2485.", 33), (2, "nothing here", 12), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [PHONE]." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "nothing here" and got[3]["text"] is None
    assert pii.redact(hard).columns == hard.columns and pii.redact(hard).count() == len(HARD)


def test_votes_give_the_posteriors_of_plain_em():
    """Expectation-maximisation over counts equals the same over single candidates, one by one."""
    counts = [("secret", (1, 0, 1, 0), 40), ("secret", (-1, 0, 1, 0), 25), ("secret", (-1, 1, 1, -1), 10), ("secret", (1, 1, 1, 0), 5)]
    prior, rates, soft = pii.reliabilities(counts)
    single = [("secret", v, 1) for _, v, n in counts for _ in range(n)]
    one, each, again = pii.reliabilities(single)
    assert prior["secret"] == pytest.approx(one["secret"]) and all(rates["secret"][i][k] == pytest.approx(x) for i in range(4) for k, x in each["secret"][i].items())
    assert {v: q for _, v, q in soft} == pytest.approx({v: q for _, v, q in again})
    assert soft[0][2] > 0.9 and soft[1][2] < 0.1 and all(0 < q < 1 for *_, q in soft)


def test_span_classifier_learns_from_the_span_and_its_context(spark):
    """Secrets and what only looks like one, told apart by shape and by the words before."""
    rows = [(i, f"please set api_key: Zk{i}9xQ4tLm{i}a8 now" if i % 2 else f"the token = something{'abcdefg'[i % 7]}else here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert all(("secret" in got[i]) == bool(i % 2) for i in range(200))
    seen = pii.features(pii.votes(pii.candidates(docs)[1]))
    model = pii.train(seen)
    p = {r["at"]: r["p"] for r in seen.groupBy((F.col("row") * 0 + F.length("match") * 0 + F.col("votes")[0]).alias("at")).agg(F.avg(model.probability(F.col("features"))).alias("p")).collect()}
    assert p[1] > 0.7 and p[-1] < 0.3
    weights = {name: w for name, w in enumerate(model.weights) if w}
    shapes = {tuple(r["features"]) for r in seen.select("features").distinct().collect()}
    assert len({f for x in shapes for f in x}) == len(weights)  # shape, length and context weigh too, not only votes
