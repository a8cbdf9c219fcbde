"""Best-fit packing against the tokenizer itself and against exhaustive search on small cases."""

import itertools
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from footfall.llm import packing
from footfall.llm.queries import tokenizer_file

TOKENIZER = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    "It's DON'T café étude", "<|endoftext|>x <|startoftext|>", " á ́b ΟΔΟΣ", "\x0b\x0c\r\n  ", "", "日本 x y 𝄞𝄞 1234 ½", "İstanbul ǅ ﬁ", "a\x1cb\x1fc\x85d", "Straße12,b×c÷d e=\u0338f A\u0301b 'S ''t x'Ll <|ENDOFTEXT|> ½²a___b--\x01",
    " ".join(f"word{i % 977}" for i in range(9000)), None,
]


def test_words_give_whole_text_ids():
    encoder, plain = packing.WordEncoder(TOKENIZER, most=5), Tokenizer.from_file(TOKENIZER)
    assert encoder.by_word
    for part in (TEXTS[:3], TEXTS[3:5], TEXTS[5:9], TEXTS[8:9], TEXTS[8:10], TEXTS[:10]):  # the memory is emptied in between
        ids, sizes = encoder(part)
        got = np.split(ids, np.cumsum(sizes)[:-1])
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_other_tokenizers_go_whole(tmp_path):
    assert not packing.WordEncoder(tokenizer_file("byte_bpe_50k.json")).by_word
    state = json.loads(open(TOKENIZER).read())
    state["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(state))
    other = packing.WordEncoder(str(tmp_path / "t.json"))
    ids, sizes = other(["a  <|startoftext|> b", ""])
    assert not other.by_word and sizes[1] == 0 and ids.tolist() == other._tokenizer.encode("a  <|startoftext|> b", add_special_tokens=False).ids


def _least(sizes, capacity):
    """The fewest bins by trying all ways."""
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                put(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_search_against_all_packings(sizes):
    least = _least(sorted(sizes, reverse=True), 20)
    assert packing.fewest(np.array(sizes), 20) <= least <= len(packing.packed(np.array(sizes), 20)) <= least + 1


@pytest.mark.parametrize(("sizes", "capacity", "bins"), [
    ([6, 6, 5, 5, 3, 5], 10, 4),
    ([5, 7, 3, 5, 6, 4], 10, 3),  # one for one
    ([8, 3, 3, 2, 2, 2], 10, 2),
    ([4, 4, 4, 6, 6, 6], 10, 3),
])
def test_exchanges_reach_the_best(sizes, capacity, bins):
    assert len(packing.packed(np.array(sizes), capacity)) == bins == _least(sizes, capacity)


def test_every_step_raises_the_squares(monkeypatch):
    rng = np.random.default_rng(5)
    bins, seen = packing.Bins(rng.integers(500, 3000, 300)), []
    for name in ("_move", "_one_for_one", "_two_for_one", "_one_for_two"):
        plain = getattr(packing.Bins, name)

        def tried(self, *args, plain=plain, name=name):
            before = self.squared()
            done = plain(self, *args)
            assert (self.squared() > before) == done and self.fill.max() <= self.capacity
            seen.append((name, done))
            return done

        monkeypatch.setattr(packing.Bins, name, tried)
    first = bins.count()
    bins.search()
    assert bins.count() < first and {n for n, done in seen if done} == {"_move", "_one_for_one", "_two_for_one", "_one_for_two"}
    assert sorted(itertools.chain.from_iterable(bins.held)) == list(range(300))


SCHEMA = "doc_id bigint, text string, piece string, start string, ids string, sequence_id string"


def test_sequences_hold_every_document(spark):
    rows = [(i, t, "x", "x", "x", "x") for i, t in enumerate(TEXTS)] + [(None, "none", "", "", "", ""), (0, TEXTS[0], "", "", "", "")]
    rows += [(100 + i, " ".join(["tree"] * (i * 37 % 900)), "", "", "", "") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    sequences = packing.pack(docs, TOKENIZER, capacity=512, group_tokens=4000, pool=20)
    plain = Tokenizer.from_file(TOKENIZER)
    whole = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in rows]
    want = sorted((-1 if r[0] is None else r[0], k // 512, k, len(x[k : k + 512]), zlib.crc32(x[k : k + 512].tobytes())) for r, x in zip(rows, whole, strict=True) for k in range(0, len(x), 512))
    got = packing.placements(sequences, TOKENIZER).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 512
    total = sum(map(len, whole))
    assert len(held) <= 1.05 * (total // 512)  # though a group here has but eight sequences
    read = {r["sequence_id"]: r["ids"] for r in packing.ids_of(sequences, TOKENIZER).collect()}
    assert {k: len(v) for k, v in read.items()} == {k: sum(n for _, n in own) for k, own in held.items()}
    assert sequences.where("left_over").count() <= 1


def test_no_rows_and_one(spark):
    docs = spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA)
    assert packing.placements(packing.pack(docs.limit(0), TOKENIZER), TOKENIZER).count() == 0
    assert [tuple(r)[:4] for r in packing.placements(packing.pack(docs, TOKENIZER), TOKENIZER).collect()] == [(1, 0, 0, 1)]
