"""Codes of parts against nearest entries by plain arithmetic."""

import hashlib

import numpy as np
import pytest

from footfall.llm import partcodes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, dim string, x string"


def _plain(rows, rounds=4):
    """(code, error) of each row and the entries, by Python integers."""
    whole = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v, *_ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))
    w = len(whole[0]) // 4
    part = [[x[p * w : p * w + w] for x in whole] for p in range(4)]
    books = [[part[p][i] for i in order[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            held = {}
            for x in part[p]:
                held.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    found = [[nearest(part[p][i], books[p]) for p in range(4)] for i in range(len(rows))]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


def _rows(n=420, dim=12):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((n, dim)) * 4) / 1024 + rng.integers(0, 3, (n, 1)) / 8  # few values, so prefixes are shared
    x[50:90] = x[50]
    return [(i * 3 if i != 7 else None, x[i].tolist(), None if i % 5 == 0 else int(i % 3), "clash", "", "") for i in range(n)]


def test_codes_equal_plain_arithmetic(spark):
    rows = _rows() + [(5, None, 1, "", "", ""), (6, [float("nan")] * 12, 1, "", "", ""), (8, [None] * 12, 1, "", "", ""), (9, [float("inf")] * 12, 1, "", "", ""), (10, [1.0] * 6, 1, "", "", "")]
    got = partcodes.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    kept = rows[:420]
    codes, books = _plain(kept)
    by_label = {}
    for r, (_, e) in zip(kept, codes, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = ",".join(str(c) for b in books for e in b for c in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    want = sorted((r[0] or -1, c, e, by_label[r[2]], digest) for r, (c, e) in zip(kept, codes, strict=True))
    assert sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


@pytest.mark.parametrize("leaves", [3, 64, 10_000])
def test_the_walk_shares_prefixes(monkeypatch, leaves):
    monkeypatch.setattr(partcodes, "_LEAVES", leaves)
    rng = np.random.default_rng(1)
    parts, entries = rng.integers(-3, 4, (3000, 6)), rng.integers(-3, 4, (40, 6))
    own, place, count = partcodes.distinct(parts)
    assert own.tolist() == sorted(map(list, set(map(tuple, parts.tolist())))) and (own[place] == parts).all() and count.sum() == 3000
    trie = partcodes.Trie(own, entries).walk()
    away = ((own[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (trie.nearest == away.argmin(axis=1)).all() and (trie.distance == away.min(axis=1)).all()
    prefixes = sum(len(set(map(tuple, own[:, : j + 1].tolist()))) for j in range(6))
    assert trie.nodes == prefixes < 0.85 * own.size  # each prefix once


@pytest.mark.parametrize("size", [1, 10**5, 2**31, 2**40])
def test_exact_at_any_size(size):
    rng = np.random.default_rng(3)
    parts, entries = (rng.integers(-9, 10, (n, 4)).astype(object) * size for n in (50, 7))
    if size < 2**31:
        parts, entries = parts.astype(np.int64), entries.astype(np.int64)
    own, place, _ = partcodes.distinct(parts)
    trie = partcodes.Trie(own, entries).walk()
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(entries)) for x in parts]
    assert [(int(trie.distance[i]), int(trie.nearest[i])) for i in place] == want


def test_lengths_and_edges(spark):
    rows = [(1, [0.5, 0.25, -0.1, 0.0], 1, "", "", ""), (1, [0.5, 0.25, -0.1, 0.0], None, "", "", ""), (2, [], 1, "", "", ""), (3, [0.1] * 8, 1, "", "", "")]
    got = {(r["vec_id"], r["label_error"]): (r["code"], r["error"]) for r in partcodes.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0): ("00000000", 0), (2, 0): ("00000000", 0), (3, 0): ("00000000", 0)}
    assert partcodes.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoded_is_near(spark):
    rows = spark.createDataFrame(_rows()[:200], SCHEMA)  # fewer than the entries, so every vector is one
    codes, books = partcodes.compress(rows)
    back = partcodes.decoded(codes, books).collect()
    given = {r[0]: r[1] for r in _rows()[:200]}
    assert all(np.abs(np.array(r["vector"]) - np.array(given[r["vec_id"]])).max() <= 1 / 1024 for r in back)
