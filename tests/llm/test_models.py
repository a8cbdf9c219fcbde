"""Learning rules against plain versions of them, one number at a time."""

import math

import numpy as np
import pytest

from footfall.llm import langid, quality


def test_ftrl_equals_its_definition():
    """Follow-the-regularised-leader, each coordinate by itself."""
    rng = np.random.default_rng(3)
    learner = quality.Learner(alpha=0.3, beta=1.0, l1=0.01, l2=0.002)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.01:
            return 0.0
        return -(z[i] - math.copysign(0.01, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.002)

    for _ in range(200):
        at = np.unique(rng.integers(0, 40, 6))
        value, label = rng.random(len(at)), float(rng.random() < 0.4)
        learner.learn(at, value, label)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, value, strict=True))))
        old = {i: weight(i) for i in at}
        for i, v in zip(at, value, strict=True):
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.3 * old[i]
            n[i] = n.get(i, 0.0) + g * g
    got = learner.weights()
    assert [got[i] for i in range(40)] == pytest.approx([weight(i) for i in range(40)])


def _shares(counts, likelihood, penalty=4.0, rounds=8):
    """Expectation-maximisation and the penalised choice of languages for one text, in loops."""
    languages = range(likelihood.shape[1])

    def climb(share, times):
        total = sum(counts.values())
        for _ in range(times):
            mass = [0.0] * len(share)
            for b, n in counts.items():
                parts = [likelihood[b, j] * share[j] for j in languages]
                for j in languages:
                    mass[j] += n * parts[j] / sum(parts)
            share = [m / total for m in mass]
        return share, sum(n * math.log(sum(likelihood[b, j] * share[j] for j in languages)) for b, n in counts.items())

    alone = [sum(n * math.log(likelihood[b, j]) for b, n in counts.items()) for j in languages]
    best = max(languages, key=lambda j: alone[j])
    chosen, value = [float(j == best) for j in languages], alone[best]
    share, _ = climb([1 / len(languages)] * len(languages), rounds)
    order = sorted(languages, key=lambda j: -share[j])
    if sorted(share)[-2] > 0.02:
        for k in range(2, len(languages) + 1):
            cut = [share[j] if j in order[:k] else 0.0 for j in languages]
            tried, fit = climb([c / sum(cut) for c in cut], rounds // 2)
            worth = fit - penalty * math.log(max(sum(counts.values()), 2)) * (k - 1)
            if worth <= value:
                break
            chosen, value = tried, worth
    return chosen


def test_mixtures_equal_plain_expectation_maximisation():
    rng = np.random.default_rng(4)
    counts = np.zeros((3, langid.BUCKETS))
    for j in range(3):
        counts[j, rng.integers(0, 60, 400) + 40 * j] += 5
    model = langid.Model(["a", "b", "c"], counts)
    owner, bucket = [], []
    for text, mix in enumerate(([1, 0, 0], [0.6, 0.4, 0], [0.1, 0.1, 0.8], [0.34, 0.33, 0.33], [0, 0.9, 0.1])):
        of = rng.choice(3, 300, p=mix)
        owner += [text] * 300
        bucket += list(rng.integers(0, 60, 300) + 40 * of)
    got = langid.mixtures(np.array(owner), np.array(bucket), model, 6)
    for text in range(5):
        own = {}
        for o, b in zip(owner, bucket, strict=True):
            if o == text:
                own[b] = own.get(b, 0) + 1
        assert got[text] == pytest.approx(_shares(own, model.likelihood), abs=1e-9)
    assert not got[5].any()


def test_trigrams_of_long_texts_are_those_of_the_whole(monkeypatch):
    def counted(text):
        return sum(np.bincount(langid._trigrams(own)[1], minlength=langid.BUCKETS) for _, own in langid.grouped([text]))

    texts = ["".join(np.random.default_rng(i).choice(list("ab c-. é"), 700)) for i in range(4)] + ["", "a", "ab "]
    whole = [counted(t) for t in texts]
    monkeypatch.setattr(langid, "_PIECE", 17)
    for t, want in zip(texts, whole, strict=True):
        assert (counted(t) == want).all()


def test_pieces_of_unseen_words():
    """What is remembered of parts costs the collector of cycles nothing, and the ids are the library's."""
    import gc
    import random

    from sentencepiece import SentencePieceProcessor

    from footfall.llm import sentencepiece
    from footfall.llm.queries import tokenizer_file

    path, rng = tokenizer_file("piece_bpe_32k.model"), random.Random(9)
    text = " ".join("".join(rng.choices(("th", "er", "on", "è", "an", "ti", "re", "é", "œ", "st"), k=rng.randrange(1, 7))) + rng.choice(("", ",", "漢,", ".")) for _ in range(3000))
    codec, model = sentencepiece.Codec(path), SentencePieceProcessor(model_file=path)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == model.encode(text)
    assert codec._parts and not any(map(gc.is_tracked, codec._parts.values()))
    assert all(codec.merged(codec.pieces[i]) == [i] for i, n in codec._automaton.values() if n > 1)


def test_a_worker_remembers_few_parts():
    """However many different parts a text has, the memory stays within twice its bound, and the ids are the library's."""
    from sentencepiece import SentencePieceProcessor

    from footfall.llm import sentencepiece
    from footfall.llm.queries import tokenizer_file

    path = tokenizer_file("piece_bpe_32k.model")
    codec, model = sentencepiece.Codec(path, most=20), SentencePieceProcessor(model_file=path)
    text = " ".join(f"often w{i}漢{i * 7}, again w{i // 9}" for i in range(500))
    for _ in range(2):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == model.encode(text)
        assert 20 <= len(codec._known) <= 40 and len(codec._parts) <= 40
