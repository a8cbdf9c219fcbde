"""Vectorised hashing of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that products keep every bit of what they hash
_PIECE = 1 << 20


def _classes() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    kind = np.arange(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = ord("a")
    kind[128:] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return space, kind


SPACE, KIND = _classes()


def runs(sizes: Iterable[int], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about `most` in all, so that memory follows neither the number nor the sizes of texts in a batch."""
    begun, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        held += int(size)
        if held >= most:
            yield slice(begun, i + 1)
            begun, held = i + 1, 0
    if begun <= i:
        yield slice(begun, i + 1)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values so that their high bits depend on all of them."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64((salt * _BASE) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        return h * np.uint64(0xC4CEB9FE1A85EC53)


def _summed(values: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run that begins at one of `starts`; place: position of each value in its run."""
    powers = np.empty(int(place.max()) + 1, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        for done in (1 << k for k in range(len(powers).bit_length())):
            if done < len(powers):
                step = np.uint64(pow(_BASE, done, 2**64))
                powers[done : 2 * done] = powers[: len(powers[done : 2 * done])] * step
        return np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[place], starts)


def _word_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    kept = np.flatnonzero(solid)
    letters, starts = data[kept], np.flatnonzero(first[kept])
    place = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
    words = _summed(letters, place, starts)
    kinds = KIND[letters]
    turns = np.ones(len(kinds), bool)
    turns[1:] = kinds[1:] != kinds[:-1]
    turns[starts] = True
    kinds, begun = kinds[turns], (place == 0)[turns]
    starts = np.flatnonzero(begun)
    place = np.arange(len(kinds)) - np.repeat(starts, np.diff(np.append(starts, len(kinds))))
    return at, words, _summed(kinds, place, starts)


def words_and_shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word hash and shape hash of every word.

    A shape is the word's run of character kinds: `THEA,!!` has the shape `A,!`. The joined texts are
    hashed in pieces of about 1 MB that end between words, so memory does not follow a text's length.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gaps, found, at = None, [], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        if stop < len(data):
            near = np.flatnonzero(SPACE[data[at:stop]])
            if len(near):
                stop = at + int(near[-1]) + 1
            else:
                gaps = np.flatnonzero(SPACE[data]) if gaps is None else gaps
                stop = int(gaps[np.searchsorted(gaps, stop)]) + 1
        where, words, shapes = _word_piece(data[at:stop])
        found.append((where + at, words, shapes))
        at = stop
    where, words, shapes = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.searchsorted(np.cumsum(sizes), where, side="right"), words, shapes
