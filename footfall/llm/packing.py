"""Best-fit packing of token ids into sequences of a fixed capacity, improved by exchanges between sequences.

A task tokenises its documents and packs them in groups of up to `group_tokens` ids and GROUP_PIECES pieces, so ids are
written once, in the sequence that holds them, and are not shuffled. In a group every piece first goes to the fullest
sequence that it fits. Then the least filled sequence gives what it holds to others: pieces that fit move, one piece
goes for a smaller one, two for one, one for two, whenever that raises the sum of squared fills; a sequence that is
empty goes. The search ends when no fewer sequences are possible or nothing helps.

Sequences that a group leaves with a sixteenth of their capacity or more are pooled, POOL of all groups at a time, and
packed alike. After that only those filled to half or less go on, of which a pool has one at most, as two would have
been joined: their number falls by that factor each round until one is left, and no pool holds more than a few times
POOL of them.

Defined results: a null text is empty and a document without ids is its end id alone; only documents longer than the
capacity are cut, into pieces of just the capacity and a last one that may be shorter; rows that repeat or have no id
are documents of their own; other columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import small_batches, stored
from footfall.llm.hashing import SPACE, runs

CAPACITY = 4096
GROUP_PIECES = 1 << 16
POOL = 256
RUN_BYTES = 1 << 22  # of text that is cut at once
SEQUENCE = "sequence_id long, left_over boolean, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, lengths array<int>, ids binary"


_ODD, _LETTER, _DIGIT, _MARK = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = _MARK
    kind[48:58] = _DIGIT
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[ord("'")] = _ODD  # contractions
    lower[65:91] += 32
    return kind, lower


_KIND, _LOWER = _tables()


class WordEncoder:
    """Ids of whole texts by a `tokenizers` model whose pre-tokens never hold white space.

    Texts are cut at ASCII white space, Arrow finds the different words, and the library encodes each of these once;
    the memory of them is emptied when it is full. Where the tokenizer lower-cases and tells letters, digits and marks
    apart, plain words are lower-cased and cut there too. With any other tokenizer texts go to the library whole.
    """

    def __init__(self, tokenizer_path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._most = most
        state = json.loads(self._tokenizer.to_str())
        self.by_word = _cuts_at_space(state)
        self._finer = self.by_word and _cuts_kinds(state)
        self._added = [x["content"].lower().encode() for x in state["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._ids, self._held = np.zeros(1 << 16, np.uint32), 0
        self._start, self._length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            got = self._encode([w.decode() for w in part])
            flat, lengths = np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
            n = len(self._known)
            while n + len(part) > len(self._start):
                self._start, self._length = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._length))
            while self._held + len(flat) > len(self._ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            self._length[n : n + len(part)] = lengths
            self._start[n : n + len(part)] = self._held + np.cumsum(lengths) - lengths
            self._ids[self._held : self._held + len(flat)] = flat
            self._held += len(flat)
            self._known.update(zip(part, range(n, n + len(part)), strict=True))

    @staticmethod
    def _turns(data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words of nothing but letters up to U+00FF, digits and ASCII marks go from one to another."""
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        word = np.cumsum(first > 0, dtype=np.int32)
        plain = np.ones(int(word[-1]) + 1, bool)
        plain[word[(kind == _ODD) & ~SPACE[data]]] = False
        turn = np.zeros(len(data), bool)
        turn[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        return np.flatnonzero(turn & ~SPACE[data] & (first == 0) & plain[word])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has."""
        if not self.by_word:
            got = self._encode(texts)
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.fromiter(map(len, got), np.int64, len(got))
        if len(self._known) > self._most:
            self._forget()
        raw = [t.encode() for t in texts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        whole = b" ".join(raw) + b" "
        data = np.frombuffer(whole, np.uint8)
        first = np.diff((~SPACE[data]).astype(np.int8), prepend=np.int8(0))  # 1 where words begin, -1 after them
        if not (first > 0).any():
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self._finer and not any(x in whole.lower() for x in self._added):
            data = _LOWER[data]
            first[self._turns(data, first)] = 1
        edges = np.flatnonzero(first)
        own = np.flatnonzero(first[edges] > 0)
        begins = edges[own]
        every = pa.Array.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(np.append(edges, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = every.take(pa.array(own)).dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn([w for w in different if w not in self._known])
        number = np.fromiter(map(self._known.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        lengths = self._length[number]
        total = np.cumsum(lengths)
        ids = self._ids[np.repeat(self._start[number] - (total - lengths), lengths) + np.arange(total[-1])]
        upto = np.r_[0, total][np.searchsorted(begins, ends)]
        return ids, np.diff(upto, prepend=0)


def _cuts_at_space(state: dict) -> bool:
    """Whether words between ASCII white space can be encoded by themselves."""
    steps = state["normalizer"] or {}
    steps = steps.get("normalizers", [steps]) if steps else []
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    cuts = state["pre_tokenizer"] or {}
    first = (cuts.get("pretokenizers") or [cuts])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ").replace(r"[^\s", "")
    solid = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and not any(x in pattern for x in (r"\s", " ", ".", "[^", r"\P", r"\W"))
    added = all(not x["lstrip"] and not x["rstrip"] and not any(c.isspace() for c in x["content"]) for x in state["added_tokens"])
    return bool(plain and solid and added and not state.get("post_processor"))


#: Fixed value: how a tokenizer cuts that takes contractions, runs of letters, single digits and runs of marks.
_KINDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_kinds(state: dict) -> bool:
    """Whether letters lose their case, and pre-tokens end where letters, digits and marks meet."""
    lowers = any(s["type"] == "Lowercase" for s in state["normalizer"].get("normalizers", [])) if state["normalizer"] else False
    cuts = state["pre_tokenizer"].get("pretokenizers", [])
    return lowers and bool(cuts) and cuts[0].get("pattern") == {"Regex": _KINDS} and all(c["type"] == "ByteLevel" and not c["use_regex"] and not c["add_prefix_space"] for c in cuts[1:])


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_path: str) -> WordEncoder:
    """One for each Python worker, kept over its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(tokenizer_path)


# packing


def fewest(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins.

    For each k up to half the capacity: pieces above capacity - k meet no piece of k or more, so what the pieces from k to
    half take beyond the room that the other pieces above half leave needs bins of its own.
    """
    ordered = np.sort(np.asarray(sizes, np.int64))[::-1]
    if not len(ordered):
        return 0
    sums = np.r_[0, np.cumsum(ordered)]

    def above(x: int) -> int:
        return int(np.searchsorted(-ordered, -x, side="left"))

    half = above(capacity // 2)
    best = max(half, -(-int(sums[-1]) // capacity))
    for k in np.unique(ordered[ordered * 2 <= capacity]).tolist():
        alone, upto = above(capacity - k), above(k - 1)
        room = (half - alone) * capacity - int(sums[half] - sums[alone])
        best = max(best, half + max(0, -(-(int(sums[upto] - sums[half]) - room) // capacity)))
    return best


class Bins:
    """Pieces in bins of one capacity, and the moves that bring them closer together."""

    def __init__(self, sizes: np.ndarray, capacity: int = CAPACITY):
        self.size, self.capacity = np.asarray(sizes, np.int64), capacity
        self.of = np.zeros(len(self.size), np.int64)
        self.held: list[list[int]] = []
        self.fill = np.zeros(0, np.int64)
        self.steps = 0
        self._twos: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._best_fit()

    def _best_fit(self) -> None:
        """Every piece, in the order given, to the fullest bin that it fits."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms, fill = 0, []  # a bit for every room that some bin has
        for i, s in enumerate(self.size.tolist()):
            fits = rooms >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                self.held[b].append(i)
                fill[b] += s
            else:
                b, room = len(fill), self.capacity
                self.held.append([i])
                fill.append(s)
            self.of[i] = b
            if room > s:
                by_room[room - s].append(b)
                rooms |= 1 << (room - s)
        self.fill = np.array(fill, np.int64)

    def count(self) -> int:
        return int((self.fill > 0).sum())

    def squared(self) -> int:
        return int((self.fill**2).sum())

    def _put(self, i: int, b: int) -> None:
        a, s = int(self.of[i]), self.size[i]
        self.held[a].remove(i)
        self.held[b].append(i)
        self.fill[a] -= s
        self.fill[b] += s
        self.of[i] = b
        self._twos.pop(a, None)
        self._twos.pop(b, None)

    def search(self, passes: int = 8) -> Bins:
        """Exchanges until no fewer bins are possible, none helps, or all bins have been gone through so often."""
        least = fewest(self.size, self.capacity)
        for _ in range(passes):
            before = self.squared()
            for a in np.argsort(self.fill, kind="stable").tolist():
                if self.count() <= least:
                    return self
                if 0 < self.fill[a] < self.capacity:
                    self._empty(a)
            if self.squared() == before:
                break
        return self

    def _empty(self, a: int) -> None:
        """Bin `a` gives away what it can; every step raises the sum of squared fills."""
        others = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        others = others[others != a]
        if not len(others):
            return
        items = np.concatenate([np.array(self.held[b], np.int64) for b in others])
        while self.held[a]:
            own = sorted(self.held[a], key=lambda i: -self.size[i])
            if not (self._move(own, a, others) or self._one_for_one(own, a, items) or self._two_for_one(own, a, items) or self._one_for_two(own, a, others)):
                return
            self.steps += 1
            items = np.concatenate([items[self.of[items] != a], np.array([i for i in own if self.of[i] != a], np.int64)])

    def _move(self, own: list[int], a: int, others: np.ndarray) -> bool:
        fill = self.fill[others]
        for i in own:
            s = self.size[i]
            fits = np.where((self.capacity - fill >= s) & (fill + s > self.fill[a]), fill, -1)
            b = int(fits.argmax())
            if fits[b] >= 0:
                self._put(i, int(others[b]))
                return True
        return False

    def _gainful(self, given: int, taken: np.ndarray, bins: np.ndarray, a: int) -> int:
        """The best exchange of `given` tokens of bin a for `taken` of others, or -1.

        With d tokens more in the other bin B, the squares gain 2 d (B - A + d).
        """
        d = given - taken
        gain = np.where((d > 0) & (d <= self.capacity - self.fill[bins]), d * (self.fill[bins] - self.fill[a] + d), 0)
        best = int(gain.argmax()) if len(gain) else -1
        return best if best >= 0 and gain[best] > 0 else -1

    def _one_for_one(self, own: list[int], a: int, items: np.ndarray) -> bool:
        sizes, bins = self.size[items], self.of[items]
        for s, i in {int(self.size[i]): i for i in own}.items():
            at = self._gainful(s, sizes, bins, a)
            if at >= 0:
                b = int(bins[at])
                self._put(int(items[at]), a)
                self._put(i, b)
                return True
        return False

    def _two_for_one(self, own: list[int], a: int, items: np.ndarray) -> bool:
        sizes, bins = self.size[items], self.of[items]
        one, other = self._two(a)
        for s, (i, j) in {int(self.size[i] + self.size[j]): (int(i), int(j)) for i, j in zip(one, other, strict=True)}.items():
            at = self._gainful(s, sizes, bins, a)
            if at >= 0:
                b = int(bins[at])
                self._put(int(items[at]), a)
                self._put(i, b)
                self._put(j, b)
                return True
        return False

    def _two(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces of a bin, one for each two sizes: at most some 4,000 whatever it holds."""
        if b not in self._twos:
            held = np.array(self.held[b], np.int64)
            held = held[np.argsort(self.size[held], kind="stable")]
            size = self.size[held]
            first = np.flatnonzero(np.diff(size, prepend=-1))
            again = first[:-1][np.diff(first) > 1] if len(first) > 1 else first[:0]
            if len(first) and first[-1] < len(held) - 1:
                again = np.append(again, first[-1])
            x, y = np.triu_indices(len(first), 1)
            self._twos[b] = np.concatenate([held[first[x]], held[again]]), np.concatenate([held[first[y]], held[again + 1]])
        return self._twos[b]

    def _one_for_two(self, own: list[int], a: int, others: np.ndarray) -> bool:
        pairs = [self._two(int(b)) for b in others]
        one, other = (np.concatenate(x) for x in zip(*pairs, strict=True))
        sizes, bins = self.size[one] + self.size[other], self.of[one]
        for s, i in {int(self.size[i]): i for i in own}.items():
            at = self._gainful(s, sizes, bins, a)
            if at >= 0:
                b = int(bins[at])
                self._put(int(one[at]), a)
                self._put(int(other[at]), a)
                self._put(i, b)
                return True
        return False


def packed(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of the pieces of each bin.

    Best fit in the order of arrival and the exchanges; where more bins are left than there must be, the same from the
    largest piece down, and the fewer of the two.
    """
    sizes = np.asarray(sizes, np.int64)
    bins = Bins(sizes, capacity).search()
    order = np.arange(len(sizes))
    if bins.count() > fewest(sizes, capacity):
        down = np.argsort(-sizes, kind="stable")
        other = Bins(sizes[down], capacity).search()
        if other.count() < bins.count():
            bins, order = other, down
    return [order[own].tolist() for own in bins.held if own]


# sequences

_ARROW = pa.schema(
    [("sequence_id", pa.int64()), ("left_over", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
     ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())]
)


def _sequences(pieces: list[tuple], capacity: int, base: int, dtype: str, most: int) -> dict[str, list]:
    """The sequences of a group of pieces (doc_id, piece, start, ids), numbered from `base`; those with up to `most` ids
    are left over."""
    out: dict[str, list] = {name: [] for name in _ARROW.names}
    for n, own in enumerate(packed(np.fromiter((len(p[3]) for p in pieces), np.int64, len(pieces)), capacity)):
        held = [pieces[i] for i in own]
        out["sequence_id"].append(base + n)
        out["left_over"].append(sum(len(p[3]) for p in held) <= most)
        for column, k in (("doc_ids", 0), ("pieces", 1), ("starts", 2)):
            out[column].append([p[k] for p in held])
        out["lengths"].append([len(p[3]) for p in held])
        out["ids"].append(np.concatenate([p[3] for p in held]).astype(dtype).tobytes())
    return out


def _packer(tokenizer_path: str, end_id: int, capacity: int, group_tokens: int, dtype: str) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, base = _encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        pieces, held = [], 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for run in runs(pc.binary_length(texts).to_numpy(), RUN_BYTES):
                got, sizes = encoder(texts[run].to_pylist())
                got = np.insert(got, np.cumsum(sizes), end_id).astype(dtype)
                for doc_id, own in zip(doc_ids[run], np.split(got, np.cumsum(sizes + 1)[:-1]), strict=True):
                    for start in range(0, len(own), capacity):
                        pieces.append((doc_id, start // capacity, start, own[start : start + capacity]))
                        held += len(pieces[-1][3])
                        if held >= group_tokens or len(pieces) >= GROUP_PIECES:
                            yield pa.RecordBatch.from_pydict(_sequences(pieces, capacity, base, dtype, capacity * 15 // 16), _ARROW)
                            pieces, held, base = [], 0, base + GROUP_PIECES
        if pieces:
            yield pa.RecordBatch.from_pydict(_sequences(pieces, capacity, base, dtype, capacity * 15 // 16), _ARROW)

    return pack


def _pooler(first: int, capacity: int, dtype: str) -> Callable:
    def pooled(rows: pa.Table) -> pa.Table:
        """What the sequences of one pool hold, packed anew."""
        pieces = []
        for r in rows.sort_by("sequence_id").to_pylist():
            ids, at = np.frombuffer(r["ids"], dtype), 0
            for doc_id, piece, start, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"], strict=True):
                pieces.append((doc_id, piece, start, ids[at : at + n]))
                at += n
        return pa.Table.from_pydict(_sequences(pieces, capacity, first + (rows["pool"][0].as_py() << 28), dtype, capacity // 2), _ARROW)

    return pooled


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, group_tokens: int = 1 << 22, pool: int = POOL) -> DataFrame:
    """Written sequences of `docs` (doc_id, text): sequence_id, left_over, doc_ids, pieces, starts, lengths, ids.

    The four arrays have an element for each piece, in its order in the sequence; `ids` are all their ids on end, 16 bits
    each where the vocabulary allows, else 32 (see `ids_of`).
    """
    dtype = _dtype(tokenizer_path)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(rows.mapInArrow(_packer(tokenizer_path, end_id, capacity, group_tokens, dtype), SEQUENCE), "sequences")
    done, turn = found.where("not left_over"), 0
    while (n := found.where("left_over").count()) > 1:
        turn += 1
        number = F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(-(-n // pool))).alias("pool")
        found = stored(found.where("left_over").select("*", number).groupBy("pool").applyInArrow(_pooler(turn << 58, capacity, dtype), SEQUENCE), "pooled")
        done = done.union(found.where("not left_over"))
    return done.union(found.where("left_over"))


def _dtype(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def _placed(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
    for batch in batches:
        rows = []
        for name, doc_ids, pieces, starts, lengths, ids in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            flat, at = np.frombuffer(ids, dtype).astype("<u4"), 0
            for doc_id, piece, start, n in zip(doc_ids, pieces, starts, lengths, strict=True):
                rows.append((doc_id, piece, start, n, zlib.crc32(flat[at : at + n].tobytes()), name, at))
                at += n
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def placements(sequences: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, from the sequences' bytes."""
    run = functools.partial(_placed, dtype=_dtype(tokenizer_path))
    columns = ("sequence_id", "doc_ids", "pieces", "starts", "lengths", "ids")
    return sequences.select(*columns).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def ids_of(sequences: DataFrame, tokenizer_path: str) -> DataFrame:
    """(sequence_id, ids array<bigint>)."""
    dtype = _dtype(tokenizer_path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, dtype).astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "ids"])

    return sequences.select("sequence_id", "ids").mapInArrow(read, "sequence_id long, ids array<bigint>")
