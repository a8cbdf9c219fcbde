"""Token-id files in patched frame-of-reference (PFOR) blocks.

Ids are cut into blocks of 128. A block stores its minimum, the differences from it packed at a width that
covers a chosen percentile of them, and the values that do not fit as an exception list (position, high bits).
An index of block starts precedes the blocks, so one block can be decoded without the others.

A segment holds the ids of whole consecutive documents and is one row of a Parquet file: Parquet is only the
container that every store Spark writes to can hold, the ids are in the binary column `payload`.

Defined results: a null text is the empty text; an empty document is its end id alone; null ids sort first;
rows that repeat a doc_id are kept, in the order of their text's hash and text; other columns are ignored; an
empty table gives no segments and no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import shuffle_width, small_batches, stored
from footfall.llm.hashing import runs

BLOCK = 128
LANES = 4
_ROWS = BLOCK // LANES
_HEAD = 6  # minimum (4 bytes), width, number of exceptions
_EXCEPTION = 5  # position, high bits (4 bytes)
RUN_BYTES = 1 << 22  # of text that is cut at once

SEGMENT_SCHEMA = (
    "part int, segment int, first long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2**width as (blocks, 4 * width) words; the four lanes are packed alike."""
    v = values.reshape(-1, _ROWS, LANES)
    out = np.zeros((len(v), width, LANES), np.uint32)
    for k in range(_ROWS):
        word, shift = divmod(k * width, 32)
        out[:, word] |= v[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, k] >> np.uint32(32 - shift)
    return out.reshape(len(v), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(-1, width, LANES)
    out = np.zeros((len(w), _ROWS, LANES), np.uint32)
    mask = np.uint32(2**width - 1)
    for k in range(_ROWS):
        word, shift = divmod(k * width, 32)
        got = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            got = got | (w[:, word + 1] << np.uint32(32 - shift))
        out[:, k] = got & mask
    return out.reshape(len(w), BLOCK)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_ids(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """PFOR bytes of unsigned 32-bit ids: count, number of blocks, block starts, blocks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.array([0, 0, 0], "<u4").tobytes()
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    small = delta.astype(np.uint16) if delta.max() < 1 << 16 else delta
    width = _bit_length(np.sort(small, axis=1)[:, rank])
    rows, cols = np.nonzero(delta > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None])
    exceptions = np.bincount(rows, minlength=blocks)
    sizes = _HEAD + 16 * width + _EXCEPTION * exceptions
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    body = np.zeros(starts[-1], np.uint8)
    body[starts[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    body[starts[:-1] + 4] = width
    body[starts[:-1] + 5] = exceptions
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = _pack(delta[own] & np.uint32(2 ** int(w) - 1), int(w)).astype("<u4")
            body[starts[own, None] + _HEAD + np.arange(16 * w)] = packed.view(np.uint8).reshape(len(own), -1)
    if len(rows):
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = starts[rows] + _HEAD + 16 * width[rows]
        body[at + nth] = cols
        high = (delta[rows, cols].astype(np.uint64) >> width[rows].astype(np.uint64)).astype("<u4")
        body[(at + exceptions[rows] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    head = np.concatenate([[len(ids), blocks], starts]).astype("<u4")
    return head.tobytes() + body.tobytes()


def decode_ids(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks first_block to last_block (exclusive; all by default) of `encode_ids` bytes."""
    total, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    index = np.frombuffer(payload, "<u4", blocks + 1, 8).astype(np.int64)
    stop = blocks if last_block is None else min(last_block, blocks)
    if first_block >= stop:
        return np.zeros(0, np.uint32)
    body = np.frombuffer(payload, np.uint8, offset=8 + 4 * (blocks + 1))
    starts = index[first_block:stop]
    low = body[starts[:, None] + np.arange(4)].view("<u4").reshape(-1)
    width, exceptions = body[starts + 4].astype(np.int64), body[starts + 5].astype(np.int64)
    grid = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = np.ascontiguousarray(body[starts[own, None] + _HEAD + np.arange(16 * w)])
            grid[own] = _unpack(packed.view("<u4").astype(np.uint32), int(w))
    if exceptions.sum():
        rows = np.repeat(np.arange(len(starts)), exceptions)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = starts[rows] + _HEAD + 16 * width[rows]
        cols = body[at + nth]
        high = np.ascontiguousarray(body[(at + exceptions[rows] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        grid[rows, cols] |= (high.astype(np.uint64) << width[rows].astype(np.uint64)).astype(np.uint32)
    flat = (grid + low[:, None]).reshape(-1)
    return flat[: total - first_block * BLOCK] if stop == blocks else flat


_LETTER, _DIGIT, _MARK, _SPACE, _LINE = range(1, 6)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """By byte: its kind (0: none of these), and whether a space before it begins a pre-token."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = _MARK
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[ord("'")] = 0  # contractions
    kind[32], kind[10] = _SPACE, _LINE
    opens = np.zeros(256, bool)
    opens[33:127] = True
    opens[0xC3:] = True
    opens[[0xE1, 0xE2, 0xE3]] = False  # first bytes of white space beyond ASCII, as 0xC2 is
    return kind, opens


_KIND, _OPENS = _byte_kinds()
_SOLID = (_KIND > 0) & (_KIND <= _MARK)
_TOGETHER = 200  # pieces in one string


class PieceEncoder:
    """Ids of whole texts by a byte-level BPE of the `tokenizers` library, a run of texts at a time.

    Such a tokenizer never joins text across a space that a non-space follows, so a run is cut there. A piece of
    letters up to U+00FF, digits, ASCII punctuation but the apostrophe and single line ends is cut again where these
    meet, which is where the pre-tokenizer cuts. Cuts are found for all bytes at once, Arrow finds the different
    pieces, and the library encodes each of these once; the memory of them is emptied when it is full. Texts with an
    added token in them, and all texts of a tokenizer that cuts in another way, go to the library whole.
    """

    def __init__(self, tokenizer_path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        state = json.loads(self._tokenizer.to_str())
        cuts = state["pre_tokenizer"] or {}
        self._known_cuts = state["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space")
        self._added = [x["content"] for x in state["added_tokens"]]
        names = map(self._tokenizer.id_to_token, range(self._tokenizer.get_vocab_size()))
        self._spelled = np.array([len(x or "") for x in names], np.int64)  # one character for each byte
        self._most = most
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._ids, self._held = np.zeros(1 << 16, np.uint32), 0
        self._start, self._length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces on end and how many each has, encoded many in one string.

        Each follows `before`, which the pre-tokenizer cuts off; ids spell bytes, so their lengths say where pieces end.
        """
        strings = [b"".join(before + p for p in pieces[i : i + _TOGETHER]).decode() for i in range(0, len(pieces), _TOGETHER)]
        got = [x.ids for x in self._tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(before))
        upto = np.r_[0, np.searchsorted(np.cumsum(self._spelled[flat]), ends, side="right")]
        if before:
            flat = np.delete(flat, upto[:-1])
            upto = upto - np.arange(len(upto))
        return flat, np.diff(upto)

    def _learn(self, pieces: list[bytes]) -> None:
        groups: tuple[list[bytes], ...] = ([], [], [])  # after a space; after a line end; by themselves
        for p in pieces:
            groups[0 if p[0] == 32 and len(p) > 1 and _OPENS[p[1]] else 1 if _SOLID[p[0]] else 2].append(p)
        for own, before in zip(groups, (b"", b"\n", None), strict=True):
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                if before is None:
                    got = self._whole([p.decode() for p in part])
                    flat, lengths = np.concatenate(got), np.array([len(x) for x in got], np.int64)
                else:
                    flat, lengths = self._joined(part, before)
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
    def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin; ends: where texts end."""
        firsts = np.r_[0, ends[:-1]]
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        solid = (kind > 0) & (kind <= _MARK)
        first = np.zeros(len(data), bool)
        first[:-1] = (data[:-1] == 32) & _OPENS[data[1:]]
        first[ends[ends > firsts] - 1] = False
        odd = (kind == 0) | ((kind == _SPACE) & ~first)
        lines = np.flatnonzero(kind == _LINE)
        inner = np.ones(len(data), bool)
        inner[firsts[ends > firsts]] = inner[ends[ends > firsts] - 1] = False
        lines = lines[~(inner[lines] & solid[lines - 1] & solid[np.minimum(lines + 1, len(data) - 1)])]
        odd[lines] = True
        first[firsts[ends > firsts]] = True
        piece = np.cumsum(first, dtype=np.int32)
        plain = np.ones(int(piece[-1]) + 1, bool)
        plain[piece[odd]] = False
        turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        turns = turns[(kind[turns - 1] != _SPACE) & plain[piece[turns]]]
        first[turns] = True
        return np.flatnonzero(first)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        if self._known_cuts:
            for x in self._added:
                special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not self._known_cuts or special.any():
            got = [self._whole([t.as_py()])[0] if s or not self._known_cuts else self(texts[i : i + 1])[0] for i, (t, s) in enumerate(zip(texts, special, strict=True))]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        if len(self._known) > self._most:
            self._forget()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = (offsets[1:] - offsets[0]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = self._cuts(data, ends)
        places = np.append(begins, len(data)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cut.dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn([x for x in different if x not in self._known])
        number = np.fromiter(map(self._known.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        lengths = self._length[number]
        total = np.cumsum(lengths)
        ids = self._ids[np.repeat(self._start[number] - (total - lengths), lengths) + np.arange(total[-1])]
        upto = np.r_[0, total][np.searchsorted(begins, ends)]
        return ids, np.diff(upto, prepend=0)


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_path: str) -> PieceEncoder:
    """One for each Python worker, kept over its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(tokenizer_path)


def _writer(tokenizer_path: str, end_id: int, segment_ids: int, percentile: float) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        schema = pa.schema(
            [("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
             ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
        )
        segment, first, held, ids, lengths, docs = 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            payload = encode_ids(np.concatenate(ids), percentile)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": segment, "first": first, "n_ids": held, "doc_ids": docs, "lengths": lengths, "payload": payload}], schema
            )

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for run in runs(pc.binary_length(texts).fill_null(0).to_numpy(), RUN_BYTES):
                got, sizes = encoder(texts[run])
                for doc_id, own in zip(names[run], np.split(got, np.cumsum(sizes)[:-1]), strict=True):
                    ids += [own, end]
                    docs.append(doc_id)
                    lengths.append(len(own) + 1)
                    held += lengths[-1]
                    if held >= segment_ids:
                        yield flush()
                        segment, first, held, ids, lengths, docs = segment + 1, first + held, 0, [], [], []
        if docs:
            yield flush()

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = 1 << 17, percentile: float = 0.9) -> DataFrame:
    """Encode `docs` (doc_id, text) and write the segments in ascending doc_id order; the written segments.

    The only shuffle deals texts out by ranges of doc_id, so every file and segment covers one range. Segments
    close at `segment_ids` ids, never inside a document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(shuffle_width(spark), *order[:2]).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(_writer(tokenizer_path, end_id, segment_ids, percentile), SEGMENT_SCHEMA), "tokens")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row["payload"]).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(lengths, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                 pa.array(row["first"] + ends - lengths, pa.int64()), pa.array(lengths), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row["payload"]).astype(np.int64)
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"])


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, ids array<bigint>) of every document in the segments."""
    return segments.select("doc_ids", "lengths", "payload").mapInArrow(_ids, "doc_id long, ids array<bigint>")


def index_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the segments' bytes.

    A document's start is its place in its part plus the ids of the parts before it; there is one total for
    each part that the writer dealt, so that table is as small as the number of its tasks.
    """
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = segments.select("part", "first", "doc_ids", "lengths", "payload").mapInArrow(
        _documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return docs.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
