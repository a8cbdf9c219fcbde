"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all ordinary pieces. Reading a text once, it names at each position every piece that ends
there (its state's own piece and those along its output links); each relaxes the best segmentation up to that
position by the one up to the piece's start.

What is best depends on the model. For a unigram model it is the highest sum of scores. For a BPE model sums of
scores do not give what merging gives; there a piece may follow another only if merging their joined characters
yields just these two, which leaves one segmentation, the one that merging gives. Pieces that do not merge to
themselves take no part.

Texts are cut where no piece reaches across, found from the neighbouring characters of all pieces, so each
different part is segmented once and remembered. When the memory is full, what was not asked for since it was last
full goes and the rest stays, so that a worker, which keeps it for all later tasks, holds little.

Defined results: null and empty texts have no ids; characters without a piece become byte pieces, or the unknown
id in a model without them; decoding gives back the text where the normaliser changes nothing, but that a space
mark (U+2581) in a text comes back as a space, as it does from the library; rows that repeat are encoded each; a
null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import small_batches

SPACE = "▁"


class Memory:
    """What was asked for last: `most` keys at least once they have come, twice as many at most.

    `new` is for reading only: whoever looks a key up there first spares most calls.
    """

    def __init__(self, most: int):
        self._most = most
        self.new: dict[str, bytes] = {}  # bytes, which the collector of cycles need not look at
        self._old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.new) + len(self._old)

    def values(self) -> list[bytes]:
        return [*self.new.values(), *self._old.values()]

    def older(self, key: str) -> bytes | None:
        """The value of a key that is not in `new`, kept for longer now."""
        got = self._old.pop(key, None)
        return None if got is None else self.keep(key, got)

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self.new) >= self._most:
            self.new, self._old = {}, self.new
        self.new[key] = value
        return value


class Codec:
    def __init__(self, model_file: str, kind: str = "bpe", most: int = 50_000, most_meets: int = 300_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model: {kind}")
        self.unknown, self._bpe, self._most_meets = model.unk_id(), kind == "bpe", most_meets
        self._prefix = model.normalize("a") == SPACE + "a"
        # whether the normaliser does nothing but mark spaces: letters it might compose, fold or widen come back
        probe = " a  b ﬁ Å ① ｶ İ e\u0301 "
        self._plain = model.normalize(probe) == SPACE * self._prefix + probe.replace(" ", SPACE)
        self._normalize = model.normalize
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self._score = [model.get_score(i) for i in range(len(self.pieces))]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(len(self.pieces))]
        self._ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self._bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self._text = [b"" if s else p.replace(SPACE, " ").encode() for p, s in zip(self.pieces, special, strict=True)]
        for value, i in self._bytes.items():
            self._text[i] = bytes([value])
        self._inside = {p[i : i + 2] for p in self._ids for i in range(len(p) - 1)}
        self._automaton = ahocorasick.Automaton()
        for p, i in self._ids.items():
            if not self._bpe or len(p) == 1 or self.merged(p) == [i]:  # what does not merge to itself takes no part
                self._automaton.add_word(p, (i, len(p)))
        self._automaton.make_automaton()
        self._known, self._parts = Memory(most), Memory(most)
        self._meets: dict[int, bool] = {}  # of two pieces, the left one times the number of pieces and the right one

    def merged(self, text: str) -> list[int]:
        """Byte-pair merging, the best scored pair first and the leftmost of equals."""
        own = list(text)
        while True:
            best, at = None, -1
            for i in range(len(own) - 1):
                piece = self._ids.get(own[i] + own[i + 1])
                if piece is not None and (best is None or self._score[piece] > best):
                    best, at = self._score[piece], i
            if at < 0:
                return [self._ids.get(x, -1) for x in own]
            own[at : at + 2] = [own[at] + own[at + 1]]

    def _follows(self, left: int, right: int) -> bool:
        if len(self._meets) > self._most_meets:
            self._meets.clear()
        got = self._meets[left * len(self.pieces) + right] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return got

    def _spelled(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        return [self._bytes[b] for b in raw] if len(self._bytes) == 256 else [self.unknown]

    def segment(self, part: str) -> list[int]:
        """Ids of a part that no piece reaches out of: one pass of the automaton."""
        n = len(part)
        last = self._by_merging(part, n) if self._bpe else self._by_score(part, n)
        if last[n] is None:  # a character without a piece
            return [i for x in part for i in ([self._ids[x]] if x in self._ids else self._spelled(x))]
        out, at = [], n
        while at:
            piece, length = last[at]
            out.append(piece)
            at -= length
        return out[::-1]

    def _by_merging(self, part: str, n: int) -> list[tuple[int, int] | None]:
        """The piece by which each position is reached, with its length: the one that may follow the piece before."""
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        meets, many = self._meets, len(self.pieces)
        for end, found in self._automaton.iter(part):
            stop = end + 1
            if last[stop] is not None:
                continue
            if start := stop - found[1]:
                if (before := last[start]) is None:
                    continue
                if (follows := meets.get(before[0] * many + found[0])) is None:
                    follows = self._follows(before[0], found[0])
                if not follows:
                    continue
            last[stop] = found
        return last

    def _by_score(self, part: str, n: int) -> list[tuple[int, int] | None]:
        """The same by the highest sum of scores."""
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        value = [0.0] * (n + 1)
        for end, (piece, length) in self._automaton.iter(part):
            start, stop = end + 1 - length, end + 1
            if start and last[start] is None:
                continue
            if last[stop] is None or value[start] + self._score[piece] > value[stop]:
                last[stop], value[stop] = (piece, length), value[start] + self._score[piece]
        return last

    def _packed(self, part: str) -> bytes:
        ids = self.segment(part)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of(self, chunk: str) -> bytes:
        inside, parts = self._inside, self._parts
        cuts = [i for i, x in enumerate(map(add, chunk, chunk[1:]), 1) if x not in inside]
        if not cuts:
            return self._packed(chunk)
        out, begun = [], 0
        for i in (*cuts, len(chunk)):
            part = chunk[begun:i]
            if (got := parts.new.get(part)) is None and (got := parts.older(part)) is None:
                got = parts.keep(part, self._packed(part))
            out.append(got)
            begun = i
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        line = (SPACE * self._prefix + text.replace(" ", SPACE)) if self._plain else self._normalize(text)
        known, out = self._known, []
        for chunk in _CHUNKS.findall(line):
            if (got := known.new.get(chunk)) is None and (got := known.older(chunk)) is None:
                got = known.keep(chunk, self._of(chunk))
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self._text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self._prefix and text.startswith(" ") else text


#: Pieces hold the space mark at their start or alone, so a run of marks begins a chunk.
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@functools.lru_cache(maxsize=2)
def codec(model_file: str, kind: str) -> Codec:
    """One for each Python worker, kept over its tasks."""
    return Codec(model_file, kind)


def encode(docs: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file, kind)
        for batch in batches:
            ids = [np.frombuffer(own.encode(x.as_py()), "<u4") for x in batch.column(1)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), flat)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file, kind)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def verified(docs: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, restored): each row encoded, decoded again and compared with its text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file, kind)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            raw = [own.encode(t) for t in texts]
            same = [own.decode(np.frombuffer(r, "<u4")) == t for r, t in zip(raw, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(same)],
                names=["doc_id", "n_pieces", "ids_crc32", "restored"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, restored boolean"
    )
