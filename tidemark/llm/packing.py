"""Vector bin packing of tokenised documents into training sequences.

An item is the part of a document that does not fill whole sequences.  Items and open sequences are vectors of tokens,
segments and loss-bearing tokens; an item goes to the open sequence that it fits in all three and whose free room has
the largest dot product with it (the dot-product heuristic).  If it fits in none and no more sequences may be open, the
item is cut to top up the fullest one, so closed sequences are full unless the segment or loss limit binds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SEGMENTS = 512
END_ID = 1
#: Sequences that a task holds open at once.
OPEN = 64


@lru_cache(maxsize=4)
def whole(path: str):
    """The tokenizers file's own tokenizer; loaded where a text needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """text -> ids that tokenizers gives for the byte-level BPE file at path with add_special_tokens=False.

    Texts that hold the string of one of the file's added tokens go to tokenizers itself.  All others are plain byte-level
    BPE, whose merges run in tiktoken on the same vocabulary (identical ids, tested, in less than half the time).
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    vocab, added = known["model"]["vocab"], [t["content"] for t in known["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and t not in added}
    encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> list[int]:
        return whole(path).encode(text, add_special_tokens=False).ids if any(a in text for a in added) else encode(text)

    return ids


def _bearing(start: int, n: int, bears: int) -> int:
    """How many of the n tokens from start bear loss, where those from bears on do."""
    return max(0, start + n - max(start, bears))


class Packer:
    """Packs items; emit(segments) is called once for each closed sequence with its (item, start, length) segments."""

    def __init__(self, emit: Callable[[list[tuple]], None], capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, open_: int = OPEN):
        self.emit, self.room = emit, np.array([capacity, segments, capacity if loss is None else loss], np.float64)
        if (self.room < 1).any():
            raise ValueError("each limit must be 1 at least")
        self.capacity, self.most = capacity, open_
        self.free = np.zeros((open_, 3))
        self.bins: list[list[tuple]] = []

    def _close(self, k: int) -> None:
        self.emit([s[:3] for s in self.bins[k]])
        last = len(self.bins) - 1
        self.bins[k], self.free[k] = self.bins[last], self.free[last]
        self.bins.pop()

    def _put(self, k: int, item: object, start: int, n: int, bears: int) -> None:
        self.bins[k].append((item, start, n, bears))
        self.free[k] -= (n, 1, _bearing(start, n, bears))
        if self.free[k][0] <= 0 or self.free[k][1] <= 0:
            self._close(k)

    @staticmethod
    def _part(room: np.ndarray, start: int, n: int, bears: int) -> int:
        """The most of an item's next n tokens that the room of a sequence takes."""
        return int(min(n, room[0], max(0, bears - start) + room[2])) if room[1] >= 1 else 0

    def add(self, item: object, start: int, n: int, bears: int = 0) -> None:
        """An item of n tokens from start; those from bears on bear loss."""
        while n:
            need = np.array([n, 1, _bearing(start, n, bears)], np.float64)
            free = self.free[: len(self.bins)]
            fits = (free >= need).all(1)
            if n < self.capacity and fits.any():
                score = np.where(fits, (free / self.room) @ (need / self.room), -1.0)
                return self._put(int(score.argmax()), item, start, n, bears)
            if len(self.bins) < self.most:
                self.free[len(self.bins)] = self.room
                self.bins.append([])
                if (need <= self.room).all():
                    return self._put(len(self.bins) - 1, item, start, n, bears)
                free = self.free[: len(self.bins)]
            k = int(np.argmin(free[:, 0]))
            part = self._part(self.free[k], start, n, bears)
            if part <= 0:
                self._close(k)
                continue
            self._put(k, item, start, part, bears)
            start, n = start + part, n - part

    def finish(self) -> None:
        """Pours the open sequences together, under the same three limits.

        Sequences are full while tokens last and then of powers of two; only where the segment or the loss limit binds
        is one closed before it is full.
        """
        left = sorted((s for b in self.bins for s in b), key=lambda s: -s[2])[::-1]
        self.bins = []
        total = sum(s[2] for s in left)
        while total:
            size = min(self.capacity, 1 << total.bit_length() - 1) if total < self.capacity else self.capacity
            out: list[tuple] = []
            room = np.array([size, *self.room[1:]])
            while left:
                item, start, n, bears = left[-1]
                part = self._part(room, start, n, bears)
                if part <= 0:
                    break
                out.append((item, start, part))
                room -= (part, 1, _bearing(start, part, bears))
                total -= part
                left.pop()
                if part < n:
                    left.append((item, start + part, n - part, bears))
            self.emit(out)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, with_ids: bool = True, prompt_col: str | None = None) -> DataFrame:
    """A row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if with_ids, ids.

    A sequence holds at most capacity tokens, segments pieces and loss (None: capacity) tokens that bear loss.  Those are
    a document's tokens from the one that prompt_col counts to (instruction data; null or no such column: all of them).
    Each task packs its own rows as they come and holds a bounded number of open sequences; there is no shuffle, and
    a task that is run again on the same rows makes the same pieces.  Null text: an empty one (one piece of the end id
    alone).  Null or repeated ids are carried along; each row is packed once, alike rows into pieces of their own.  Of
    open sequences that fit equally well the one opened first is taken.  A very long text fills sequences of its own
    before its rest is packed.  Empty table: no rows.  Other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer_path)
        ctx = TaskContext.get()
        sequence = (ctx.partitionId() if ctx else 0) << 40
        rows: list[tuple] = []

        def emit(segments_: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for (doc, ids, whole, bears), start, n in segments_:
                piece = ids[start - whole : start - whole + n]
                rows.append((doc, start, n, zlib.crc32(piece.tobytes()), whole + len(ids), sequence, at, _bearing(start, n, bears), piece.view(np.int32)))
                at += n
            sequence += 1

        packer = Packer(emit, capacity, segments, loss)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"][: 8 + with_ids]

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                arrays.append(pa.array(cols[8], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text, bears in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                bears = min(max(bears or 0, 0), len(ids))
                whole = len(ids) // capacity * capacity if loss is None or loss >= capacity else 0
                for i in range(0, whole, capacity):
                    emit([((doc, ids, 0, bears), i, capacity)])
                if n := len(ids) - whole:
                    packer.add((doc, ids[whole:].copy(), whole, bears), whole, n, bears)
            if rows:
                yield flush(id_type)
        packer.finish()
        if rows:
            yield flush(id_type)

    bears = F.col(prompt_col).cast("long") if prompt_col else F.lit(0).cast("long")
    return docs.select(F.col(id_col), F.col(text_col), bears.alias("bears")).mapInArrow(run, schema)
