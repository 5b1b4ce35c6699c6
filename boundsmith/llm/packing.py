"""Packing documents into fixed windows by minimum bin slack.

A document is its token ids and an end id.  Whole windows of a long document are
sequences of their own; its remainder joins a pool.  For each next window the
longest remainder is fixed, and a bitset dynamic programme over the lengths in
the pool (a Python integer whose bit s says that sum s can be reached) finds the
multiset of lengths that comes closest to the capacity; backtracking gives how
often each length is taken, and the same multiset is used as often as the pool
allows.  A slack that no multiset fills is filled by cutting a remainder.  What a
task has left in the end, less than a window, is cut at powers of two, where no
padding is needed.

Defined cases: a null or empty text is the end id alone; rows that repeat are
packed each; columns of other names don't matter; an empty table gives an empty
result.  Memory: ids of about ``buffer_tokens`` tokens and the longest document.
No shuffle: each task packs its own rows, and the pool that a buffer leaves is
carried into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import mapped
from boundsmith.llm.tokens import encoder

WINDOW = 1024
BUFFER_TOKENS = 2 << 20


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths in ``counts`` with the largest sum within ``capacity``.

    Long lengths are offered first and the search ends once the sum is exact.
    """
    mask = (1 << (capacity + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if 0 < n <= capacity), reverse=True):
        left = min(counts[length], capacity // length)
        many = 1
        while left > 0:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (many * length)) & mask
            left -= many
            many *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + many
            total -= length * many
    return taken


class Packer:
    """Packs pieces ``(document number, start, length)`` into windows."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.pool: dict[int, list[tuple[int, int]]] = {}
        self.tokens = 0
        self.sequences = 0
        self.placed: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int, length: int) -> None:
        at = 0
        while length - at >= self.window:
            self._place([(doc, at, self.window)])
            at += self.window
        if at < length:
            self.pool.setdefault(length - at, []).append((doc, at))
            self.tokens += length - at

    def _place(self, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.placed.append((doc, start, length, self.sequences, offset))
            offset += length
        self.sequences += 1

    def _take(self, length: int) -> tuple[int, int, int]:
        held = self.pool[length]
        doc, start = held.pop()
        if not held:
            del self.pool[length]
        self.tokens -= length
        return doc, start, length

    def _take_cut(self, size: int) -> tuple[int, int, int]:
        """``size`` tokens of the shortest remainder that has more."""
        doc, start, length = self._take(min(n for n in self.pool if n > size))
        self.pool.setdefault(length - size, []).append((doc, start + size))
        self.tokens += length - size
        return doc, start, size

    def fill(self) -> None:
        """Full windows, as long as the pool holds one."""
        while self.tokens >= self.window:
            first = max(self.pool)
            counts = {n: len(held) for n, held in self.pool.items()}
            counts[first] -= 1
            taken = best_fill(counts, self.window - first)
            taken[first] = taken.get(first, 0) + 1
            slack = self.window - sum(n * many for n, many in taken.items())
            times = 1 if slack else min(len(self.pool[n]) // many for n, many in taken.items())
            for _ in range(times):
                pieces = [self._take(n) for n, many in taken.items() for _ in range(many)]
                while slack:
                    longer = any(n > slack for n in self.pool)
                    piece = self._take_cut(slack) if longer else self._take(max(self.pool))
                    pieces.append(piece)
                    slack -= piece[2]
                self._place(pieces)

    def finish(self) -> None:
        """What is left goes to sequences whose lengths are powers of two."""
        self.fill()
        while self.tokens:
            size = 1 << (self.tokens.bit_length() - 1)
            pieces = []
            while size:
                whole = [n for n in self.pool if n <= size]
                pieces.append(self._take(max(whole)) if whole else self._take_cut(size))
                size -= pieces[-1][2]
            self._place(pieces)

    def open_docs(self) -> set[int]:
        return {doc for held in self.pool.values() for doc, _ in held}


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"`{id_col}` {rows.schema['i'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        high = TaskContext.get().partitionId() << 33
        packer = Packer(window)
        held: dict[int, tuple[object, bytes]] = {}
        buffered, number, kind = 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            placed, packer.placed = packer.placed, []
            for at in range(0, len(placed), 4000):
                part = placed[at : at + 4000]
                own = [held[p[0]] for p in part]
                columns = [pa.array([o[0] for o in own], kind)]
                for values in (
                    [p[1] for p in part],
                    [p[2] for p in part],
                    [len(o[1]) // 4 for o in own],
                    [high + p[3] for p in part],
                    [p[4] for p in part],
                ):
                    columns.append(pa.array(values, pa.int64()))
                columns.append(pa.array([o[1][4 * p[1] : 4 * (p[1] + p[2])] for o, p in zip(own, part, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            still = packer.open_docs()
            for n in [n for n in held if n not in still]:
                del held[n]

        for batch in batches:
            kind = batch.column(0).type
            ids = batch.column(0).to_pylist()
            for row_id, tokens in zip(ids, encoder(tokenizer).encode(batch.column(1)), strict=True):
                held[number] = (row_id, tokens + end)
                packer.add(number, len(tokens) // 4 + 1)
                buffered += len(tokens) // 4 + 1
                number += 1
                if buffered >= buffer_tokens:
                    packer.fill()
                    yield from flush()
                    buffered = 0
        packer.finish()
        if kind is not None:
            yield from flush()

    return mapped(rows, run, schema)
