"""Benchmark decontamination by Wu-Manber search over words.

Every item of the benchmark becomes windows of ``width`` consecutive words (an
item with fewer words, but not none, is one window).  Windows of one length form
a searcher: a shift table over hashed blocks of two words tells how far the search
may move on, a zero shift leads to the bucket of windows with that suffix block, and
word-by-word comparison confirms an occurrence.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: a null text has no words and is clean; rows that repeat are
answered alike; null ``item_id`` counts as an item of that (null) id and is left
out of ``items_sha256``; an empty benchmark finds nothing; an empty table gives
an empty result; columns of other names don't matter.

Scale: the benchmark is streamed to the driver in blocks of at most ``block_words``
words, longer items in overlapping parts; a block's tables take less than 200 bytes a
word, whatever the words are, and only one block is in memory at a time.  With one block, the
usual case, documents are scanned once, without a shuffle.  More blocks are one pass
over the documents each; only hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import mapped, written

WIDTH = 10
BLOCK_WORDS = 1 << 18
_SPREAD = 0x9E3779B1

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit to a space.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_FOLD).split()


class Searcher:
    """Wu-Manber tables for windows of one length, in words.

    ``size`` is the window length, ``block`` the words that a shift looks at: two, or
    one for windows of a single word.  Windows are slices of ``words``, the numbers of
    all words of the items in a row, four bytes each.  The shift table is addressed by
    a hash of a block; where two blocks meet, the smaller shift stands.  The distinct
    windows of a suffix bucket are sorted, so that a bucket of any size is searched by
    a few comparisons.
    """

    def __init__(self, size: int, words: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> None:
        self.size, self.block = size, min(2, size)
        self.words = words.astype(">i4").tobytes()
        bits = max(10, int(len(starts) * 8 - 1).bit_length())
        self.mask = (1 << bits) - 1
        rows = words[starts[:, None] + np.arange(size)]
        self.shift = np.full(self.mask + 1, size - self.block + 1, np.uint8 if size < 256 else np.int64)
        for end in range(self.block, size + 1):
            np.minimum.at(self.shift, self._keys(rows[:, end - self.block : end]), size - end)
        distinct, first, same = np.unique(np.ascontiguousarray(rows.astype(">i4")).view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        key = self._keys(rows[first, size - self.block :])
        order = np.argsort(key, kind="stable")  # inside a bucket the windows stay sorted
        self.starts = starts[first[order]]
        self.suffixes, self.heads = np.unique(key[order], return_index=True)
        self.heads = np.append(self.heads, len(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[same.ravel()], numbers], axis=1), axis=0)
        self.items = pairs[:, 1]
        self.item_heads = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))

    def _keys(self, blocks: np.ndarray) -> np.ndarray:
        at = blocks[:, -1].astype(np.int64)
        return (at + blocks[:, 0].astype(np.int64) * _SPREAD if self.block == 2 else at) & self.mask

    def occurrences(self, words: list[bytes], number: Callable[[bytes, int], int]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of every occurrence in a text, in order; ``number`` gives a word's number, 0 if no item has it."""
        size, n, mask, two = self.size, len(words), self.mask, self.block == 2
        shift = memoryview(self.shift)
        end = size
        while end <= n:
            last = number(words[end - 1], 0)
            if not last:  # no window holds this word
                end += size
                continue
            key = (last + number(words[end - 2], 0) * _SPREAD if two else last) & mask
            step = shift[key]
            if step:
                end += step
                continue
            found = self._window(key, np.array([number(w, 0) for w in words[end - size : end]], ">i4").tobytes())
            if found is not None:
                yield end - size, self.items[self.item_heads[found] : self.item_heads[found + 1]].tolist()
            end += 1

    def _window(self, key: int, wanted: bytes) -> int | None:
        at = int(np.searchsorted(self.suffixes, key))
        if at == len(self.suffixes) or self.suffixes[at] != key:
            return None
        low, high = int(self.heads[at]), int(self.heads[at + 1])
        while low < high:
            middle = (low + high) // 2
            start = 4 * int(self.starts[middle])
            held = self.words[start : start + len(wanted)]
            if held == wanted:
                return middle
            low, high = (middle + 1, high) if held < wanted else (low, middle)
        return None


@dataclass
class Block:
    """A part of the benchmark: the items' ids, the numbers of their words, a searcher for each window length."""

    ids: list
    vocabulary: dict[bytes, int]
    searchers: list[Searcher]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Starts and ends of the occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for s in self.searchers:
            for start, items in s.occurrences(words, self.vocabulary.get):
                spans.append((start, start + s.size))
                found.update(items)
        return spans, found


def block_of(items: list[tuple[object, list[bytes]]], width: int = WIDTH) -> Block:
    """The tables of ``items``: ids and words.  An item that was cut stands there in parts."""
    ids: dict = {}
    vocabulary: dict[bytes, int] = {}
    words: list[int] = []
    starts: dict[int, list[np.ndarray]] = {}
    numbers: dict[int, list[np.ndarray]] = {}
    for item, own in items:
        number = ids.setdefault(item, len(ids))
        size = min(width, len(own))
        if size:
            starts.setdefault(size, []).append(np.arange(len(words), len(words) + len(own) - size + 1))
            numbers.setdefault(size, []).append(np.full(len(own) - size + 1, number))
            words += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own]  # 0: a word of no item
    every = np.array(words, np.int32)
    return Block(list(ids), vocabulary, [Searcher(size, every, np.concatenate(starts[size]), np.concatenate(numbers[size])) for size in sorted(starts)])


def item_blocks(benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_words`` words, one at a time.

    A longer item is cut in parts that overlap, so that each window lies in one.
    """
    held: list[tuple[object, list[bytes]]] = []
    used = 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row.t)
        step = max(1, block_words - width + 1)
        for at in range(0, max(1, len(words) - width + 1), step):
            part = words[at : at + step + width - 1]
            if held and used + len(part) + 1 > block_words:
                yield block_of(held, width)
                held, used = [], 0
            held.append((row.i, part))
            used += len(part) + 1
    if held:
        yield block_of(held, width)


def _judged(rows: DataFrame, block: Block) -> DataFrame:
    """``rows`` without ``t``, with ``n_words``, the hit ``spans`` and the ids of the ``items`` found.

    A span is its start, shifted by 32 bits, and its end.
    """
    held = rows.sparkSession.sparkContext.broadcast(block)
    own = [c for c in rows.columns if c != "t"]
    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = [], [], []
            for t in batch.column("t").to_pylist():
                words = words_of(t)
                hit, found = held.value.hits(words)
                n.append(len(words))
                spans.append([start << 32 | end for start, end in hit])
                items.append([None if (i := held.value.ids[k]) is None else str(i) for k in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*own, "n_words", "spans", "items"],
            )

    return mapped(rows, run, f"{fields}n_words long, spans array<long>, items array<string>")


def _covered(spans: Column) -> Column:
    """Words in any of the spans."""

    def step(done: Column, span: Column) -> Column:
        start, end = F.shiftright(span, 32), span.bitwiseAND(F.lit(0xFFFFFFFF))
        more = F.greatest(end - F.greatest(start, done["last"]), F.lit(0).cast("long"))
        return F.struct((done["total"] + more).alias("total"), F.greatest(end, done["last"]).alias("last"))

    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))
    return F.aggregate(F.sort_array(spans), none, step)["total"]


def _found(rows: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """``i, n_words, spans, items`` of rows ``i, t`` over all blocks."""
    first = next(blocks, None) or block_of([])
    second = next(blocks, None)
    if second is None:
        return _judged(rows, first)
    # Blocks are passes of their own, so that a worker holds one block's tables.
    numbered, _ = written(rows.withColumn("rid", F.monotonically_increasing_id()), "bench-rows", compressed=True)
    parts = [written(_judged(numbered.select("rid", "t"), b).where(F.size("spans") > 0).drop("n_words"), "bench-hits")[0] for b in chain([first, second], blocks)]
    every = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = _judged(numbered, block_of([])).select("rid", "i", "n_words")
    return counted.join(every, "rid", "left").select(
        "i", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    found = _found(rows, item_blocks(benchmark, width, block_words))
    named = F.array_join(F.sort_array(F.filter("items", lambda i: i.isNotNull())), ",")
    return found.select(
        F.col("i").alias(id_col), "n_words", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any occurrence, columns unchanged."""
    at = docs.columns.index(text_col)

    def clean(held) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not held.value.hits(words_of(t))[0] for t in texts], pa.bool_()))

        return mapped(docs, run, docs.schema)

    blocks = item_blocks(benchmark, width, block_words)
    block = next(blocks, None)
    while block is not None:
        held = docs.sparkSession.sparkContext.broadcast(block)
        docs, block = clean(held), next(blocks, None)
        if block is not None:
            docs, _ = written(docs, "bench-clean", compressed=True)
    return docs
