"""Quality classifier: logistic regression over hashed word n-grams.

A text is split at white space.  Each token counts as its word (lower-cased, bare
of punctuation) and as its shape (runs of letters as ``A``, ``Aa`` or ``a``,
digits as ``9``, marks as they are); word uni- and bigrams and shape uni-, bi- and
trigrams are hashed to ``2**BITS`` weights.  A bigram of the same token twice is
one feature of its own, whatever the token.  Features are weighted by the share
of the text's n-grams of their kind, and the score is a sparse dot product.

Training is follow-the-regularised-leader with per-coordinate rates, over a
sample of at most ``max_rows`` labelled rows (chosen by a hash of the id; this
bound is the only sample here).  The driver reads their features row by row in each
pass, so it holds the weights and one row.  ``doc_id``, ``lang``, ``source`` and labels
are never features.

Defined cases: a null or empty text has no tokens and gets the score of the bias
alone; a null id is never held out; a label that is null teaches nothing; ids that
repeat teach once for each row and label; without labels every score is 0.5;
columns of other names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import Cache, discard, mapped, written

BITS = 18
FOLDS = 5
THRESHOLD = 0.3
MAX_ROWS = 6000

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_RUNS = re.compile(r"[^\W\d_]+|\d+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _shape_run(m: re.Match) -> str:
    run = m[0]
    if not run[0].isalpha():
        return "9"
    if run.islower() or not run[0].isupper():
        return "a"
    return "A" if run.isupper() and len(run) > 1 else "Aa"


def _hashes(token: str) -> int:
    """A word hash (low 32 bits) and a shape hash (high 32 bits)."""
    word = token.strip(_MARKS).lower() or token
    shape = _RUNS.sub(_shape_run, token)
    return xxhash.xxh32_intdigest(word.encode()) | xxhash.xxh32_intdigest(shape.encode(), 1) << 32


_TOKENS = Cache(200_000, _hashes)


def ngrams(text: str | None) -> list[np.ndarray]:
    """Hashed features of each kind, one entry for each n-gram."""
    tokens = text.split() if text else []
    if not tokens:
        return []
    _TOKENS.turn()
    both = np.array(list(map(_TOKENS.__getitem__, tokens)), np.uint64)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    shift = np.uint64(64 - BITS)
    kinds = [(word * _MIX[0] + np.uint64(1) * _MIX[2]) * _MIX[1] >> shift, (shape * _MIX[0] + np.uint64(2) * _MIX[2]) * _MIX[1] >> shift]
    if len(tokens) > 1:
        pair = word[:-1] * _MIX[0] + word[1:] * _MIX[2]
        pair[both[:-1] == both[1:]] = 0
        kinds.append((pair ^ (pair >> np.uint64(29))) * _MIX[1] >> shift)
        kinds.append((shape[:-1] * _MIX[1] + shape[1:] * _MIX[0]) * _MIX[2] >> shift)
    if len(tokens) > 2:
        kinds.append((shape[:-2] * _MIX[1] + shape[1:-1] * _MIX[0] + shape[2:] * _MIX[2]) * _MIX[0] >> shift)
    return kinds


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values."""
    kinds = ngrams(text)
    if not kinds:
        return np.empty(0, np.int64), np.empty(0)
    at, back = np.unique(np.concatenate(kinds).astype(np.int64), return_inverse=True)
    return at, np.bincount(back, np.concatenate([np.full(len(k), 1 / len(k)) for k in kinds]))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total = self.bias + sum(float(self.weights[k.astype(np.int64)].mean()) for k in ngrams(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


Example = tuple[np.ndarray, np.ndarray, int]


def train(rows: Callable[[], Iterable[Example]], epochs: int = 4, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.002, l2: float = 0.01) -> Model:
    """FTRL-proximal: ``z`` sums adjusted gradients, ``n`` their squares; ``rows`` gives all examples again."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for at, value, label in rows():
            at = np.append(at, size)
            value = np.append(value, 1.0)
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0.0)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ value)))))
            g = (p - label) * value
            z[at] += g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return Model(w[:size].astype(np.float32), float(w[size]))


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("i"), F.col(target).cast("int").alias("y")).where(~held_out(F.col("i")) & F.col("i").isNotNull() & F.col("y").isNotNull())
    # At most max_rows ids and labels: a proven bound for the broadcast.
    chosen = known.orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i").select("i", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["i", "y", "at", "value"],
            )

    order = (F.xxhash64("i"), F.col("i"), F.col("y"), F.col("at"))
    # An id may have many rows, so the bound holds again here.
    kept, path = written(mapped(texts, run, "i string, y int, at binary, value binary").orderBy(*order).limit(max_rows), "quality-rows")

    def examples() -> Iterator[Example]:
        for r in kept.orderBy(*order).toLocalIterator():
            yield np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4").astype(float), r.y

    model = train(examples)
    discard(docs.sparkSession, path)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["i", "score"])

    out = mapped(rows, run, f"i {rows.schema['i'].dataType.simpleString()}, score double")
    return out.select(F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([held.value.score(t.as_py()) >= THRESHOLD for t in batch.column(at)], pa.bool_()))

    return mapped(docs, run, docs.schema)
