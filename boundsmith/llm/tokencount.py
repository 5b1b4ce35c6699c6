"""Token counts under a unigram vocabulary, without building the tokens.

The registered query takes the pieces and scores of the one sentencepiece file there
is, which was made for merging (BPE).  Its counts are those of a Unigram model with
these pieces and scores, not what that file's own tokenizer would give.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at
each character; dynamic programming carries the best score, the number of tokens
and how the best path ends, nothing else.  The rules are the tokenizer library's
Unigram model with a Metaspace pre-tokenizer: a piece replaces another only if
its score is strictly higher, where earlier starts are tried first; a character
that is no piece costs the lowest score less ten; neighbouring unknown characters
fuse, and with byte fallback a fused run counts its bytes where the vocabulary has
all of them, else one.

A text is cut before each word mark, as that pre-tokenizer does, so each distinct
word is counted once and cached.

Defined cases: a null or empty text has 0 tokens; rows that repeat are answered
alike; columns of other names don't matter; an empty table gives an empty result.
The vocabulary is a file of bounded size and is broadcast; documents are not
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import Cache, mapped

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer library
_PART_BYTES = 4 << 20


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of words; ``unknown`` is the index of the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True, entries: int = 200_000) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        names = {p for p, _ in vocabulary}
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in names} if byte_fallback else set()
        self.cache = Cache(entries, self.word)

    def word(self, word: str) -> int:
        """Tokens of one pre-tokenized word."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(word):
            ending[last].append(found)  # longest, that is earliest start, first
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        run = [-1] * (n + 1)  # where the unknown run that ends here began
        for end in range(1, n + 1):
            best, length = None, 0
            single = False
            for size, piece_score in ending[end - 1]:
                single = single or size == 1
                total = piece_score + score[end - size]
                if best is None or total > best:
                    best, length = total, size
            if not single:
                total = self.unknown_score + score[end - 1]
                if best is None or total > best:
                    best, length = total, 0
            score[end] = best
            if length:
                count[end] = count[end - length] + 1
            else:
                start = run[end - 1] if run[end - 1] >= 0 else end - 1
                run[end] = start
                count[end] = count[start] + self._unknown(word[start:end])
        return count[n]

    def _unknown(self, text: str) -> int:
        raw = text.encode()
        return len(raw) if self.bytes.issuperset(raw) else 1

    def _cut(self, text: str) -> int:
        first, *rest = text.replace(" ", MARK).split(MARK)
        return self.word(first) + sum(self.word(MARK + w) for w in rest)

    def counts(self, texts: pa.Array) -> list[int]:
        """Tokens of each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(odd := pc.match_substring(texts, "\x00")).as_py():  # texts that hold the separator
            plain = iter(self.counts(texts.filter(pc.invert(odd))))
            return [self._cut(t.as_py()) if o else next(plain) for t, o in zip(texts, odd.to_pylist(), strict=True)]
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK), MARK, "\x00" + MARK)
        lists = pc.split_pattern(marked, "\x00")
        words = lists.flatten().dictionary_encode()
        self.cache.turn()
        per_word = pa.array(map(self.cache.__getitem__, words.dictionary.to_pylist()), pa.int64()).take(words.indices)
        total = pc.fill_null(pc.cumulative_sum(per_word), 0).to_pylist()
        ends = [o - lists.offsets[0].as_py() for o in lists.offsets.to_pylist()]
        at = [total[e - 1] if e else 0 for e in ends]
        return [b - a for a, b in zip(at, at[1:], strict=False)]


def marked_start(text: str) -> str:
    """The pre-tokenizer puts a mark before a text that doesn't begin with one."""
    return text if not text or text[0] in (" ", MARK) else " " + text


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens`` for each row."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for batch in batches:
            texts = pa.array([marked_start(t.as_py() or "") for t in batch.column(1)], pa.string())
            found: list[int] = []
            at, size = 0, 0
            for k, n in enumerate(pc.binary_length(texts).to_pylist()):
                size += n
                if size >= _PART_BYTES:
                    found += counter.counts(pa.concat_arrays([texts.slice(at, k + 1 - at)]))
                    at, size = k + 1, 0
            found += counter.counts(pa.concat_arrays([texts.slice(at)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["i", "n"])

    return mapped(rows, run, f"i {rows.schema['i'].dataType.simpleString()}, n long").toDF(id_col, "n_tokens")
