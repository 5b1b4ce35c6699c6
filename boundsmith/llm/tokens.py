"""Encoding with a byte-level BPE tokenizer file, each distinct word once.

The tokenizer library does all encoding.  Its pre-tokenizer never lets a piece
cross from a non-blank character to the white space after it, and ends a run of
letters at a punctuation mark, so that a text may be encoded word by word.  Arrow
splits a block of texts into words and numbers the distinct ones; only those reach
Python, a cache answers most, and Arrow puts the ids together again.  Texts with
any white space but single spaces and line ends, or control characters, are given
to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from boundsmith.llm.common import LONGEST_KEY, Cache

#: Control characters, other white space and joiners, or blanks that meet or stand at an end.
_ODD = "[\x00-\x09\x0b-\x1f\x7f-\xa0\xad ᠎ -‏ -  -⁤　﻿]|[ \n][ \n]|^[ \n]|[ \n]\\z"
_ENDS = ".,!?|&$%#*;:"
#: Marks for what stood before a word; a word without mark follows a space.
_LINE, _START = "\x00", "\x01"


def _source(word: str) -> str:
    if word[:1] == _LINE:
        return "\n" + word[1:]
    return word[1:] if word[:1] == _START else " " + word


class Encoder:
    """Encodes Arrow arrays of texts to token ids, little-endian unsigned 32-bit.

    ``entries`` bounds the cache; ``part_bytes`` bounds the text that is split at once.
    """

    def __init__(self, path: str, entries: int = 600_000, part_bytes: int = 2 << 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache = Cache(entries)
        self.part_bytes = part_bytes

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; only words bare of end marks enter the cache."""
        self.cache.turn()
        young, old = self.cache.get, self.cache.old.get
        out: list[bytes | None] = []
        later: list[tuple[int, str, str | None]] = []
        met: dict[str, bytes | None] = {}  # what isn't young yet
        for place, word in enumerate(words):
            ids = young(word)
            if ids is None:
                core = word.rstrip(_ENDS)
                if len(core) < len(word) and core.lstrip("\x00\x01").isalpha():
                    mark = _START + word[len(core) :]
                    head, tail = young(core), young(mark)
                    if head is not None and tail is not None:
                        ids = head + tail
                    else:
                        later.append((place, core, mark))
                        met[core], met[mark] = head or old(core), tail or old(mark)
                else:
                    ids = met[word] = old(word)
                    if ids is None:
                        later.append((place, word, None))
            out.append(ids)
        unknown = [w for w, ids in met.items() if ids is None]
        met.update(zip(unknown, self.whole([_source(w) for w in unknown]), strict=True))
        for place, core, mark in later:
            out[place] = met[core] if mark is None else met[core] + met[mark]
        self.cache.update((w, ids) for w, ids in met.items() if len(w) <= LONGEST_KEY)
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        marked = pc.binary_replace_slice(pc.replace_substring(texts, "\n", " " + _LINE), 0, 0, _START)
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        places = np.frombuffer(ids.buffers()[1], "<i4")[: len(ids) + 1]
        ends = places[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] is not None else memoryview(b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _part(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        plain = iter(self._plain(texts.filter(pc.invert(odd))))
        whole = iter(self.whole(texts.filter(odd).to_pylist()))
        return [next(whole) if o else next(plain) for o in odd.to_pylist()]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8") + 1)
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + self.part_bytes, "right")))
            yield from self._part(pa.concat_arrays([texts.slice(at, to - at)]))
            at = to


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; workers are reused, and so is its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
