"""Token ids of whole texts by the tokenizers library, word by word, with what was encoded before remembered.

The tokenizer named in `path` drops white space and never joins across it, so a text's ids are those of its
white-space-separated words in order. A task encodes each distinct word once while it stays among the recent ones.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters below this code point are in scripts whose lower case and composition don't depend on context.
_PLAIN = "ɐ"


class WordEncoder:
    """encode() gives ids as unsigned 32-bit integers. Memory: two generations of about `remember` words at most."""

    def __init__(self, path: str, remember: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.remember = remember
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.old_stems: dict[str, bytes] = {}
        self.marks = {m: self._encode([m])[0] for m in ".,"}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_stems(self, stems: list[str]) -> None:
        """Words of letters only are one pre-token each, so one call encodes all and the ends of words part them."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(stems):
            self.stems.update(zip(stems, self._encode(stems), strict=True))
            return
        data, start = ids.tobytes(), 0
        for stem, end in zip(stems, (ends * 4).tolist(), strict=True):
            self.stems[stem] = data[start:end]
            start = end

    def _learn(self, words: set[bytes]) -> None:
        if len(self.words) > self.remember:
            self.words, self.old_words = {}, self.words
        if len(self.stems) > self.remember:
            self.stems, self.old_stems = {}, self.stems
        words = words.difference(self.words)
        self.words.update({word: self.old_words[word] for word in words if word in self.old_words})
        plain, other = {}, []
        for raw in words.difference(self.words):
            word = raw.decode()
            stem, mark = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
            if stem.isalpha() and max(stem) < _PLAIN and "İ" not in stem:
                plain[raw] = (stem.lower(), mark)
            else:
                other.append((raw, word))
        stems = {stem for stem, _ in plain.values()}.difference(self.stems)
        self.stems.update({stem: self.old_stems[stem] for stem in stems if stem in self.old_stems})
        if stems := list(stems.difference(self.stems)):
            self._encode_stems(stems)
        for raw, (stem, mark) in plain.items():
            self.words[raw] = self.stems[stem] + self.marks[mark] if mark else self.stems[stem]
        if other:
            self.words.update(zip((raw for raw, _ in other), self._encode([word for _, word in other]), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; none for null."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        unique, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        self._learn(set(unique) - {b""})
        known = [self.words[word] if word else b"" for word in unique]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        n = lengths[codes]
        ends = np.append(0, np.cumsum(n))
        places = np.arange(ends[-1]) - np.repeat(ends[:-1] - (np.cumsum(lengths) - lengths)[codes], n)
        offsets = lists.offsets.to_numpy()
        return ids[places], np.diff(ends[offsets - offsets[0]])


def by_bytes(batch: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of one column; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts, start = np.cumsum(lengths) // size, 0
    for end in [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    return WordEncoder(path)
