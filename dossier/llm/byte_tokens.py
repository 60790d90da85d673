"""Token ids of whole texts by a byte-level tokenizer, piece by piece, with what was encoded before remembered.

Such a tokenizer cuts text before it encodes: a space goes with the word behind it, a line feed stands alone. So the ids
of a text are those of what stands between its spaces and line feeds, each with the one before it, as long as no white
space runs on for three characters, or for two at the end: how such runs are cut depends on what is around them, and
those texts are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_RUN_ON = f"{_SPACE}{{3}}|{_SPACE}{{2}}$|\\x00"
#: Stands for a line feed at the start of a piece.
_FEED = "\0"
#: Characters of a piece that is remembered, at most.
_MOST = 48
#: Pieces that are encoded in one call.
_CALL = 4096
#: A word with marks behind it, which are cut from it. Letters below U+0250 are letters in any version of Unicode.
_MARKED = re.compile(r"([A-Za-z\u00C0-\u024F]+)([!-/:-@\[-`{-~]+)")
_WORD = re.compile(r"[A-Za-z\u00C0-\u024F]+")


class PieceEncoder:
    """encode() gives ids as unsigned 32-bit integers. Memory: two generations of about `remember` pieces at most."""

    def __init__(self, path: str, remember: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {token.content: i for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.remember = remember
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max([*vocabulary.values(), *self.special.values()]) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True  # a space, as such files write it

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with the space or line feed before it. A special token parts texts before they are cut, so
        that one call encodes many."""
        texts = ["\n" + piece[1:] if piece[:1] == _FEED else " " + piece for piece in pieces]
        if not self.special or any(token in text for text in texts for token in self.special):
            return self._whole(texts)
        token, number = next(iter(self.special.items()))
        return self._joined(texts, token, lambda ids: (np.append(0, np.flatnonzero(ids == number) + 1), np.append(np.flatnonzero(ids == number), len(ids))))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters with a space before each: only their first ids are of tokens that start with one."""

        def places(ids):
            starts = np.flatnonzero(self.opens[ids])
            return starts, np.append(starts[1:], len(ids))

        return self._joined([" " + word for word in words], "", places)

    def _joined(self, texts: list[str], between: str, places) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), _CALL):
            some = texts[k : k + _CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts, ends = places(ids)
            if len(starts) != len(some):
                out.extend(self._whole(some))
                continue
            data = ids.tobytes()
            out.extend(data[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True))
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; long ones are encoded and not kept."""
        if len(self.pieces) > self.remember:
            self.pieces, self.old = {}, self.pieces
        known, old = self.pieces, self.old
        marked, words, rest, long = [], set(), [], []
        for piece in pieces:
            if piece in known:
                continue
            if piece in old:
                known[piece] = old[piece]
            elif len(piece) > _MOST:
                long.append(piece)
            elif found := _MARKED.fullmatch(piece):
                marked.append((piece, *found.groups()))
                words.add(found[1])
            elif _WORD.fullmatch(piece):
                words.add(piece)
            else:
                rest.append(piece)
        words = list(words.difference(known))
        again = [word for word in words if word in old]
        known.update((word, old[word]) for word in again)
        words = list(set(words).difference(again))
        plain = [word for word in words if word.isalpha()]
        rest += [word for word in words if not word.isalpha()]
        known.update(zip(plain, self._words(plain), strict=True))
        known.update(zip(rest, self._spaced(rest), strict=True))
        if len(self.marks) > self.remember:
            self.marks = {}
        new = list({marks for _, _, marks in marked}.difference(self.marks))
        self.marks.update(zip(new, self._whole(new), strict=True))
        for piece, word, marks in marked:
            if word.isalpha() and not any(token in piece for token in self.special):
                known[piece] = known[word] + self.marks[marks]
            else:
                known[piece] = self._whole([" " + piece])[0]
        apart = dict(zip(long, self._spaced(long), strict=True))
        return [known[piece] if piece in known else apart[piece] for piece in pieces]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _RUN_ON).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        if whole.any():
            for k, ids in zip(np.flatnonzero(whole).tolist(), self._whole(texts.filter(pa.array(whole)).to_pylist()), strict=True):
                out[k] = np.frombuffer(ids, "<u4")
        if whole.all():
            return out
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~whole)), "\n", " " + _FEED), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        unique, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        firsts = offsets[:-1] - offsets[0]
        opening = [unique[k].replace(_FEED, "\n") for k in codes[firsts].tolist()]
        codes[firsts] = len(unique) + np.arange(len(firsts))
        known = self._learn(unique) + self._whole(opening)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        n = lengths[codes]
        ends = np.append(0, np.cumsum(n))
        places = np.arange(ends[-1]) - np.repeat(ends[:-1] - (np.cumsum(lengths) - lengths)[codes], n)
        for k, own in zip(np.flatnonzero(~whole).tolist(), np.split(ids[places], ends[offsets[1:-1] - offsets[0]]), strict=True):
            out[k] = own
        return out


@functools.lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker, kept from task to task."""
    return PieceEncoder(path)
