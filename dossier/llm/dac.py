"""Directly addressable codes: token ids in chunk levels with continuation bitmaps and rank directories.

An id's lowest `width` bits are its chunk on level 0, the next ones, if any are set, its chunk on level 1, and so on.
Level k holds the chunks of all ids that reach it, in order, and a bit for each that says whether it goes on. The
number of set bits before a chunk (its rank) is its place on the next level; a directory holds the rank at every
`BLOCK` bits, so any id is read by one chunk, one bit and one short count on each level, without decoding others.

File, little-endian: magic, number of ids, documents and levels, chunk width; for each level its length; document ids,
document starts (one more than documents), null flags of the document ids; then for each level chunks, bitmap and ranks.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"DACIDS01"
WIDTH = 8
#: Bits between two entries of a rank directory.
BLOCK = 512
_HEAD = struct.Struct("<8sqqqq")


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray
    ranks: np.ndarray

    def rank(self, at: int) -> int:
        """Set bits before position `at`."""
        block = at // BLOCK
        first, whole = block * BLOCK // 8, at // 8
        count = int(self.ranks[block]) + int(np.bitwise_count(self.bitmap[first:whole]).sum())
        return count + (int(self.bitmap[whole]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else count


def split_levels(ids: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chunks and continuation flags of each level; the last level's flags are all unset."""
    rest, levels = ids.astype("<u4"), []
    while True:
        chunks = (rest & ((1 << width) - 1)).astype(np.uint8)
        rest = rest >> width
        goes_on = rest != 0
        levels.append((chunks, goes_on))
        if not goes_on.any():
            return levels
        rest = rest[goes_on]


class Writer:
    """Takes documents one by one; what it holds are chunks and flags, about as many bytes as the file."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.starts = [0]
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def __len__(self) -> int:
        return self.starts[-1]

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        """A document's ids, in one or more pieces."""
        n = sum(map(len, ids))
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + n)
        self.waiting.extend(ids)
        self.held += n
        if self.held > 1 << 20:
            self._split()

    def _split(self) -> None:
        for k, level in enumerate(split_levels(np.concatenate(self.waiting or [np.zeros(0, "<u4")]))):
            if k == len(self.parts):
                self.parts.append([])
            self.parts[k].append(level)
        self.waiting, self.held = [], 0

    def write(self, out) -> None:
        self._split()
        levels = []
        for parts in self.parts:
            goes_on = np.concatenate([flags for _, flags in parts])
            bitmap = np.packbits(goes_on, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(bitmap).astype("<u8"), np.arange(0, len(bitmap), BLOCK // 8)) if len(bitmap) else np.zeros(0, "<u8")
            ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
            levels.append((np.concatenate([chunks for chunks, _ in parts]), bitmap, ranks))
        out.write(_HEAD.pack(MAGIC, self.starts[-1], len(self.doc_ids), len(levels), WIDTH))
        out.write(np.array([len(chunks) for chunks, _, _ in levels], "<i8").tobytes())
        out.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        out.write(np.array(self.starts, "<i8").tobytes())
        out.write(np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        for arrays in levels:
            for array in arrays:
                out.write(array.tobytes())


class Reader:
    """Random access to a file's ids, from its bytes or a memory map of them."""

    def __init__(self, data):
        magic, self.n_ids, n_docs, n_levels, self.width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self._data, self._at = data, _HEAD.size
        lengths = self._take("<i8", n_levels)
        self.doc_ids, self.starts, null = self._take("<i8", n_docs), self._take("<i8", n_docs + 1), self._take(np.uint8, n_docs)
        self.null_ids = null.astype(bool)
        self.levels = []
        for n in lengths.tolist():
            n_bytes = (n + 7) // 8
            self.levels.append(Level(self._take(np.uint8, n), self._take(np.uint8, n_bytes), self._take("<u8", (n_bytes * 8 + BLOCK - 1) // BLOCK + 1)))

    def _take(self, kind, n: int) -> np.ndarray:
        found = np.frombuffer(self._data, kind, n, self._at)
        self._at += found.nbytes
        return found

    def __getitem__(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        found = shift = 0
        for level in self.levels:
            found |= int(level.chunks[at]) << shift
            if not level.bitmap[at // 8] >> (at % 8) & 1:
                break
            at, shift = level.rank(at), shift + self.width
        return found

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids at positions start to end: on each level one run of chunks, found by the rank of its first."""
        if end <= start:
            return np.zeros(0, "<u4")
        found = np.zeros(end - start, "<u4")
        places: np.ndarray | slice = slice(None)
        shift = 0
        for level in self.levels:
            found[places] |= level.chunks[start:end].astype("<u4") << np.uint32(shift)
            bits = np.unpackbits(level.bitmap[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start]
            goes_on = np.flatnonzero(bits)
            if not len(goes_on):
                break
            places = goes_on if isinstance(places, slice) else places[goes_on]
            start, shift = level.rank(start), shift + self.width
            end = start + len(goes_on)
        return found
