"""Words and tokens of a-z and 0-9 by their grams of up to three characters, which have codes (functions/search.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.functions.search import GRAM_CODES, gram_codes

#: Characters of the longest grams.
GRAM = 3


def token_grams(tokens: DataFrame) -> DataFrame:
    """token, number and gram, a row for each gram of a token; one of fewer characters than GRAM is its own gram."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(gram_codes(t.encode())[min(len(t), GRAM) - 1]) for t in batch.column("token").to_pylist()]
            rows = np.repeat(np.arange(len(own)), [len(codes) for codes in own])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(np.concatenate([[], *own]).astype(np.int32))], names=["token", "number", "gram"])

    return tokens.select("token", "number").mapInArrow(each, "token string, number int, gram int")


def gram_counts(words: DataFrame) -> DataFrame:
    """_gram and n, how often words (word) have it, from each task: no more rows than there are codes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRAM_CODES, np.int64)
        for batch in batches:
            for codes in gram_codes(_joined(batch.column("word"))[0]):
                n += np.bincount(codes, minlength=GRAM_CODES)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["_gram", "n"])

    return words.select("word").mapInArrow(each, "_gram int, n long").groupBy("_gram").sum("n").withColumnRenamed("sum(n)", "n")


def filed(words: DataFrame, numbers: dict[int, int], grams: list[int]) -> DataFrame:
    """words (word) with own, the numbers of those of its grams that have one, and grams, those of the given ones that it has."""
    number = np.zeros(GRAM_CODES, np.int32)
    number[list(numbers)] = list(numbers.values())
    chosen = np.zeros(GRAM_CODES, bool)
    chosen[grams] = True

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, word_of = _joined(batch.column("word"))
            codes = gram_codes(text)
            own, some = (_of_words(codes, word_of, batch.num_rows, which) for which in (number > 0, chosen))
            lists = [pa.ListArray.from_arrays(pa.array(own[0]), pa.array(number[own[1]])), pa.ListArray.from_arrays(pa.array(some[0]), pa.array(some[1].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), *lists], names=["word", "own", "grams"])

    return words.select("word").mapInArrow(each, "word string, own array<int>, grams array<int>")


def _joined(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """Words with a space behind each, and the word of each byte. No gram with a space in it is one of a token's."""
    each = words.cast(pa.binary()).to_pylist()
    return b" ".join([*each, b""]), np.repeat(np.arange(len(each)), [1 + len(w) for w in each])


def _of_words(codes: tuple[np.ndarray, ...], word_of: np.ndarray, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each of n words, of those that are wanted: where words begin and end, and the codes."""
    pairs = []
    for code in codes:
        at = np.flatnonzero(which[code])
        pairs.append(word_of[at] * GRAM_CODES + code[at])
    found = np.unique(np.concatenate(pairs))
    return np.searchsorted(found, np.arange(n + 1) * GRAM_CODES).astype(np.int32), found % GRAM_CODES
