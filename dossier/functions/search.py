"""Scores of texts for many questions at once, in Arrow batches.

A question is a text of lines (question_lines): a weight and a token, or the token's number, in each. Texts come with all
the questions that are asked of them, so each is taken apart once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of bytes: a-z, 0-9, and the rest as one. Grams of one, two and three bytes have codes one behind another.
_CLASSES = 37
_CLASS = np.zeros(256, np.intp)
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, _CLASSES)
_TWO, _THREE = _CLASSES, _CLASSES + _CLASSES**2
GRAM_CODES = _THREE + _CLASSES**3
#: Grams of a token that are looked up before the token is searched for.
_GRAMS = 8


def question_lines(tokens: Column, weight: Callable[[Column], Column]) -> Column:
    """Tokens of a-z and 0-9, or numbers, as lines with their weights; null stays null."""
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws(" ", weight(t), t)), "\n")


class _Asked:
    """Questions of one text: their distinct tokens, and for each occurrence its token, question and weight."""

    def __init__(self, questions: list[str | None]):
        lines = [(k, *line.split(" ")) for k, q in enumerate(questions) if q for line in q.split("\n")]
        self.n = len(questions)
        self.tokens = list(dict.fromkeys(t for _, _, t in lines))
        place = {t: i for i, t in enumerate(self.tokens)}
        self.token = np.array([place[t] for _, _, t in lines], np.intp)
        self.question = np.array([k for k, _, _ in lines], np.intp)
        self.weight = np.array([int(w) for _, w, _ in lines], np.int64)

    def scores(self, has: np.ndarray) -> np.ndarray:
        met = has[self.token]
        return np.bincount(self.question[met], self.weight[met], self.n).astype(np.int32)


class _Search:
    """Which tokens a text contains. Only those all of whose grams it has are searched for, and those of up to three
    bytes are grams themselves."""

    def __init__(self, asked: _Asked):
        self.tokens = asked.tokens
        own = [gram_codes(t.encode())[min(len(t), 3) - 1][:_GRAMS] for t in self.tokens]
        self.codes = np.array([[*c, *[c[0]] * (_GRAMS - len(c))] for c in own], np.intp).reshape(-1, _GRAMS).T.copy()
        self.long = np.array([len(t) > 3 for t in self.tokens], bool)
        self.present = np.zeros(GRAM_CODES, bool)

    def has(self, text: str) -> np.ndarray:
        grams = gram_codes(text.encode())
        for codes in grams:
            self.present[codes] = True
        found = self.present.take(self.codes).all(axis=0)
        for codes in grams:
            self.present[codes] = False
        for i in np.flatnonzero(found & self.long).tolist():
            found[i] = self.tokens[i] in text
        return found


def gram_codes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all grams of one, two and three bytes."""
    one = _CLASS[np.frombuffer(text, np.uint8)]
    two = one[:-1] * _CLASSES + one[1:]
    return one, two + _TWO, two[:-1] * _CLASSES + one[2:] + _THREE


class _Numbers:
    """Which tokens a list of numbers has."""

    def __init__(self, asked: _Asked):
        self.numbers = np.array([int(t) for t in asked.tokens], np.intp)
        self.present = np.zeros(1 + self.numbers.max(initial=0), bool)

    def has(self, found: np.ndarray) -> np.ndarray:
        own = found[found < len(self.present)]
        self.present[own] = True
        met = self.present[self.numbers]
        self.present[own] = False
        return met


def _scored(questions: pa.Array, places: list, finder: type) -> pa.Array:
    ends = questions.offsets.to_numpy() - questions.offsets[0].as_py()
    coded = questions.flatten().dictionary_encode()
    words, ids = coded.dictionary.to_pylist(), coded.indices.to_pylist()
    known: dict[tuple, tuple] = {}
    sums = np.zeros(len(ids), np.int32)
    for k, place in enumerate(places):
        key = tuple(ids[ends[k] : ends[k + 1]])
        if key not in known:
            asked = _Asked([None if i is None else words[i] for i in key])
            known[key] = asked, finder(asked)
        asked, find = known[key]
        if place is not None and len(place) and asked.tokens:
            sums[ends[k] : ends[k + 1]] = asked.scores(find.has(place))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums, pa.int32()))


def _by_text(questions: pa.Array, texts: pa.Array) -> pa.Array:
    return _scored(questions, texts.to_pylist(), _Search)


def _by_numbers(questions: pa.Array, found: pa.Array) -> pa.Array:
    ends = found.offsets.to_numpy() - found.offsets[0].as_py()
    numbers = found.flatten().to_numpy(zero_copy_only=False)
    return _scored(questions, [numbers[a:b] for a, b in zip(ends, ends[1:], strict=False)], _Numbers)


def text_scores(questions: Column, text: Column) -> Column:
    """For each question (question_lines of tokens) the sum of the weights of the tokens that the text contains; a repeated
    token counts again. questions: an array that is not null."""
    return F.arrow_udf(_by_text, "array<int>")(questions, text)


def number_scores(questions: Column, found: Column) -> Column:
    """The same for questions of numbers and a list (not null) of those that are found."""
    return F.arrow_udf(_by_numbers, "array<int>")(questions, found)
