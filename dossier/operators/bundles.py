"""Words of texts, in bundles of texts that share one list of distinct words.

What is looked up by word is looked up once a bundle, not once a text, and brought back to the texts by their places in
the bundle's list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts in a bundle, at most.
BUNDLE = 4096
#: Cells of the table of texts and numbers that is filled at a time.
_CELLS = 1 << 22
#: Bytes that are not of a-z and 0-9, all those of other characters among them, become spaces.
_RUNS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def bundled(rows: DataFrame, text: str) -> DataFrame:
    """rows without their text, with _bundle and _ids, the places of the text's distinct runs of a-z and 0-9 in _words.

    _words, the distinct runs of all texts of a bundle, is with its first row; null with the others. Narrow.
    """
    kept = [f for f in rows.schema.fields if f.name != text]
    made = [T.StructField("_bundle", T.LongType()), T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_words", T.ArrayType(T.StringType()))]
    names, most = [f.name for f in kept], BUNDLE

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                own = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array([bundle] * part.num_rows, pa.int64()), *_taken(part.column(text))], names=[*names, *(f.name for f in made)])
                bundle += 1

    return rows.select(*names, text).mapInArrow(each, T.StructType([*kept, *made]))


def _taken(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    place: dict[bytes, int] = {}
    ids: list[int] = []
    ends = [0]
    for text in texts.cast(pa.binary()).to_pylist():
        for word in dict.fromkeys(text.translate(_RUNS).split()) if text else ():
            ids.append(place.setdefault(word, len(place)))
        ends.append(len(ids))
    words = pa.array(list(place), pa.binary()).cast(pa.string())
    of_first = pa.ListArray.from_arrays(pa.array([0] + [len(words)] * len(texts), pa.int32()), words, mask=pa.array([k > 0 for k in range(len(texts))]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), of_first


def bundle_words(rows: DataFrame) -> DataFrame:
    """_of (its _bundle), _id and word of each word of a bundle."""
    return rows.filter("_words is not null").select(F.col("_bundle").alias("_of"), F.posexplode("_words").alias("_id", "word"))


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """bundled() rows with _found, the distinct numbers of their words, for _ids and _words.

    found: _of, _id and numbers of the words that have some. Rows and found are shuffled by bundle; a task holds one.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("_bundle", "_ids", "_words")]
    names = [f.name for f in kept]

    def each(texts: pa.Table, words: pa.Table) -> pa.Table:
        return texts.select(names).append_column("_found", _numbers_of(texts.column("_ids").combine_chunks(), words))

    groups = rows.select("_bundle", "_ids", *names).groupBy("_bundle").cogroup(found.select("_of", "_id", "numbers").groupBy("_of"))
    return groups.applyInArrow(each, T.StructType([*kept, T.StructField("_found", T.ArrayType(T.IntegerType()))]))


def _lists(of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array, one list behind another, and where lists begin and end."""
    ends = of.offsets.to_numpy()
    return of.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends - ends[0]


def _numbers_of(ids: pa.Array, words: pa.Table) -> pa.Array:
    flat, ends = _lists(ids)
    n = np.zeros(1 + flat.max(initial=0), np.int64)
    first = np.zeros_like(n)
    numbers = np.zeros(0, np.int64)
    if words.num_rows:
        numbers, of_word = _lists(words.column("numbers").combine_chunks())
        place = words.column("_id").to_numpy()
        n[place], first[place] = np.diff(of_word), of_word[:-1]
    wide = 1 + int(numbers.max(initial=0))
    rows = max(1, _CELLS // wide)
    found, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for start in range(0, len(ids), rows):
        own = ends[start : start + rows + 1]
        word = flat[own[0] : own[-1]]
        text = np.repeat(np.repeat(np.arange(len(own) - 1), np.diff(own)), n[word])
        before = np.cumsum(n[word]) - n[word]
        at = np.repeat(first[word] - before, n[word]) + np.arange(len(text))
        has = np.zeros((len(own) - 1, wide), bool)
        has[text, numbers[at]] = True
        found.append(np.nonzero(has)[1])
        counts.append(has.sum(axis=1))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
