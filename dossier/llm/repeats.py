"""Exact substring dedup: bytes covered by long strings that occur more than once in the corpus.

Every window of `size` bytes is filed under its anchor, the gram in it with the least hash. Equal windows have equal
anchors, so only texts around anchors that occur twice or more are compared; those are put in suffix order, many at a
time, by the column-wise construction of column_bwt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.column_bwt import repeated_windows
from dossier.llm.common import bounded_broadcast, cut, spread
from dossier.llm.word_tokens import by_bytes

SIZE = 200
GRAM = 64
#: Windows taken at once from a longer text.
CHUNK = 4 << 20
#: Different surroundings of one anchor that are put in order together; those of more frequent anchors are parted first.
KINDS = 256
#: Bytes of surroundings that are put in suffix order together.
COLLECTION = 1 << 19
#: Bytes of a text whose spans are put together first.
PLACES = 1 << 20

_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_ANCHORS = "id long, th long, anchor long, content long, at long, n int, reach long, times int"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` hashes in a row."""
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if span > width else h


def anchored_runs(data: np.ndarray, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, and the anchor's hash.

    data: texts laid end to end; ends: where each ends. No window crosses an end. Of equal least hashes in a window the
    first is the anchor.
    """
    n, span = len(data) - size + 1, size - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(data)
    least = _least(h, span)[:n]
    inside = np.ones(n, bool)
    for end in ends.tolist():
        inside[max(0, end - size + 1) : end] = False
    opens = inside.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(opens)
    closes = np.flatnonzero(inside & ~np.append(inside[1:] & ~opens[1:], False)) + 1
    anchor = first + (h[first[:, None] + np.arange(span)] == least[first][:, None]).argmax(1)
    later = closes > anchor + 1  # the least hash comes again
    if later.any():
        rest = np.concatenate([np.arange(a + 1, b) for a, b in zip(anchor[later].tolist(), closes[later].tolist(), strict=True)])
        place = np.concatenate([r + (h[r[:, None] + np.arange(span)] == least[r][:, None]).argmax(1) for r in np.array_split(rest, len(rest) // 20_000 + 1)])
        opens = np.append(True, (np.diff(place) != 0) | (np.diff(rest) != 1))
        closes = np.minimum(closes, anchor + 1)
        more = rest[opens]
        counts = np.diff(np.append(np.flatnonzero(opens), len(rest)))
        first, closes = np.append(first, more), np.append(closes, more + counts)
    return first, closes - first, least[first]


def anchors(docs: DataFrame, size: int = SIZE, chunk: int = CHUNK, chained: bool = False) -> DataFrame:
    """A row per run of windows with one anchor: the document, the anchor's hash, the hash of the run's bytes, the run's
    place in the text and its number of windows. docs: id, th, text. Longer texts are taken `chunk` windows at a time.

    chained: equal runs of a text that follow each other at `size` bytes or less, as in periodic texts, are one row,
    with how many they are (times) and how far behind the first the last is (reach), so that a text of one byte has a
    few rows and not one for each byte. Else each is a row, with times 1 and reach 0.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, chunk):
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                joined = b"".join(texts)
                data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(t) for t in texts])
                ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
                for low in range(0, max(1, len(data)), chunk):
                    high = min(len(data), low + chunk + size - 1)
                    inner = ends[(ends > low) & (ends <= high)] - low
                    first, n, anchor = anchored_runs(data[low:high], inner if high == len(data) or (len(inner) and inner[-1] == high - low) else np.append(inner, high - low), size)
                    if not len(first):
                        continue
                    first = first + low
                    owner = np.searchsorted(ends, first, side="right")
                    content = [xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(first.tolist(), (first + n + size - 1).tolist(), strict=True)]
                    content = np.array(content, np.uint64)
                    order = np.lexsort((first, content, anchor, owner))
                    first, n, anchor, content, owner = (x[order] for x in (first, n, anchor, content, owner))
                    same = chained & (np.diff(content) == 0) & (np.diff(anchor) == 0) & (np.diff(owner) == 0) & (np.diff(n) == 0) & (np.diff(first) <= size)
                    opens = np.flatnonzero(np.append(True, ~same))
                    times = np.diff(np.append(opens, len(first)))
                    reach = first[opens + times - 1] - first[opens]
                    first, n, anchor, content, owner = (x[opens] for x in (first, n, anchor, content, owner))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[owner]),
                            pa.array(hashes[owner]),
                            pa.array(anchor.view(np.int64)),
                            pa.array(content.view(np.int64)),
                            pa.array(first - np.append(0, ends)[owner]),
                            pa.array(n.astype(np.int32)),
                            pa.array(reach),
                            pa.array(times.astype(np.int32)),
                        ],
                        names=[x.split()[0] for x in _ANCHORS.split(", ")],
                    )

    return docs.select("id", "th", "text").mapInArrow(find, _ANCHORS)


def _on_document(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs with the list of each (id, th): broadcast up to a bound of bytes, joined by key beyond."""
    lists = lists.withColumnsRenamed({"id": "id_", "th": "th_"})
    few = bounded_broadcast(lists)
    return docs.join(lists if few is None else few, (F.col("id") == F.col("id_")) & (F.col("th") == F.col("th_")), how).drop("id_", "th_")


_PIECES = "anchor long, content long, weight long, frequent boolean, n int, at int, low int, high int, bytes binary"
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _surroundings(docs: DataFrame, kinds: DataFrame, size: int) -> DataFrame:
    """kinds (anchor, content, weight, frequent, id, th, at, n) with their bytes, cut from the texts."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0, CHUNK):
                rows = []
                for text, wanted in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows.extend((w["anchor"], w["content"], w["weight"], w["frequent"], w["n"], None, 0, size - GRAM, text[w["at"] : w["at"] + w["n"] + size - 1]) for w in wanted)
                yield _batch(rows, _PIECE_TYPES, _PIECES)

    lists = kinds.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "content", "weight", "frequent", "at", "n")).alias("wanted"))
    return _on_document(docs, cut(lists, "repeats-wanted"), "inner").select("text", "wanted").mapInArrow(slices, _PIECES)


def _ranges(mask: np.ndarray) -> list[dict[str, int]]:
    """Runs of set windows, from one to before another."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"a": a, "b": b} for a, b in edges.reshape(-1, 2).tolist()]


_RANGES = "anchor long, content long, ranges array<struct<a:int,b:int>>"
_RANGE_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _by_suffix_order(pieces: DataFrame, size: int) -> DataFrame:
    """Repeated windows of surroundings of one anchor, for many anchors at a time."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def close() -> pa.RecordBatch:
            masks = repeated_windows([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], size)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([_ranges(m) for m in masks], _RANGE_TYPE)], names=["anchor", "content", "ranges"]
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held >= COLLECTION and row[0] != rows[-1][0]:
                    yield close()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield close()

    dealt = pieces.select("anchor", "content", "weight", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(order, _RANGES)


_PARTS = "p_anchor long, p_content long, off int, anchor long, content long, weight long, n int, at int, low int, high int, bytes binary"
_PART_TYPES = [pa.int64(), pa.int64(), pa.int32(), *_PIECE_TYPES[:3], *_PIECE_TYPES[4:]]


def _parted(pieces: DataFrame, size: int) -> DataFrame:
    """The pieces of frequent anchors, each in two, under longer anchors.

    Of a piece's windows, those whose anchor stands low to high bytes from their start all have `low` bytes before it
    and `size - high` from it on. Halves of that range have more in common, so each half is filed under what its
    windows share: 64 bytes at first, then 132, 166 and so on up to the whole window. Equal windows have their anchor
    in the same place, so they are in the same half and under the same bytes. Where a frequent passage has other
    neighbours in every text, only the half that ends where the passage does stays frequent.
    """

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, content, weight, _, n, at, low, high, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None:
                    at = int((_gram_hashes(np.frombuffer(data, np.uint8)).view(np.int64)[: size - GRAM + 1] == anchor).argmax())
                middle = (low + high + 1) // 2
                for a, b in ((low, middle - 1), (middle, high)):
                    first, last = max(0, at - b), min(n - 1, at - a)
                    if a <= b and first <= last:
                        own, shared = data[first : last + size], data[at - a : at + size - b]
                        key, kind = xxhash.xxh64_intdigest(shared, a << 16 | b), xxhash.xxh64_intdigest(own, at - first)
                        rows.append((anchor, content, first, *(x - (x >> 63 << 64) for x in (key, kind)), weight, last - first + 1, at - first, a, b, own))
            yield _batch(rows, _PART_TYPES, _PARTS)

    return pieces.mapInArrow(halves, _PARTS)


def _with_frequent(kinds: DataFrame) -> DataFrame:
    """kinds (anchor, ...) with frequent: whether their anchor has more than KINDS of them."""
    often = kinds.groupBy(F.col("anchor").alias("anchor_")).agg(F.count("*").alias("kinds")).filter(F.col("kinds") > KINDS)
    often = cut(often.select("anchor_"), "repeats-frequent")
    few = bounded_broadcast(often)
    return kinds.join(often if few is None else few, F.col("anchor") == F.col("anchor_"), "left").withColumn("frequent", F.col("anchor_").isNotNull()).drop("anchor_")


def _resolved(pieces: DataFrame, size: int) -> DataFrame:
    """Repeated windows of pieces, as ranges of each anchor and content; those of frequent anchors by way of their parts."""
    found = _by_suffix_order(pieces.filter("not frequent"), size)
    hot = pieces.filter("frequent")
    if hot.isEmpty():
        return found
    parts = cut(_parted(hot, size), "repeats-parts")
    kinds = parts.groupBy("anchor", "content").agg(F.sum("weight").alias("weight"), F.min(F.struct("n", "at", "low", "high", "bytes")).alias("one"))
    kinds = cut(kinds.select("anchor", "content", "weight", "one.*"), "repeats-part-kinds")
    twice = kinds.groupBy(F.col("anchor").alias("anchor_")).agg(F.sum("weight").alias("rows")).filter("rows >= 2").select("anchor_")
    kinds = kinds.join(twice, F.col("anchor") == F.col("anchor_"), "left_semi")
    again = cut(_with_frequent(kinds).select(*(x.split()[0] for x in _PIECES.split(", "))), "repeats-part-pieces")
    below = _resolved(again, size).filter(F.size("ranges") > 0).withColumnsRenamed({"anchor": "anchor_", "content": "content_"})
    met = parts.join(cut(below, "repeats-below"), (F.col("anchor") == F.col("anchor_")) & (F.col("content") == F.col("content_")))
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("off")).alias("a"), (r["b"] + F.col("off")).alias("b")))
    both = met.select(F.col("p_anchor").alias("anchor"), F.col("p_content").alias("content"), moved.alias("ranges"))
    return found.unionByName(both.groupBy("anchor", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))  # two parts at most


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Spans of bytes of docs (id, th, text) under windows that start more than once: id, th and an array of spans.

    Runs of windows with a common anchor are compared by the 64-bit hash of their bytes and that of their anchor first:
    copies of one content are one string, weighed by their number, so groups of copies do not grow what is sorted. Only
    where one anchor has different surroundings are these put in suffix order.
    """
    rows = cut(anchors(docs, size, chained=True), "repeats-anchors")
    twice = rows.groupBy(F.col("anchor").alias("anchor_")).agg(F.sum("times").alias("rows"), F.min("content").alias("low"), F.max("content").alias("high"))
    twice = cut(twice.filter("rows >= 2").select("anchor_", (F.col("low") != F.col("high")).alias("mixed")), "repeats-twice")
    hits = cut(rows.join(twice, F.col("anchor") == F.col("anchor_")).drop("anchor_"), "repeats-hits")
    kinds = hits.filter("mixed").groupBy("anchor", "content").agg(F.sum("times").alias("weight"), F.min(F.struct("id", "th", "at", "n")).alias("one"))
    kinds = cut(kinds, "repeats-kinds")
    kinds = _with_frequent(kinds).select("anchor", "content", "weight", "frequent", "one.*")
    pieces = cut(_surroundings(docs, kinds, size), "repeats-pieces")
    resolved = _resolved(pieces, size).filter(F.size("ranges") > 0).withColumnsRenamed({"anchor": "anchor_", "content": "content_"})
    resolved = cut(resolved, "repeats-resolved")
    mixed = hits.filter("mixed").join(resolved, (F.col("anchor") == F.col("anchor_")) & (F.col("content") == F.col("content_")))
    # Equal runs in one row overlap, so that their spans are one.
    span = lambda a, b: F.struct((F.col("at") + a).alias("a"), (F.col("at") + F.col("reach") + b + (size - 1)).alias("b"))
    place = F.floor(F.col("at") / PLACES).alias("place")
    spans = mixed.select("id", "th", place, F.transform("ranges", lambda r: span(r["a"], r["b"])).alias("spans")).unionByName(
        hits.filter("not mixed").select("id", "th", place, F.array(span(F.lit(0), F.col("n"))).alias("spans"))
    )
    # Sets, as equal rows have the same spans; and parts of a text first, as a long text has many that touch.
    parts = _merged(spans.groupBy("id", "th", "place").agg(F.flatten(F.collect_set("spans")).alias("spans")).drop("place"))
    return cut(_merged(parts.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))), "repeats-spans")


def _merged(lists: DataFrame) -> DataFrame:
    """Each document's spans, put together where they touch. A document has no more than it has windows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, offsets = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
            a, b = (spans.field(k).to_numpy() for k in (0, 1))
            rows = []
            for low, high in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True):
                order = np.argsort(a[low:high], kind="stable")
                begin, end = a[low:high][order], np.maximum.accumulate(b[low:high][order])
                opens = np.append(True, begin[1:] > end[:-1])
                closes = np.append(opens[1:], True)
                rows.append([{"a": x, "b": y} for x, y in zip(begin[opens].tolist(), end[closes].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, _SPANS)], names=["id", "th", "spans"])

    return lists.mapInArrow(merge, "id long, th long, spans array<struct<a:long,b:long>>")


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th")


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) less all bytes under repeated strings: doc_id, n_bytes, spans (removed, merged) and kept.

    A text is its UTF-8 bytes, null being empty. A string of `size` bytes is repeated if it starts anywhere else too,
    in the same document or another; all its places lose it, judged on the input. Equal rows are documents of their
    own, and repeat each other. Other columns are ignored. No documents: no rows.
    """
    keyed = docs.select("doc_id", "text", *_keyed(docs))
    spans = repeated_spans(keyed.select("id", "th", "text"), size)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), _SPANS, pa.binary()]
        for batch in batches:
            for part in by_bytes(batch, 1, CHUNK):
                rows = []
                for doc_id, text, found in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text, found = text or b"", found or []
                    cuts = [0, *(x for s in found for x in (s["a"], s["b"])), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    rows.append((doc_id, len(text), found, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = _on_document(keyed, spans, "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")


def op4_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    """What exact substring dedup removes of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return without_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
