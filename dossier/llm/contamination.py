"""Benchmark decontamination: containment search by MinHash sketches of items partitioned by size."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, spread
from dossier.llm.simhash import shingle_hashes
from dossier.llm.word_tokens import by_bytes
from dossier.operators.broadcasts import few_or_all

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Sketch entries that an item above the threshold has in a document at least, where its size allows.
SPARE = 2
#: UTF-8 bytes of all items up to which every task holds their index; more are searched for by joins.
INDEX_BYTES = 16 << 20
#: UTF-8 bytes of documents that are searched at once; a longer text is alone.
PART_BYTES = 1 << 20
#: Bits of the map by which shingles are sifted, at least and at most; bits for each entry; bits that are put together in a row.
SIEVE_BITS, MOST_SIEVE_BITS, SPARSE, _BITMAP = 1 << 23, 1 << 28, 16, 1 << 15

_HITS = "doc_id long, item_id long, shared long, item_shingles long, containment double"
_HIT_TYPES = [pa.int64()] * 4 + [pa.float64()]


def shingles(text: bytes, width: int) -> set[bytes]:
    """Distinct shingles of a text, lower-cased A-Z."""
    words = text.lower().split()
    return {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def may_miss(n: int, threshold: float) -> int:
    """Of n shingles, how many an item above the threshold may miss."""
    return n - math.ceil(threshold * n - 1e-9)


@dataclass(frozen=True)
class Sketch:
    """What an item is searched by: its size class, the lowest hashes of its shingles, and how many of them are needed."""

    width: int
    size_class: int
    hashes: list[int]
    need: int
    n: int


def sketch(text: str | None, threshold: float = THRESHOLD, width: int = SHINGLE_WORDS) -> Sketch | None:
    """None for a text without words.

    A shingle's hash is its rank under one random permutation, so an item's lowest hashes are a MinHash sample of its
    shingles, and the share of the sample that a document has estimates the share of the item that it contains,
    however long the document. An item of n shingles above the threshold misses floor((1 - t) n) at most. Items are
    partitioned into classes of sizes from 2^c to 2^(c+1) - 1; the sketches of a class are longer than what its largest
    item may miss, by SPARE. An item is a candidate where a document has all of its sketch but so many entries as the
    item may miss: that loses none. Shorter items than a shingle are one shingle of their own width.
    """
    data = (text or "").encode()
    own = min(width, len(data.split()))
    if not own:
        return None
    n = len(shingles(data, own))
    largest = (1 << n.bit_length()) - 1
    hashes = sorted(set(shingle_hashes(data, own)))[: min(n, may_miss(largest, threshold) + SPARE)]
    return Sketch(own, n.bit_length() - 1, hashes, max(1, len(hashes) - may_miss(n, threshold)), n)


class ItemIndex:
    """Postings of the sketches of test items, one index for each shingle width and size class."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, width: int = SHINGLE_WORDS):
        self.threshold = threshold
        self.items: list[tuple[int, bytes, int]] = []
        self.need: list[int] = []
        entries: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            if found := sketch(text, threshold, width):
                entries.setdefault((found.width, found.size_class), []).extend((h, len(self.items)) for h in found.hashes)
                self.items.append((item_id, text.encode(), found.width))
                self.need.append(found.need)
        self.postings: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (own, _), pairs in sorted(entries.items()):
            pairs.sort()
            keys = np.array([h for h, _ in pairs], np.uint64)
            unique, firsts = np.unique(keys, return_index=True)
            self.postings.setdefault(own, []).append((unique, np.append(firsts, len(keys)), np.array([k for _, k in pairs])))
        self.own_shingles = functools.lru_cache(maxsize=1024)(lambda k: shingles(self.items[k][1], self.items[k][2]))

    def search(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int]]:
        """Place of the text, item_id, shared shingles and shingles of the item, for items contained in the texts."""
        for width, classes in self.postings.items():
            hashes = [shingle_hashes(text, width) for text in texts]
            counts = np.array([len(h) for h in hashes])
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
            if not len(flat):
                continue
            ends = np.cumsum(counts)
            tally: dict[tuple[int, int], int] = {}
            for unique, firsts, owners in classes:
                at = np.minimum(np.searchsorted(unique, flat), len(unique) - 1)
                hit = np.flatnonzero(unique[at] == flat)
                places = np.searchsorted(ends, hit, side="right")
                for place, entry in np.unique(np.stack([places, at[hit]]), axis=1).T.tolist():
                    for k in owners[firsts[entry] : firsts[entry + 1]].tolist():
                        tally[place, k] = tally.get((place, k), 0) + 1
            known: dict[int, set[bytes]] = {}
            for (place, k), met in sorted(tally.items()):
                if met < self.need[k]:
                    continue
                if place not in known:
                    known = {place: shingles(texts[place] or b"", width)}
                own = self.own_shingles(k)
                shared = len(own & known[place])
                if shared >= self.threshold * len(own) - 1e-9:
                    yield place, self.items[k][0], shared, len(own)


@functools.lru_cache(maxsize=2)
def _index(items: tuple, threshold: float, width: int) -> ItemIndex:
    return ItemIndex(list(items), threshold, width)


def _few_items(items: DataFrame, most: int) -> Broadcast | None:
    """All items as sorted pairs item_id, text, broadcast; None if their texts have more than so many bytes."""
    some = items.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    if some.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] > most:
        return None
    rows = some.collect()
    return items.sparkSession.sparkContext.broadcast(tuple((r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id, r.text))))


def _texts(part: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return part.column(column).cast(pa.binary()).to_pylist()


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _named(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_SKETCHES = "item_id long, text string, copies long, width int, hash long, need int"
_SKETCH_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
_SIFTED = "doc_id long, th long, width int, hash long"
_CHECKED = "doc_id long, th long, item_id long, copies long, shared long, item_shingles long"


def _sieve(sketches: DataFrame) -> np.ndarray:
    """A map of bits of the entries' hashes, SPARSE bits an entry up to MOST_SIEVE_BITS; beyond, it only lets more through.

    The map is put together in blocks on the executors, so the driver gets its bytes and no entries.
    """
    entries, bits = sketches.count(), SIEVE_BITS
    while bits < min(SPARSE * entries, MOST_SIEVE_BITS):
        bits *= 2
    place = F.pmod("hash", F.lit(bits).cast("long"))
    blocks = sketches.groupBy(F.floor(place / _BITMAP).alias("block")).agg(F.bitmap_construct_agg(place % _BITMAP).alias("bits")).collect()
    sieve = np.zeros(bits // 8, np.uint8)
    for r in blocks:
        sieve[r.block * _BITMAP // 8 : (r.block + 1) * _BITMAP // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return sieve


def _joined_hits(docs: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame:
    """Distinct documents (doc_id, th: their text's hash) and the items that they contain, by joins over any number of items.

    Sketch entries are a table. Documents' shingles are sifted by a map of bits of the entries' hashes, so that only
    shingles of some sketch are joined with them by hash; pairs that tally what the item needs are verified on their
    texts, which are shuffled only for documents of such pairs.
    """
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long"), "text").filter("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                rows = []
                for item_id, text, copies in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if found := sketch(text, threshold, width):
                        rows.extend((item_id, text, copies, found.width, h - (h >> 63 << 64), found.need) for h in found.hashes)
                if rows:
                    yield _batch(rows, _SKETCH_TYPES, _named(_SKETCHES))

    sketches = cut(given.mapInArrow(entries, _SKETCHES).withColumn("item", F.xxhash64("item_id", "text")), "item-sketches")
    shared = spark.sparkContext.broadcast((_sieve(sketches), tuple(sorted(r.width for r in sketches.select("width").distinct().collect()))))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, widths = shared.value
        for batch in batches:
            for part in by_bytes(batch, 2, PART_BYTES):
                for k, text in enumerate(_texts(part)):
                    for own in widths:
                        found = np.unique(np.array(shingle_hashes(text, own), np.uint64)) if text else np.zeros(0, np.uint64)
                        place = found.view(np.int64) % (8 * len(sieve))
                        found = found[(sieve[place >> 3] >> (place & 7) & 1).astype(bool)].view(np.int64)
                        if len(found):
                            same = [pa.array(np.full(len(found), v, np.int64), mask=np.full(len(found), v is None)) if v is not None else pa.nulls(len(found), pa.int64()) for v in (part.column(0)[k].as_py(), part.column(1)[k].as_py())]
                            yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(found), own, np.int32)), pa.array(found)], names=_named(_SIFTED))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sifted = keyed.mapInArrow(sift, _SIFTED).distinct()
    lists = sketches.select("item", F.col("width").alias("width_"), F.col("hash").alias("hash_"), "need")
    tally = sifted.join(lists, (F.col("hash") == F.col("hash_")) & (F.col("width") == F.col("width_"))).groupBy("doc_id", "th", "item").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    pairs = cut(tally.filter("met >= need").select(F.col("doc_id").alias("doc_id_"), F.col("th").alias("th_"), "item"), "item-candidates")
    named = sketches.groupBy(F.col("item").alias("item_")).agg(F.min(F.struct("item_id", "copies", F.col("text").alias("item_text"))).alias("i"))
    candidates = few_or_all(cut(pairs.select(F.col("doc_id_").alias("doc_c"), F.col("th_").alias("th_c")).distinct(), "item-documents"))
    # Only candidates' texts are grouped: where candidates are few, no other text is shuffled.
    texts = keyed.join(candidates, F.col("doc_id").eqNullSafe(F.col("doc_c")) & (F.col("th") == F.col("th_c")), "left_semi")
    texts = texts.groupBy("doc_id", "th").agg(F.min("text").alias("text"))
    both = pairs.join(texts, F.col("doc_id_").eqNullSafe(F.col("doc_id")) & (F.col("th_") == F.col("th"))).join(named, F.col("item") == F.col("item_"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, PART_BYTES):
                rows = []
                for doc_id, th, text, item_id, copies, item in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data, wanted = text.encode(), item.encode()
                    own = min(width, len(wanted.split()))
                    found, all_of = shingles(data, own), shingles(wanted, own)
                    if len(found & all_of) >= threshold * len(all_of) - 1e-9:
                        rows.append((doc_id, th, item_id, copies, len(found & all_of), len(all_of)))
                if rows:
                    yield _batch(rows, [pa.int64()] * 6, _named(_CHECKED))

    return cut(both.select("doc_id", "th", "text", "i.item_id", "i.copies", "i.item_text").mapInArrow(verify, _CHECKED), "item-hits")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE_WORDS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Pairs doc_id, item_id where the document has at least `threshold` of the item's distinct word shingles.

    docs: doc_id, text; items: item_id, text; other columns are ignored. With shared, item_shingles and containment,
    all exact. Items are the stated queries: up to index_bytes of them are searched for in one narrow pass over the
    documents, more by joins of the sketches with the documents' shingles. Null and blank texts contain nothing and are
    contained nowhere; repeated items and documents give rows of their own, and texts may be of any length. No documents
    or no items: no rows.
    """
    few = _few_items(items, index_bytes)
    if few is None:
        hits = _joined_hits(docs, items, threshold, width)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id_"), F.xxhash64("text").alias("th_"))
        each = rows.join(hits, F.col("doc_id_").eqNullSafe(F.col("doc_id")) & (F.col("th_") == F.col("th")))
        each = each.select("doc_id", "item_id", "shared", "item_shingles", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        return each.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(few.value, threshold, width)
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                ids = part.column(0).to_pylist()
                found = [(ids[place], item, met, n, met / n) for place, item, met, n in index.search(_texts(part))]
                if found:
                    yield _batch(found, _HIT_TYPES, _named(_HITS))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, _HITS)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE_WORDS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the rows that contain an item, whatever their doc_id: rows that share it are judged by themselves."""
    few = _few_items(items, index_bytes)
    if few is None:
        hits = _joined_hits(docs, items, threshold, width).select("doc_id", "th").distinct().toDF("_hit_id", "_hit_th")
        rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
        return rows.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_th") == F.col("_hit_th")), "left_anti").select("_row.*")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(few.value, threshold, width)
        for batch in batches:
            for part in by_bytes(batch, batch.schema.get_field_index("text"), PART_BYTES):
                clean = np.ones(part.num_rows, bool)
                clean[[place for place, *_ in index.search(_texts(part))]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def op2_contained_items(spark, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return contained_items(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), k AS (
  SELECT DISTINCT least(5, len(words))::BIGINT AS width FROM w WHERE kind = 'b' AND len(words) > 0
), s AS (
  SELECT DISTINCT kind, id, width, unnest(list_transform(range(1, len(words) - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) AS shingle
  FROM w JOIN k ON (kind = 'd' AND len(words) >= width) OR (kind = 'b' AND least(5, len(words)) = width)
), n AS (SELECT id AS item_id, count(*) AS item_shingles FROM s WHERE kind = 'b' GROUP BY id
), m AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM s d JOIN s b ON d.kind = 'd' AND b.kind = 'b' AND d.width = b.width AND d.shingle = b.shingle GROUP BY ALL
)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles::DOUBLE AS containment
FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9
"""
