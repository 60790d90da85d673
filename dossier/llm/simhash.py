"""SimHash near-duplicates by an inverted index over the bytes of fingerprints, with count filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, spread
from dossier.llm.components import connected_components
from dossier.llm.word_tokens import by_bytes

SEED = 42
BYTES = 8
#: Bytes of texts whose shingles are hashed at once; a longer text is alone.
PART_BYTES = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, words_per_shingle: int = 3) -> list[int]:
    """XXH64 of a text's word shingles: lower-cased A-Z, repeats included; of all words if they are fewer."""
    words = text.lower().split() if text else []
    if len(words) <= words_per_shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :], strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of runs of hashes, counts long each: the bits that are set in over half of a run; 0 for an empty run.

    Eight bits of every byte lane are summed at once; a lane holds 255, so longer runs are summed in pieces.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    pieces, owner = [], []
    for k, (end, n) in enumerate(zip(ends.tolist(), counts[full].tolist(), strict=True)):
        own = range(end - n, end, 255)
        pieces.extend(own)
        owner.extend([k] * len(own))
    firsts = np.searchsorted(np.array(owner), np.arange(len(full)))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, pieces)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        over = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] |= over.view("<u8").ravel() << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and more, as it is, of every row of docs (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("long"), "text", *more)
    kinds = {"doc_id": "long", "fp": "long"} | dict(given.dtypes[2:])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in by_bytes(batch, 1, PART_BYTES):
                hashes = [shingle_hashes(text) for text in part.column(1).cast(pa.binary()).to_pylist()]
                counts = np.array([len(h) for h in hashes])
                flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(majority_bits(flat, counts).view(np.int64)), *part.columns[2:]], names=list(kinds))

    return given.mapInArrow(batches, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def _byte_mask(positions: Iterable[int]) -> int:
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _ways(distance: int) -> list[tuple[int, ...]]:
    """Positions under which lists are keyed: each two of distance + 2 groups of the bytes, of about one size.

    `distance` differing bytes touch as many groups at most, so two fingerprints that close agree in one way or more.
    """
    groups = np.array_split(np.arange(BYTES), min(BYTES, distance + 2))
    return [tuple(map(int, np.concatenate(two))) for two in combinations(groups, 2)]


def byte_postings(fps: DataFrame, distance: int = 2) -> DataFrame:
    """The inverted index: fp under its positional bytes, with way, the number of the positions.

    A list for one byte value would hold a 256th of the corpus, and its pairs the square of that, so lists are split
    by further positional bytes: for distance 2 each holds the fingerprints with four bytes in common, in six ways.
    """
    ways = _ways(distance)
    kept = F.array(*(F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(_byte_mask(way))).alias("bytes")) for k, way in enumerate(ways)))
    return fps.select("fp", F.explode(kept).alias("key")).select("fp", "key.way", "key.bytes")


def tallied_pairs(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints that meet in a list, once each, with shared: their equal positional bytes."""
    left, right = (byte_postings(fps, distance).toDF(*names) for names in (("a", "way", "bytes"), ("b", "way_", "bytes_")))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    same = lambda positions: differing.bitwiseAND(F.lit(_byte_mask(positions))) == 0
    first = F.coalesce(*(F.when(same(way), k) for k, way in enumerate(_ways(distance))))
    met = left.join(right, (F.col("way") == F.col("way_")) & (F.col("bytes") == F.col("bytes_")) & (F.col("a") < F.col("b")))
    shared = sum((same([p]).cast("int") for p in range(BYTES)), F.lit(0))
    return met.filter(F.col("way") == first).select("a", "b", shared.alias("shared"))


def fingerprint_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (fp) that differ in at most `distance` bits, with shared, their equal bytes.

    Such pairs differ in at most `distance` bytes, so 8 - distance shared ones are guaranteed: pairs whose tally is
    less are dropped, and the others verified by their bits. All is decided as a pair is met, so what the join returns
    are the links: of one fingerprint C(64, 2) + 64 at most, however many documents have it.
    """
    enough = tallied_pairs(fps, distance).filter(F.col("shared") >= BYTES - distance)
    return enough.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def _with_roots(nodes: DataFrame) -> DataFrame:
    """nodes (distinct fp, and least) with root, one of each component's fingerprints."""
    roots = connected_components(cut(fingerprint_links(nodes.select("fp")), "fingerprint-links"))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, fp, fingerprint in hex, component_id.

    Documents with one fingerprint are one node, so copies of a text are never paired. component_id is the smallest
    doc_id reachable over links of 2 or fewer differing bits. Null, empty and blank texts have fingerprint zero, which
    links like any other; a null doc_id is nobody's smallest (a component of such rows alone has null). Rows that
    share a doc_id are documents of their own. No documents: no rows.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _with_roots(nodes)
    least = named.groupBy(F.col("root").alias("root_")).agg(F.min("least").alias("component_id"))
    of_fp = cut(named.join(least, F.col("root") == F.col("root_")).select(F.col("fp").alias("fp_"), "component_id"), "components-of")
    return rows.join(of_fp, F.col("fp") == F.col("fp_")).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; rows without one come last.

    Of rows that share it, one with the least hash of its text, and of those with equal texts the one with the least
    hash of its columns (maps, which have no hash, aside). So rows of different components stay, whether or not they
    share a doc_id or have none. Columns may be of any type and name.
    """
    rows = cut(fingerprints(docs, F.xxhash64("text").alias("th")), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("least"))
    # A missing doc_id stands as the least long, so that the join and the choice of a row share one shuffle of the texts.
    known = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    kept = cut(_with_roots(nodes).groupBy("root").agg(F.min("least").alias("k")).select(known(F.col("k.doc_id")).alias("_kept"), F.col("k.th").alias("_kept_th")), "near-kept")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    given = docs.select(known(F.col("doc_id").cast("long")).alias("_id"), F.xxhash64("text").alias("_th"), row.alias("_row"), F.xxhash64(*plain).alias("_order"))
    same = (F.col("_id") == F.col("_kept")) & (F.col("_th") == F.col("_kept_th"))
    return given.join(kept, same, "left_semi").groupBy("_id", "_th").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def op9_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("fp")
