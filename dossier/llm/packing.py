"""Documents packed into sequences of tokens by cutting-stock patterns.

What a document has beyond whole sequences is one length of a histogram that all tasks count. cutting_stock plans
patterns for it; documents are ranked within their length, and a rank says which place of which pattern's sequence a
document has. So no document is looked for, and none is compared with another.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.byte_tokens import piece_encoder
from dossier.llm.common import bounded_broadcast, cut, spread
from dossier.llm.cutting_stock import MOST_ROWS, Plan, plan_packing
from dossier.llm.word_tokens import by_bytes

#: Tokens of a sequence.
SIZE = 2048
#: Ends every document.
END_ID = 1
#: Bytes of texts that are encoded at once; a longer text is alone.
PART_BYTES = 8 << 20

_ENCODED = "doc_id long, shard int, rest int, rank long, sequences_before long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, place long"


def encode_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens and ids (unsigned, 32 bits, little-endian) of every row of docs (doc_id, text), written out.

    shard: the task that encoded it; rest: its tokens beyond whole sequences; rank: how many rows of the shard before it
    have the same rest; sequences_before: the whole sequences of the shard's rows before it.
    """
    end = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ranks, before = TaskContext.get().partitionId(), Counter(), 0
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                rows = []
                for ids in encoder.encode(part.column(1)):
                    n = len(ids) + 1
                    rows.append((shard, n % size, ranks[n % size], before, n, np.append(ids, end).tobytes()))
                    ranks[n % size] += 1
                    before += n // size
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in _ENCODED.split(", ")])

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _ENCODED), "packing-tokens")


def _with_bases(encoded: DataFrame, size: int) -> DataFrame:
    """encoded, with what stands before its shard: whole sequences, and rows of each rest.

    A shard has at most `size` rests, so its numbers are one row; these are broadcast up to a bound of bytes and joined
    by shard beyond it. The window over all shards has a row for each task.
    """
    counts = encoded.groupBy("shard", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / size)).alias("full"))
    counts = cut(counts, "packing-counts")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("before", earlier("n", Window.partitionBy("rest").orderBy("shard")))
    rests = ranked.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("rest", "before"))).alias("rows_before"))
    full = counts.groupBy(F.col("shard").alias("_full")).agg(F.sum("full").alias("full"))
    full = full.select("_full", earlier("full", Window.orderBy("_full")).alias("full_before"))
    bases = cut(rests.join(full, F.col("shard") == F.col("_full")).withColumnRenamed("shard", "_shard").drop("_full"), "packing-bases")
    few = bounded_broadcast(bases)
    met = encoded.join(bases if few is None else few, F.col("shard") == F.col("_shard"))
    return met.withColumns({"rank": F.col("rank") + F.col("rows_before")[F.col("rest")], "sequences_before": F.col("sequences_before") + F.col("full_before")}).drop("_shard", "rows_before", "full_before")


class Places:
    """Where each rank of each length goes. first_sequence: the number of the first sequence of patterns.

    A length's ranks are dealt to the patterns that have it, in order, and then to the line. The line is laid out length
    by length; behind its last whole sequence come sequences whose sizes are powers of two, if its unit is one token.
    """

    def __init__(self, plan: Plan, histogram: dict[int, int], first_sequence: int):
        self.unit, self.size = plan.unit, plan.size
        used: dict[int, int] = {}
        self.dealt: dict[int, list[tuple[int, int, int, int]]] = {}  # of a length: first rank, sequence, number, place
        sequence = first_sequence
        for pattern, times in plan.patterns:
            place = 0
            for n, a in sorted(pattern.items(), reverse=True):
                self.dealt.setdefault(n, []).append((used.get(n, 0), sequence, a, place))
                used[n] = used.get(n, 0) + a * times
                place += a * n
            sequence += times
        self.line_sequence, self.line_place, total = sequence, {}, 0
        for n, count in sorted(plan.line.items()):
            self.line_place[n] = (used.get(n, 0), total)
            total += n * count
        whole = total - total % self.size
        self.ends, at = [], whole
        for bit in range((total - whole).bit_length() - 1, -1, -1):
            if self.unit == 1 and (total - whole) >> bit & 1:
                at += 1 << bit
                self.ends.append(at)
        self.whole = whole // self.size
        if self.unit > 1 and total > whole:
            self.ends.append(whole + self.size)
        # Rests that are one length in units are ranked one behind the other.
        self.before: dict[int, int] = {}
        seen: dict[int, int] = {}
        for rest, count in sorted(histogram.items()):
            n = -(-rest // self.unit)
            self.before[rest] = seen.get(n, 0)
            seen[n] = seen.get(n, 0) + count

    def __call__(self, rest: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, place in it) of the pieces of the rank-th row that has this rest."""
        n, rank = -(-rest // self.unit), rank + self.before[rest]
        first, at = self.line_place.get(n, (None, 0))
        if first is None or rank < first:
            dealt = self.dealt[n]
            begin, sequence, a, place = dealt[bisect.bisect_right(dealt, rank, key=lambda x: x[0]) - 1]
            return [(rest, sequence + (rank - begin) // a, place + (rank - begin) % a * n)]
        at += (rank - first) * n
        pieces, end = [], at + n
        while at < end:
            if at < self.whole * self.size:
                sequence, start = at // self.size, at // self.size * self.size
                stop = start + self.size
            else:
                k = bisect.bisect_right(self.ends, at)
                sequence, start, stop = self.whole + k, self.ends[k - 1] if k else self.whole * self.size, self.ends[k]
            stop = min(stop, end)
            tokens = min(rest, (stop - at) * self.unit)
            pieces.append((tokens, self.line_sequence + sequence, at - start))
            rest -= tokens
            at = stop
        return pieces


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, most_rows: int = MOST_ROWS) -> DataFrame:
    """The pieces of all documents: doc_id, start (its document's tokens before it), length, ids (unsigned, 32 bits,
    little-endian), doc_tokens (with the end id), sequence_id, and place, the order of pieces in a sequence.

    docs: doc_id, text; other columns are ignored. A document is its text's ids and the end id; a null or empty text is
    the end id alone. Its whole sequences come first, and its rest stays in one piece unless it is on the line. Rows that
    share a doc_id or have none are documents of their own; a text may be of any length. No documents: no pieces.
    The driver gets the number of documents of each rest, `size` numbers at most.
    """
    encoded = encode_documents(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), size, end_id)
    counted = encoded.groupBy("rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / size)).alias("full")).collect()
    histogram = {r.rest: r.n for r in counted if r.rest}
    places = Places(plan_packing(histogram, size, most_rows), histogram, sum(r.full for r in counted))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 5, PART_BYTES):
                rows = []
                for doc_id, rest, rank, before, tokens, ids in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                    full = tokens // size
                    each = [(size, before + k, 0) for k in range(full)] + (places(rest, rank) if rest else [])
                    start = 0
                    for length, sequence, place in each:
                        rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens, sequence, place))
                        start += length
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return _with_bases(encoded, size).select("doc_id", "rest", "rank", "sequences_before", "doc_tokens", "ids").mapInArrow(pieces, _PIECES)


def with_offsets(pieces: DataFrame) -> DataFrame:
    """pieces with the tokens before each in its sequence, instead of its place. A sequence has at most `size` pieces."""
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place")


def packed_sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """A row per sequence: sequence_id, n_tokens, n_places and ids (unsigned, 32 bits, little-endian), padded to n_places,
    which is `size` unless n_tokens is a power of two."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "ids")))
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("all"))

    def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padding = np.array([pad_id], "<u4").tobytes()
        for batch in batches:
            n = batch.column(1).to_pylist()
            places = [k if k & (k - 1) == 0 else size for k in n]
            ids = [b"".join(x["ids"] for x in own) + padding * (p - k) for own, p, k in zip(batch.column(2).to_pylist(), places, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), pa.array(ids, pa.binary())], names=["sequence_id", "n_tokens", "n_places", "ids"])

    return made.mapInArrow(pad, "sequence_id long, n_tokens long, n_places long, ids binary")


def op13_packed_sequences(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence."""
    pieces = pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return with_offsets(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
