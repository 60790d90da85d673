"""Token ids of a corpus in binary files of directly addressable codes, in ascending doc_id order."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import dac
from dossier.llm.common import MAX_TASKS, cut, shared_path, spread
from dossier.llm.word_tokens import by_bytes, word_encoder

#: Ends every document.
END_ID = 1
#: Ids after which a task starts its next file; a longer document stays whole.
FILE_IDS = 4_000_000

_MANIFEST = "shard int, part int, path string, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every whole text of docs (doc_id, text; other columns are ignored) and writes the files.

    Returns the manifest: shard, part, path, n_docs, n_ids and start, the number of ids in all files before. Documents
    are dealt into ranges of doc_id; ranges, and the files of one range, are in ascending order. Rows of one doc_id
    are ordered by their text's hash, so that even they can be dealt to several ranges; a null doc_id comes first, a
    null text is empty and leaves the end id alone. No documents: no files.
    A file that a lost or repeated task leaves behind is in no manifest. A task holds one file's chunks.
    """
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        encoder, writer = word_encoder(tokenizer), dac.Writer()

        def close() -> pa.RecordBatch:
            nonlocal writer, part
            store.create_dir(base, recursive=True)
            path = f"{base}/ids-{shard:06d}-{part:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(path) as out:
                writer.write(out)
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [len(writer)]})
            writer, part = dac.Writer(), part + 1
            return row

        for batch in batches:
            for rows in by_bytes(batch, 1):
                ids, counts = encoder.encode(rows.column(1))
                for doc_id, own in zip(rows.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    writer.add(doc_id, own, end)
                    if len(writer) >= file_ids:
                        yield close()
        if writer.doc_ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = cut(dealt.mapInArrow(write, _MANIFEST), "token-manifest")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.groupBy(F.col("shard").alias("_shard")).agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("_shard", earlier(Window.orderBy("_shard")).alias("_before"))  # a row per writing task
    files = manifest.withColumn("_within", earlier(Window.partitionBy("shard").orderBy("part"))).join(shards, F.col("shard") == F.col("_shard"))
    return cut(files.select(*manifest.columns, (F.col("_before") + F.col("_within")).alias("start")), "token-files")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32, the unsigned crc32 of its ids.

    Every file is read by one task; its documents are addressed by their starts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    codes = dac.Reader(file.read_buffer())
                sums = [zlib.crc32(codes.span(a, b).tobytes()) for a, b in zip(codes.starts[:-1].tolist(), codes.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(codes.doc_ids, pa.int64(), mask=codes.null_ids),
                        pa.array(codes.starts[:-1] + base),
                        pa.array(codes.starts[1:] - codes.starts[:-1]),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(min(files, MAX_TASKS)).mapInArrow(read, _DOCS)


def tokens_on_disk(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to new files in the shared folder and reads them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer or public_tokenizers.path("word_bpe_49k.json")), folder)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and check sum in the token files."""
    return tokens_on_disk(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
