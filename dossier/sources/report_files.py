"""Reports as text files of bounded size, each of many reports, and an index of where each report is."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.broadcasts import few_or_all

#: Bytes after which a task starts its next file; a longer report stays whole.
FILE_BYTES = 64 << 20
#: Tasks that read files, at most.
_TASKS = 10_000

_INDEX = "request_id string, file string, offset long, length long"
_REPORTS = "request_id string, markdown string"


def save_report_files(analysed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes report.markdown_report of each row, in ranges of request_id, and the index at folder/index.

    The number of files follows the bytes, not the requests. The index is written last and names files of tasks that
    succeeded only, so what lost or repeated tasks leave behind is never read; it fails if it is there already. A null
    report is an empty text.
    """
    folder = folder if "://" in folder else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for request_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and at >= file_bytes:
                    out.close()
                    out = None
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, at = f"{base}/reports-{uuid.uuid4().hex}.md", 0
                    out = store.open_output_stream(path, compression=None)
                data = (text or "").encode()
                out.write(data + b"\n")
                rows.append((request_id, path, at, len(data)))
                at += len(data) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["request_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    texts = analysed.select(F.col("request_id").cast("string"), F.col("report.markdown_report").alias("markdown"))
    texts.repartitionByRange("request_id").sortWithinPartitions("request_id").mapInArrow(write, _INDEX).write.mode("errorifexists").parquet(f"{folder}/index")


def report_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder if '://' in folder else f'file://{folder}'}/index")


def read_report_files(spark: SparkSession, folder: str, ids: DataFrame | None = None) -> DataFrame:
    """request_id and markdown of all reports, or of those with an id in ids (request_id): only their bytes are read."""
    folder = folder if "://" in folder else f"file://{folder}"
    index = report_index(spark, folder)
    if ids is not None:
        index = index.join(few_or_all(ids.select("request_id").distinct()), "request_id", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        path, source = None, None
        for batch in batches:
            texts = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if file != path:
                    if source is not None:
                        source.close()
                    path, source = file, store.open_input_file(file)
                texts.append(source.read_at(length, offset).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["request_id", "markdown"])
        if source is not None:
            source.close()

    files = index.select(F.count_distinct("file")).first()[0]
    return index.repartition(max(1, min(files, _TASKS)), "file").sortWithinPartitions("file", "offset").mapInArrow(read, _REPORTS)
