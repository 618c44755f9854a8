"""Token ids in Arrow files of equal-length sequences.

Layout: one pair of files per range of ids. ``tokens-<range>.arrow`` is an Arrow IPC file
whose batches hold fixed-size lists: ``ids`` (unsigned 16-bit where the vocabulary fits,
else 32-bit) and ``mask`` (true where an id is real). Every batch but the last has the
same number of sequences, so sequence i is row i % B of batch i // B and is read without
copying from a memory map. ``docs-<range>.arrow`` says where each document starts in the
range's ids. Ids run in ascending order of the document id, across ranges too.

Spark deals the texts into ranges of the id, whatever its type, and sorts each; a task encodes
and writes one range. Equal ids are told apart by their texts' hashes and rows, so a hot id
is split like any other range. File names hold the run and the attempt, and the manifest
that is written beside them says which files count: a repeated or speculative task leaves
at most a stray file, and no other run's file is ever touched.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.tokens import encoder
from cairn.session import checkpoint, run_dir, text_batches

SEQUENCE = 2048
BATCH = 64
RANGE_DOCS = 8192
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Writes one range's ids and documents; holds one batch at a time."""

    def __init__(self, uri: str, name: str, dtype: type, sequence: int, batch: int) -> None:
        self.fs, base = _filesystem(uri)
        self.paths = [f"{base}/{kind}-{name}.arrow" for kind in ("tokens", "docs")]
        self.sequence, self.batch, self.dtype = sequence, batch, dtype
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(dtype), sequence), "mask": pa.list_(pa.bool_(), sequence)})
        self.out = self.fs.open_output_stream(self.paths[0])
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held, self.n_held, self.total = [], 0, 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.sequence * self.batch:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        full = self.sequence * self.batch
        while len(ids) >= full or last and len(ids):
            now, ids = ids[:full], ids[full:]
            rows = -(-len(now) // self.sequence)
            mask = np.arange(rows * self.sequence) < len(now)
            now = np.concatenate([now, np.zeros(rows * self.sequence - len(now), self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (now, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n_held = [ids], len(ids)

    def close(self, id_type: pa.DataType) -> tuple[str, str, int, int]:
        self._flush(last=True)
        self.file.close()
        self.out.close()
        table = pa.table({"doc_id": pa.array([x[0] for x in self.docs], id_type), "start": pa.array([x[1] for x in self.docs], pa.int64()), "n_tokens": pa.array([x[2] for x in self.docs], pa.int64())})
        with self.fs.open_output_stream(self.paths[1]) as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)
        return self.paths[0], self.paths[1], self.total, len(self.docs)


def write_token_files(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, sequence: int = SEQUENCE, batch: int = BATCH, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Encode every whole text, append end_id, write the files below uri; returns the manifest.

    The manifest (place, tokens_path, docs_path, n_tokens, n_docs, start), also written below
    uri, has a row for each range in order; start is the position of its first id. Null text
    counts as empty. Rows are ordered by id (null first) and, where ids repeat, by their
    texts' hashes; each row is a document. Other columns are ignored. An empty table has an
    empty manifest. uri may name any store that Arrow and Spark open; executors must reach it.
    """
    spark = docs.sparkSession
    text_batches(spark)
    ranges = max(1, -(-docs.count() // range_docs))
    files, base = _filesystem(uri)
    files.create_dir(base, recursive=True)
    run_id = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, keeps_space=False)
        narrow = np.uint16 if own.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        end, task = int(end_id).to_bytes(4, "little"), TaskContext.get()
        writer, id_type, done = None, pa.int64(), []
        for part in batches:
            if writer is None:
                writer, id_type = _Writer(uri, f"{task.partitionId():08d}-{run_id}-{task.taskAttemptId()}", narrow, sequence, batch), part.column(0).type
            for key, ids in zip(part.column(0).to_pylist(), own.ids(part.column(1).to_pylist()), strict=True):
                writer.add(key, np.frombuffer(ids + end, "<u4").astype(narrow))
        if writer:
            done.append((task.partitionId(), *writer.close(id_type)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["place", "tokens_path", "docs_path", "n_tokens", "n_docs"])

    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first(id_col), F.col("_hash"), F.col("_row")]
    dealt = (rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)).sortWithinPartitions(*order)
    written = checkpoint(dealt.select(id_col, text_col).mapInArrow(write, "place long, tokens_path string, docs_path string, n_tokens long, n_docs long"))
    # a row for each range_docs documents: few enough for one window
    start = F.sum("n_tokens").over(Window.orderBy("place")) - F.col("n_tokens")
    written.withColumn("start", start).write.parquet(f"{uri}/manifest-{run_id}")
    return spark.read.parquet(f"{uri}/manifest-{run_id}")


def open_tokens(uri_or_path: str, files=None):
    """The Arrow file reader; local files are memory-mapped, so batches point into the file."""
    from pyarrow import fs

    if files is None:
        files, uri_or_path = _filesystem(uri_or_path)
    local = isinstance(files, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(uri_or_path) if local else files.open_input_file(uri_or_path))


def sequence_at(reader, i: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence i: the ids are a view of the file, one batch is touched."""
    part = reader.get_batch(i // batch)
    size = part.schema.field("ids").type.list_size
    row = i % batch
    ids = part.column(0).flatten().slice(row * size, size).to_numpy(zero_copy_only=True)
    return ids, part.column(1).flatten().slice(row * size, size).to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame, uri: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for tokens_path, docs_path, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                files, _ = _filesystem(uri)
                reader, docs = open_tokens(tokens_path, files), open_tokens(docs_path, files).read_all()
                cache: dict[int, np.ndarray] = {}

                def ids(start: int, stop: int, reader=reader, cache=cache) -> Iterator[np.ndarray]:
                    size = reader.schema.field("ids").type.list_size * reader.get_batch(0).num_rows
                    while start < stop:
                        at = start // size
                        if at not in cache:
                            cache.clear()
                            cache[at] = reader.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                        yield cache[at][start - at * size : stop - at * size]
                        start = (at + 1) * size

                sums = []
                for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                    crc = 0
                    for x in ids(start, start + n):
                        crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                starts = pa.array(docs.column("start").to_numpy() + first, pa.int64())
                yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), starts, docs.column("n_tokens").combine_chunks(), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return manifest.select("tokens_path", "docs_path", "start").repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write docs' ids below uri (a folder of this application, deleted with it, where None) and read every document back."""
    uri = uri or f"{run_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, uri, id_col, text_col, **options)
    return read_token_files(manifest, uri, docs.schema[id_col].dataType.simpleString(), id_col)
