"""Token ids as Arrow stream files of equal-length sequences.

A shard is one Arrow IPC stream of record batches with three fixed-size lists in each row: `tokens` (length
ids), `real` (bit mask: a token stands there, no padding) and `ends` (bit mask: the last token of a document). Only the
last row of a shard is padded. Batches have the same number of rows (the last may have fewer) and no nulls, so all
take the same number of bytes: sequence i lies in the batch at head + (i // rows) * stride, found without an index.
A memory-mapped shard gives views of the file, nothing is copied. Beside it stands a stream of the shard's document ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, give_back, shared_folder, ship
from tidemark.llm.tokens import encoder

ship(__name__)

LENGTH = 2048  # tokens of a sequence
ROWS = 64  # sequences of a batch
TEXT_BYTES_A_SHARD = 12_000_000


def _fs(path: str):
    """The folder's file system: a URI as Spark writes it, or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def schema_of(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if np.dtype(dtype).itemsize == 2 else pa.uint32()
    return pa.schema([pa.field("tokens", pa.list_(pa.field("item", ids, nullable=False), length), nullable=False)] + [pa.field(n, pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False) for n in ("real", "ends")])


class ShardWriter:
    """Takes ids and document ends piece by piece; holds less than a batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema, self.length, self.rows = schema_of(dtype, length), length, rows
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.ends = [np.empty(0, dtype)], [np.empty(0, bool)]
        self.held = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids)
        self.ends.append(ends)
        self.held += len(ids)
        size = self.length * self.rows
        if self.held >= size:
            ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
            whole = self.held - self.held % size
            for at in range(0, whole, size):
                self._batch(ids[at : at + size], np.ones(size, bool), ends[at : at + size])
            self.ids, self.ends, self.held = [ids[whole:].copy()], [ends[whole:].copy()], self.held - whole

    def _batch(self, ids: np.ndarray, real: np.ndarray, ends: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, real, ends), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
            pad = -self.held % self.length
            self._batch(np.append(ids, np.zeros(pad, ids.dtype)), np.arange(self.held + pad) < self.held, np.append(ends, np.zeros(pad, bool)))
        self.writer.close()


@dataclass
class Sequence:
    tokens: np.ndarray  # a view of the file
    real: np.ndarray
    ends: np.ndarray


class Shard:
    """Random access to a shard that is memory-mapped (local path) or held in a buffer."""

    def __init__(self, source: str | pa.Buffer):
        self.buffer = pa.memory_map(source).read_buffer() if isinstance(source, str) else source
        reader = pa.BufferReader(self.buffer)
        self.schema = pa.ipc.read_schema(reader)
        self.head = reader.tell()
        self.length = self.schema.field("tokens").type.list_size
        try:
            first = pa.ipc.read_message(reader)
        except EOFError:
            first = None
        if first is None:
            self.rows = self.stride = self.n = 0
            return
        self.stride = reader.tell() - self.head
        self.rows = pa.ipc.read_record_batch(first, self.schema).num_rows
        whole = max(0, (self.buffer.size - self.head - 8) // self.stride)  # 8 bytes end the stream
        tail_at = self.head + whole * self.stride
        tail = self.buffer.size - tail_at > 8
        self.n = whole * self.rows + (self._batch_at(tail_at).num_rows if tail else 0)

    def _batch_at(self, offset: int) -> pa.RecordBatch:
        reader = pa.BufferReader(self.buffer)
        reader.seek(offset)
        return pa.ipc.read_record_batch(pa.ipc.read_message(reader), self.schema)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> Sequence:
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch = self._batch_at(self.head + i // self.rows * self.stride)
        row = i % self.rows * self.length
        tokens, real, ends = (batch.column(c).values.slice(row, self.length) for c in range(3))
        return Sequence(tokens.to_numpy(), real.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False))


# --- writing --------------------------------------------------------------------------------------------------

MANIFEST_DDL = "shard int, path string, docs long, tokens long"


def _write(folder: str, path: str, length: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(path), TaskContext.get().partitionId()
        store, root = _fs(folder)
        # A repeated or second attempt writes files of its own; only those of the committed one are in the manifest.
        name = f"{root.rstrip('/')}/shard-{part:06d}-{uuid.uuid4().hex}"
        docs = tokens = 0
        writer = names = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                sizes, ids = encode.encode(piece.column("text"))
                if writer is None:
                    sinks = [store.open_output_stream(f"{name}.{kind}") for kind in ("arrows", "docs")]
                    writer = ShardWriter(sinks[0], encode.dtype, length, rows)
                    names = pa.ipc.new_stream(sinks[1], pa.schema([("doc_id", pa.int64())]))
                ends = np.zeros(len(ids), bool)
                ends[np.cumsum(sizes) - 1] = True
                writer.add(ids, ends)
                names.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64())], names=["doc_id"]))
                docs, tokens = docs + piece.num_rows, tokens + len(ids)
        if writer is not None:
            writer.close()
            names.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [name], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})
        give_back()

    return run


def write_token_files(docs: DataFrame, path: str, length: int = LENGTH, rows: int = ROWS, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Write ids in ascending doc_id order; returns the manifest (shard, path, docs, tokens, start).

    docs: doc_id, text; other columns are not read. Every text is encoded whole, ends with id 1; a null text is empty, so it is the
    end id alone. Null doc_ids come first; rows of one doc_id stand in the order of a hash of their texts (equal
    rows are equal anyway). An empty table gives an empty manifest. start: tokens of all shards before. Each shard is one
    task's range of doc_ids, about TEXT_BYTES_A_SHARD of text; a doc_id with many rows is split by the hash.
    The folder is in spark.checkpoint.dir unless given; it must be one that pyarrow can write to.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    store, root = _fs(folder)
    store.create_dir(root, recursive=True)
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards is None:
        shards = max(1, -(-(rows_in.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // TEXT_BYTES_A_SHARD))
    keyed = rows_in.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("tie")
    manifest = cut_lineage(ranged.mapInArrow(_write(folder, path, length, rows), MANIFEST_DDL))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


# --- reading --------------------------------------------------------------------------------------------------

DOC_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, root = _fs(row["path"])
            with store.open_input_stream(root + ".docs") as f:
                names = pa.ipc.open_stream(f).read_all().column("doc_id").combine_chunks()
            sizes, crcs, size, crc = [], [], 0, 0
            with store.open_input_stream(root + ".arrows") as f:
                for part in pa.ipc.open_stream(f):
                    tokens, real, ends = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(3))
                    tokens, ends = tokens[real].astype("<u4"), np.flatnonzero(ends[real]) + 1
                    for k, piece in enumerate(np.split(tokens, ends)):
                        crc, size = zlib.crc32(piece.data, crc), size + len(piece)
                        if k < len(ends):
                            sizes.append(size)
                            crcs.append(crc)
                            size = crc = 0
            if len(sizes) != len(names) or len(sizes) != row["docs"] or sum(sizes) != row["tokens"]:
                raise ValueError(f"{row['path']}: {len(sizes)} documents, {row['docs']} expected")
            n = np.array(sizes, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(row["start"] + np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = manifest.sparkSession
    tasks = tasks or max(1, manifest.count() // 2)
    return manifest.repartition(tasks, "shard").mapInArrow(_read, DOC_DDL)
