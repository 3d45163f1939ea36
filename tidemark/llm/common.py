"""What the operators of this folder share: reading tables, intermediate tables, words."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "shared_folder", "ship", "table", "split_words", "word_keys", "mix", "binary_of", "array_of", "small", "slices", "give_back"]


def ship(name: str) -> None:
    """Executors need not have the module: its functions travel with the task."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_BROADCAST_ROWS = 500_000  # of a few longs each: some 20 MB


def small(df: DataFrame) -> DataFrame:
    """For a written table of few longs a row: broadcast it if its counted rows allow, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_ROWS else df


def slices(batch: pa.RecordBatch, *columns: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about a MB of the texts in `columns` (or one longer row): the arrays of words take many times the texts' bytes."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    starts = np.flatnonzero(np.diff(np.cumsum(size + 64) // most, prepend=-1))
    for at, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
        yield batch.slice(int(at), int(end - at))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words per text and all words in order; words end at the six ASCII space characters. Null is empty.

    lower: A-Z of the words lower-cased (not of the texts: on a widened slice the library's function errs).
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = parts.flatten()
    some = np.asarray(pc.not_equal(words, "").to_numpy(zero_copy_only=False), dtype=bool)
    counts = np.asarray(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not some.all():  # an empty text, or space at an end, leaves empty parts
        before = np.concatenate([[0], np.cumsum(some)])
        ends = np.cumsum(counts)
        counts = before[ends] - before[ends - counts]
        words = words.filter(pa.array(some))
    return counts, pc.ascii_lower(words) if lower else words


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, computed once for each distinct word of the batch."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    keys = np.fromiter(
        (digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary)
    )
    return keys[coded.indices.to_numpy()]


def give_back() -> None:
    """Hand memory that is free back to the system, at the end of a task: Python workers stay, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def binary_of(x: np.ndarray) -> bytes:
    """The array's bytes, all lowest bytes first: small values then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def array_of(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, dtype=np.uint8).reshape(size, len(data) // size)
    return np.ascontiguousarray(flat.T).reshape(-1).view(dtype)
