"""Best-fit packing planned over the histogram of piece lengths.

Best-fit decreasing puts the longest pieces first, each into the fullest sequence that still has room. Pieces of one
length are alike, so the plan works on counts: for each length, runs "the next k pieces go to the sequences
b, b+1, ..., at offset o". The plan's size depends on the capacity only, not on the data. Documents then take the
planned places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, give_back, ship
from tidemark.llm.tokens import encoder

ship(__name__)

CAPACITY = 4096
ROWS_A_BUCKET = 20_000


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset) of best-fit decreasing over {length: pieces}."""
    room: dict[int, list[list[int]]] = {}  # room left -> runs [first sequence, sequences]
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = [r for r in room if r >= length]
            if not fits:
                each = capacity // length  # whole new sequences, filled with this length alone, then one more
                new = -(-left // each)
                full, rest = (new, 0) if left == new * each else (new - 1, left - (new - 1) * each)
                for count, n in ((each, full), (rest, 1 if rest else 0)):
                    if n:
                        for i in range(count):
                            rows.append((length, rank, n, opened, i * length))
                            rank += n
                        if capacity - count * length:
                            room.setdefault(capacity - count * length, []).append([opened, n])
                        opened += n
                break
            best = min(fits)
            first, n = room[best][-1]
            take = min(n, left)
            rows.append((length, rank, take, first, capacity - best))
            rank, left = rank + take, left - take
            if take == n:
                room[best].pop()
                if not room[best]:
                    del room[best]
            else:
                room[best][-1] = [first + take, n - take]
            if best > length:
                room.setdefault(best - length, []).append([first, take])
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
SEAT_DDL = ", seat long"  # a running number that a task writes beside its pieces, so that equal rows can be dealt apart


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seat = encoder(path), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, ids = encode.encode(part.column("text"))
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                cuts = np.cumsum(length)
                wide = ids.astype("<u4")
                chunks = np.split(wide, cuts[:-1])
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c.data) for c in chunks], pa.int64())]
                columns.append(pa.array(seat + np.arange(len(row)), pa.int64()))
                seat += len(row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "seat"]
                if with_ids:
                    columns, names = [*columns, pa.array([c.astype(np.int32) for c in chunks], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return run


def _places(runs: np.ndarray):
    """length, rank -> sequence, offset, by the run that holds the rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        lengths = np.unique(table[:, 0])
        begin = np.searchsorted(table[:, 0], lengths)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), dtype=np.int64)
            for value in np.unique(length):
                i = np.searchsorted(lengths, value)
                own = slice(begin[i], begin[i + 1] if i + 1 < len(lengths) else len(table))
                mine = length == value
                at[mine] = own.start + np.searchsorted(table[own, 1], rank[mine], side="right") - 1
            row = table[at]
            rest = batch.drop_columns(["rank", "shared"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*rest.schema.names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    docs: doc_id, text; other columns are not read. Every text is encoded whole and ends with id 1; null is empty, so a piece of one
    token. Texts over `capacity` tokens are cut into pieces of `capacity`, the last may be shorter. Every row
    has its pieces, also where doc_id is null or repeated. An empty table gives no rows. The histogram that is collected has
    `capacity` rows at most. Ranks within a length are dealt by buckets of about ROWS_A_BUCKET rows, so a length that many
    documents share is no hot key.
    """
    ids = ", ids array<int>" if with_ids else ""
    pieces = cut_lineage(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, with_ids), PIECE_DDL + SEAT_DDL + ids))
    counts = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # one row a length
    runs = plan(histogram, capacity)
    most = max(histogram.values(), default=1)
    shares = -(-most // ROWS_A_BUCKET)
    # Buckets are cut by a hash, so that a shorter list of rows each is ranked and shifted by the buckets before.
    dealt = pieces.withColumn("shared", F.pmod(F.xxhash64("seat", "doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    before = Window.partitionBy("length").orderBy("shared").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "shared").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "shared").orderBy("doc_id", "piece", "ids_crc32", "seat")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(shifts, ["length", "shared"])
    columns = [c for c in pieces.columns if c != "seat"]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("shift")).cast("long").alias("rank"), "shared")
    return ranked.mapInArrow(_places(runs), PIECE_DDL + ids + ", sequence_id long, offset long")
