"""What the two vector searches share: cells of the whole table, a first pass for bounds, and a second where they ask for it.

A space (see ``Space``) cuts the vectors into cells, fitted on a bounded sample; every row is assigned to one, and what the search may
conclude of a cell (a radius, a box) comes from all its rows. Queries lie in groups of one cell. First each group searches its own cell, which
gives every query a kth best score. Then a group goes to those other cells alone in which some of its queries may find better.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, ship, small

ship(__name__)

BLOCK_ROWS = 4096  # vectors of a cell that are searched together
QUERY_ROWS = 4096  # queries of a group
SAMPLE = 20_000  # rows that cells are fitted on, at most
MOST_CELLS = 1024


class Space(Protocol):
    """How vectors of one dimension are cut into cells and searched. Instances travel to the tasks."""

    def fit(self, sample: np.ndarray, cells: int) -> object:
        """The cells' model; a single cell if the sample is empty."""

    def assign(self, model: object, data: np.ndarray) -> np.ndarray:
        """Each row's cell."""

    def extent(self, model: object, cell: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends, by axis, of some rows of a cell; a cell's extent spans those of all its rows."""

    def worth(self, model: object, cells: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """(queries, cells): may the cell hold something better than the query's kth score (-inf: it has none yet)?"""

    def search(self, ids: np.ndarray, data: np.ndarray, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score): for each query its k best rows of distinct ids but its own, if they reach kth."""


def usable(vectors: DataFrame, value: Callable[[Column], Column], zero: bool) -> DataFrame:
    """vec_id (not null), v: array<double>. Vectors that are null or empty, or hold a null or non-finite component, go;
    with zero=False also those of zeros alone. value: what a component becomes."""
    v = F.transform("embedding", lambda x: value(x.cast("double")))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(~bad)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def distinct_best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, highest score first, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first[:k]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)


def _assign(space: Space, models: dict[int, object]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                dims = part.column("v").value_lengths().to_numpy()
                cell = np.zeros(len(dims), dtype=np.int32)
                for dim in np.unique(dims):
                    if dim in models:
                        mine = np.flatnonzero(dims == dim)
                        cell[mine] = space.assign(models[dim], _matrix(part.column("v").take(pa.array(mine)), dim))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(dims.astype(np.int32)), pa.array(cell)], names=[*part.schema.names, "dim", "cell"])

    return run


def _pack(most: int):
    """Sorted rows of cells to packs of at most `most` vectors, each with a name of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        key, rows = None, 0

        def emit() -> pa.RecordBatch:
            nonlocal made, rows
            made += 1
            ids = np.concatenate([h.column("vec_id").to_numpy() for h in held]).astype("<i8")
            data = np.concatenate([_matrix(h.column("v"), key[0]) for h in held])
            held.clear()
            rows = 0
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"]), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["pack", "dim", "cell", "ids", "data"])

        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0)) + 1, [len(dims)]]) if len(dims) else np.zeros(1, int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and key != (dims[a], cells[a]):
                    yield emit()
                key = (int(dims[a]), int(cells[a]))
                while a < b:
                    take = min(b - a, most - rows)
                    held.append(batch.slice(a, take))
                    a, rows = a + take, rows + take
                    if rows == most:
                        yield emit()
        if held:
            yield emit()

    return run


PACK_DDL = "pack string, dim int, cell int, ids binary, data binary"


def _extents(space: Space, models: dict[int, object]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] in models:
                    low, high = space.extent(models[r["dim"]], r["cell"], np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"]))
                    n = len(low)
                    yield pa.RecordBatch.from_arrays([pa.array([r["dim"]] * n, pa.int32()), pa.array([r["cell"]] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=["dim", "cell", "axis", "low", "high"])

    return run


def _further(space: Space, models: dict[int, object], spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Groups with their kth scores to the other cells that are worth a search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] in spans:
                    cells, low, high = spans[r["dim"]]
                    queries = np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"])
                    some = space.worth(models[r["dim"]], cells, low, high, queries, _kth(r, len(queries))).any(axis=0)
                    to = cells[some & (cells != r["cell"])]
                    yield pa.RecordBatch.from_arrays([pa.array([r["pack"]] * len(to), pa.string()), pa.array(to, pa.int32())], names=["pack", "cell"])

    return run


def _kth(row: dict, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    for x in row.get("known") or ():
        out[x["row"]] = x["kth"]
    return out


def _searched(space: Space, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, own = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                data, queries = (np.frombuffer(r[c], "<f8").reshape(-1, r["dim"]) for c in ("data", "q_data"))
                row, found, score = space.search(ids, data, own, queries, _kth(r, len(own)), k)
                yield pa.RecordBatch.from_arrays([pa.array([r["pack"]] * len(row), pa.string()), pa.array(row.astype(np.int32)), pa.array(own[row]), pa.array(found), pa.array(score)], names=["pack", "row", "query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, asked: Column, k: int, space: Space, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for each query; ties to the smaller vec_id.

    rows: vec_id, v. asked: which rows are queries. A query with a repeated vec_id is asked once for each of its rows' vectors, the
    best of them counting; rows of one vec_id are one candidate, with their best score. A query's own rows are skipped by their vec_id. Vectors meet those
    of equal dimension only. The cells' model holds at most MOST_CELLS cells and is fitted on at most SAMPLE rows; all rows are indexed.
    """
    rows = cut_lineage(rows.withColumn("asked", asked))
    n = rows.count()
    every = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(every)) == 0).select("v").limit(SAMPLE).toArrow().column("v").to_pylist()
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    cells = lambda part: max(1, min(MOST_CELLS, -(-n * part // (len(sample) * BLOCK_ROWS))))
    models = {dim: space.fit(np.array(own, dtype=float), cells(len(own))) for dim, own in sorted(by_dim.items())}
    placed = cut_lineage(rows.mapInArrow(_assign(space, models), "vec_id long, v array<double>, asked boolean, dim int, cell int"))

    def packs(df: DataFrame, most: int) -> DataFrame:
        sizes = cut_lineage(df.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks")))  # a row a cell
        dealt = df.join(small(sizes), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
        return cut_lineage(dealt.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell").select("dim", "cell", "vec_id", "v").mapInArrow(_pack(most), PACK_DDL))

    index, groups = packs(placed, BLOCK_ROWS), packs(placed.where("asked"), QUERY_ROWS)
    spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    told: dict[int, dict[int, dict]] = {}
    for r in index.mapInArrow(_extents(space, models), "dim int, cell int, axis int, low double, high double").groupBy("dim", "cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # axes x cells
        told.setdefault(r.dim, {}).setdefault(r.cell, {})[r.axis] = (r.low, r.high)
    for dim, own in told.items():
        names = sorted(own)
        ends = np.array([[own[c][a] for a in sorted(own[c])] for c in names])
        spans[dim] = (np.array(names), ends[:, :, 0], ends[:, :, 1])
    asks = groups.withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    found_ddl = f"pack string, row int, query_id long, vec_id long, score {score}"

    def met(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(F.xxhash64("pack", "ids")).mapInArrow(_searched(space, k), found_ddl)

    near = cut_lineage(met(asks.join(index.drop("pack"), ["dim", "cell"])))
    # The kth best of each query so far; a group holds QUERY_ROWS queries at most.
    top = near.groupBy("pack", "row", "vec_id").agg(F.max("score").alias("score"))
    seat = F.row_number().over(Window.partitionBy("pack", "row").orderBy(F.desc("score"), "vec_id"))
    known = top.withColumn("seat", seat).where(F.col("seat") == k).groupBy("pack").agg(F.collect_list(F.struct("row", F.col("score").cast("double").alias("kth"))).alias("known"))
    bounded = cut_lineage(asks.join(known, "pack", "left"))
    to = bounded.withColumnsRenamed({"q_data": "data"}).select("pack", "dim", "cell", "data", "known").mapInArrow(_further(space, models, spans), "pack string, cell int")
    far = met(to.join(bounded.drop("cell"), "pack").join(index.drop("pack"), ["dim", "cell"]))
    best = near.unionByName(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
