"""Exact top-k search by inner products: tiles of queries times tiles of vectors, a partial selection for each, merged lists."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir
from .toplists import NO_ID, NO_SCORE, SCHEMA, TopLists, filled, merged
from .util import release, small_batches, written

#: Bytes and rows of a tile of vectors, rows of a tile of queries, bytes of queries that are searched for in one pass.
TILE_BYTES, TILE_ROWS, QUERY_ROWS, WAVE_BYTES = 2 << 20, 4096, 1024, 32 << 20
_TILES = "len int, first long, ids array<long>, width int, data binary, norm double"


def dense(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, [rows, length] doubles) of the vectors of each length; those that are null or hold null, NaN or infinity are left out."""
    lens = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls are NaN
    starts = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    for m in np.unique(lens[lens >= 0]).tolist():
        rows = np.flatnonzero(lens == m)
        x = flat[starts[rows][:, None] + np.arange(m)]
        ok = np.isfinite(x).all(axis=1)
        yield m, rows[ok], x[ok]


def quantized(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; an error where they don't fit."""
    x = np.floor(scale * x)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise ValueError("a component is too large for 64-bit integers")
    return x.astype(np.int64)


def _tiles(vectors: DataFrame, id: str, vector: str, scale: float, rows: int, name: str) -> DataFrame:
    """The vectors as written tiles of _TILES, each of one length, in the order of their ids; first numbers its first row."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = TaskContext.get().partitionId() << 40

        def tile(m: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal n
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
            width = next(w for w in (2, 4, 8) if not x.size or np.abs(x).max() < 1 << (8 * w - 1))
            n += len(ids)
            cols = [[m], [n - len(ids)], [pa.array(ids, mask=ids == NO_ID).to_pylist()], [width], [x.astype(f"<i{width}").tobytes()], [norm]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.float64()))],
                names=["len", "first", "ids", "width", "data", "norm"],
            )

        for b in batches:
            ids = filled(b.column(0))
            for m, at, x in dense(b.column(1)):
                own = held.setdefault(m, [])
                own.append((ids[at], quantized(x, scale)))
                most = max(1, min(rows, TILE_BYTES // (4 * max(m, 1))))
                if sum(len(i) for i, _ in own) >= most:
                    i, x = np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])
                    full = len(i) - len(i) % most
                    for a in range(0, full, most):
                        yield tile(m, i[a : a + most], x[a : a + most])
                    held[m] = [(i[full:], x[full:])]
        for m, own in held.items():
            i = np.concatenate([i for i, _ in own])
            if len(i):
                yield tile(m, i, np.concatenate([x for _, x in own]))
        release()

    src = vectors.select(vectors[id].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    return written(src.mapInArrow(run, _TILES), name)


class _Tile:
    def __init__(self, len: int, first: int, ids: list | pa.Array, width: int, data: bytes, norm: float):
        self.ids = filled(pa.array(ids, pa.int64()) if isinstance(ids, list) else ids)
        self.x = np.frombuffer(data, f"<i{width}").reshape(self.ids.size, len)
        self.len, self.first, self.norm = len, first, norm
        self.as_kind: dict[str, np.ndarray] = {}

    def of(self, kind: str) -> np.ndarray:
        if kind not in self.as_kind:
            self.as_kind[kind] = self.x.astype(kind)
        return self.as_kind[kind]


def _products(q: _Tile, c: _Tile) -> np.ndarray:
    """The exact inner products of two tiles. A sum of products, and each part of it, is at most the product of the norms:
    within 24 or 53 bits floating point sums of integers are exact."""
    bound = q.norm * c.norm * (1 + 1e-9)
    kind = "f4" if bound < 2**24 else "f8" if bound < 2**53 else "i8"
    if bound >= 2**63:
        raise ValueError("scores are too large for 64-bit integers")
    return q.of(kind) @ c.of(kind).T


def _waves(tiles: DataFrame) -> Iterator[list[tuple]]:
    """Tiles of queries of WAVE_BYTES in all, or one, streamed to the driver one wave after another."""
    wave, size = [], 0
    for r in tiles.toLocalIterator():
        if wave and size + len(r["data"]) > WAVE_BYTES:
            yield wave
            wave, size = [], 0
        wave.append((r["len"], r["first"], list(r["ids"]), r["width"], bytes(r["data"]), r["norm"]))
        size += len(r["data"])
    if wave:
        yield wave


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries, the k rows of vectors with the highest inner product of floor(scale * x).

    Equal scores by smaller id, null ids last; all rows if there are fewer than k. Rows of the query's own id are left out, and so
    are vectors that are null or hold null, NaN or infinite components, on either side; vectors of another length than the query's are not
    compared with it. Repeated rows stand in a list as often as in the table, and a repeated query has a list for each of its rows.
    Empty tables give an empty result. A component or score beyond 64 bits is an error.

    Vectors are written once as tiles. Queries go out in waves of bounded size; a wave's pass multiplies each tile of queries by each tile
    of vectors, selects what can still be among the best, and keeps k of each query in the task. The lists of tasks are merged in a tree.
    Nothing but those lists is shuffled, and a task holds one tile of products and one wave.
    """
    spark = vectors.sparkSession
    shards = _tiles(vectors, id, vector, scale, TILE_ROWS, "topk-vectors")
    asked = _tiles(queries, id, vector, scale, QUERY_ROWS, "topk-queries")
    path = f"{shared_dir(spark)}/topk-lists-{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    small_batches(spark)
    for wave in _waves(asked):
        shared = spark.sparkContext.broadcast(wave)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tiles = [_Tile(*t) for t in shared.value]
            lists = [TopLists(len(t.ids), k) for t in tiles]
            for b in batches:
                cols = [b.column(j) for j in range(b.num_columns)]
                for n in range(b.num_rows):
                    m, first, ids, width, data, norm = (c[n] for c in cols)
                    c = _Tile(m.as_py(), first.as_py(), ids.values, width.as_py(), data.as_py(), norm.as_py())
                    for t, own in zip(tiles, lists):
                        if t.len == c.len:
                            _search(t, c, own)
            part = TaskContext.get().partitionId()
            for t, own in zip(tiles, lists):
                yield own.table(t.first + np.arange(len(t.ids)), part, t.ids)
            del tiles, lists
            release()

        shards.mapInArrow(run, SCHEMA).write.mode("append").parquet(path)
        shared.destroy()
    found = merged(spark.read.schema(SCHEMA).parquet(path), k)
    return found.select("query_id", "rank", "id", "score")


def _search(q: _Tile, c: _Tile, lists: TopLists) -> None:
    s = _products(q, c)
    named = np.flatnonzero(q.ids != NO_ID)
    lo, hi = (np.searchsorted(c.ids, q.ids[named], side) for side in ("left", "right"))
    for r, a, z in zip(named[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
        s[r, a:z] = NO_SCORE if s.dtype.kind == "i" else np.nan
    rows, cols = lists.offer_tile(s)
    lists.add(rows, s[rows, cols].astype(np.int64), c.ids[cols])
