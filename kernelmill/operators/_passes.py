"""Strings as written rows of observed features, and sums over them: one pass of the tasks, for any number of strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialized
from .learn import MOST_CELLS, PIECE, added

#: Cells of the tables that a task works on at once.
CELLS = 4_000_000


class CodedRows:
    """Rows (meta array<double>, idx array<int>): numbers of a string, and its features."""

    def __init__(self, rows: DataFrame, name: str):
        self.rows, self.spark = materialized(rows, name), rows.sparkSession
        self.parts = max(1, self.rows.select(F.spark_partition_id().alias("p")).distinct().count())

    def sums(self, given: tuple, shapes: list[tuple], add: Callable, width: int) -> list[np.ndarray]:
        """Arrays of these shapes, to which add(arrays, given, meta, Block) adds what a block of rows has. width: columns of its tables.

        given is broadcast for the pass. Tasks give their sums in pieces, which are added up in the driver where they are few and small, else in two levels.
        """
        shared = self.spark.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals, own = [np.zeros(x) for x in shapes], shared.value
            for b in batches:
                each = 1 + len(b.column(1).flatten()) // max(1, b.num_rows)
                step = max(1, CELLS // (max(1, width) * each))
                for a in range(0, b.num_rows, step):
                    part = b.slice(a, step)
                    meta = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    add(totals, own, meta, Block(part.column(1)))
            flat = np.concatenate([x.reshape(-1) for x in totals])
            at = range(0, len(flat), PIECE)
            cols = [[0] * len(at), list(range(len(at))), [TaskContext.get().partitionId()] * len(at)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in cols), pa.array([flat[x : x + PIECE].tobytes() for x in at], pa.binary())], names=["fold", "piece", "part", "data"])

        pieces = self.rows.mapInArrow(run, "fold int, piece int, part int, data binary")
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        if self.parts * int(ends[-1]) <= MOST_CELLS // 10:
            total = np.zeros(int(ends[-1]))
            for r in pieces.collect():
                x = np.frombuffer(r["data"])
                total[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] += x
        else:
            total = added(pieces)[0]
        shared.destroy()
        return [total[e - int(np.prod(x)) : e].reshape(x) for e, x in zip(ends, shapes)]


class Block:
    """The features of some rows: row and idx of each, in the order of the rows."""

    def __init__(self, idx: pa.ListArray):
        lens = idx.value_lengths().to_numpy(zero_copy_only=False)
        self.n, self.idx = len(lens), idx.flatten().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(lens)), lens)
        self.full, self.starts = np.flatnonzero(lens > 0), (np.cumsum(lens) - lens)[lens > 0]

    def dots(self, x: np.ndarray) -> np.ndarray:
        """[rows, columns]: the sums of the rows of x that stand for a row's features."""
        out = np.zeros((self.n, x.shape[1]))
        if len(self.full):
            out[self.full] = np.add.reduceat(x[self.idx], self.starts, axis=0)
        return out

    def scatter(self, total: np.ndarray, values: np.ndarray) -> None:
        """Adds each row's values to its features' rows of total."""
        for j in range(values.shape[1]):
            total[:, j] += np.bincount(self.idx, values[self.row, j], len(total))


def padded_rows(x: np.ndarray) -> np.ndarray:
    """With a row of zeros, for features that aren't observed."""
    return np.concatenate([x, np.zeros((1, x.shape[1]))])
