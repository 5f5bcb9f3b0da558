"""Lists of the k highest scores of many searches: kept in a task over its tiles, then merged in a tree of groups of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a null id in arrays, and for the score of an empty place. So the id 2^63 - 1 reads as null.
NO_ID, NO_SCORE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: 2^SEARCH_BITS searches are a group, and the lists of FAN tasks are merged at once.
SEARCH_BITS, FAN = 10, 16
SCHEMA = "q long, part int, query_id long, score long, id long"


def filled(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, null as NO_ID."""
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)


class TopLists:
    """The k highest (score, then smaller id) of each of n searches, of all that was offered so far."""

    def __init__(self, n: int, k: int, least: int = NO_SCORE + 1):
        """least: lower scores are not taken."""
        self.k, self.least = k, least
        self.scores = np.full((n, k), NO_SCORE)
        self.ids = np.full((n, k), NO_ID)

    def offer_tile(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searches, columns) of a tile of scores [searches, columns] that may belong to the lists: at most k a search, of equal
        scores the first columns. Columns must stand in the order of their ids. NaN is no score."""
        limit = np.maximum(self.scores[:, -1], self.least)
        hit = s >= (limit if s.dtype.kind == "i" else limit.astype(s.dtype))[:, None]
        heavy = np.flatnonzero(hit.sum(axis=1) > self.k)
        if len(heavy):
            sub = s[heavy]
            sub = np.where(hit[heavy], sub, NO_SCORE if s.dtype.kind == "i" else -np.inf)
            at = sub.shape[1] - self.k
            kth = np.partition(sub, at, axis=1)[:, at, None]
            over, tie = sub > kth, sub == kth
            tie &= np.cumsum(tie, axis=1) <= self.k - over.sum(axis=1, keepdims=True)
            hit[heavy] = over | tie
        return np.nonzero(hit)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        own = np.unique(rows)
        r = np.concatenate([np.repeat(own, self.k), rows])
        s = np.concatenate([self.scores[own].reshape(-1), scores])
        i = np.concatenate([self.ids[own].reshape(-1), ids])
        order = np.lexsort((i, -s, r))  # NO_SCORE is its own negative; such places are set apart below
        order = order[s[order] != NO_SCORE]
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        self.scores[own], self.ids[own] = NO_SCORE, NO_ID
        self.scores[r[keep], place[keep]] = s[keep]
        self.ids[r[keep], place[keep]] = i[keep]

    def table(self, q: np.ndarray, part: int, query_id: np.ndarray) -> pa.RecordBatch:
        """The lists as rows of SCHEMA; q and query_id: the number and the id of each search."""
        r, c = np.nonzero(self.scores != NO_SCORE)
        ids, of = self.ids[r, c], query_id[r]
        cols = [
            pa.array(q[r]),
            pa.array(np.full(len(r), part, np.int32)),
            pa.array(of, mask=of == NO_ID),
            pa.array(self.scores[r, c]),
            pa.array(ids, mask=ids == NO_ID),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["q", "part", "query_id", "score", "id"])


def merged(lists: DataFrame, k: int) -> DataFrame:
    """(q, query_id, rank, id, score): the k best of each search, from a table of the lists of tasks (SCHEMA).

    Lists of FAN tasks are merged at once, level by level, for 2^SEARCH_BITS searches together: no task gets all lists of a search,
    however many tasks there were.
    """

    def merge(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
        t = t.take(order)
        q = t["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        t = t.set_column(t.schema.get_field_index("rank"), "rank", pa.array(rank.astype(np.int32) + 1))
        return t.filter(pa.array(keep))

    parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
    rows = lists.withColumn("rank", F.lit(0))
    while True:
        groups = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        rows = groups.groupBy(F.shiftright("q", SEARCH_BITS), "part").applyInArrow(merge, f"{SCHEMA}, rank int")
        parts = -(-parts // FAN)
        if parts == 1:
            return rows.select("q", "query_id", "rank", "id", "score")
