"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import WORD_TABLE, per_text, word_pieces, written

_BITS = 18


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a block of two words, as an index of the shift table."""
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _suffix(ids: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each position."""
    h = np.zeros(len(end), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ ids[end - k].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
    return h


class WuManber:
    """Tables for test strings that all have m words: shifts by block, and buckets by suffix hash."""

    def __init__(self, patterns: np.ndarray, items: np.ndarray):
        self.m = m = patterns.shape[1]
        flat = patterns.reshape(-1)
        ends = np.arange(len(patterns)) * m + m - 1
        self.n_suffix = min(4, m)
        hashes = _suffix(flat, ends, self.n_suffix)
        order = np.argsort(hashes, kind="stable")
        self.patterns, self.items, self.hashes = patterns[order], items[order], hashes[order]
        self.shift = np.full(1 << _BITS, max(1, m - 1), np.int64)
        for j in range(1, m):  # block of the words j-1 and j: its last place is m-1-j words before the end
            np.minimum.at(self.shift, _block(patterns[:, j - 1], patterns[:, j]), m - 1 - j)

    def find(self, ids: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, rows of self.patterns) of all occurrences; all lanes of the text advance together."""
        m, n = self.m, len(ids)
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(m - 1, n, lane)
        stop = np.minimum(at + lane, n)
        found = []
        if m == 1:
            found.append(np.arange(n))
        while m > 1 and len(at):
            skip = self.shift[_block(ids[at - 1], ids[at])]
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(found)
        h = _suffix(ids, ends, self.n_suffix)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = hi > lo
        ends, lo, hi = ends[hit], lo[hit], hi[hit]
        out_e, out_p = [], []
        while len(ends):  # the test strings of each bucket, one after another
            same = (ids[ends[:, None] + np.arange(1 - m, 1)] == self.patterns[lo]).all(axis=1)
            out_e.append(ends[same])
            out_p.append(lo[same])
            lo = lo + 1
            more = lo < hi
            ends, lo, hi = ends[more], lo[more], hi[more]
        if not out_e:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_e), np.concatenate(out_p)


def _tables(block: list[tuple[str | None, list[bytes]]], window: int) -> dict:
    """The vocabulary, and a WuManber for each number of words that a test string of the block has."""
    vocab: dict[bytes, int] = {}
    by_len: dict[int, tuple[list, list]] = {}
    for k, (_, ws) in enumerate(block):
        ids = [vocab.setdefault(w, len(vocab)) for w in ws]
        m = min(window, len(ids))
        pats, items = by_len.setdefault(m, ([], []))
        for i in range(len(ids) - m + 1):
            pats.append(ids[i : i + m])
            items.append(k)
    return {
        "vocab": vocab,
        "names": [x for x, _ in block],
        "searches": [WuManber(np.array(p, np.int64), np.array(i, np.int64)) for _, (p, i) in sorted(by_len.items())],
    }


def _blocks(bench: DataFrame, item: str, text: str, window: int, block_words: int):
    """Test sets of at most block_words words (or one item), streamed to the driver one after another."""
    block, n = [], 0
    rows = bench.select(bench[item].cast("string").alias("i"), bench[text].cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        ws = words(r["t"])
        if not ws:
            continue
        if block and n + len(ws) > block_words:
            yield _tables(block, window)
            block, n = [], 0
        block.append((r["i"], ws))
        n += len(ws)
    yield _tables(block, window)


def _scan(shared):
    """A pass that finds one block of test strings."""

    def start():
        t = shared.value
        get = t["vocab"].get

        def run(texts: list) -> dict:
            n_words, spans, items = [], [], []
            done = 0
            while done < len(texts):  # runs of texts of some hundred thousand words; a longer text is a run of its own
                parts, starts, first, size = [], [], done, 0
                while done < len(texts) and size < 200_000:
                    starts.append(size)
                    for ws in word_pieces((texts[done] or b"").translate(WORD_TABLE)):
                        parts.append(np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws)))
                        size += len(ws)
                    n_words.append(size - starts[-1])
                    parts.append(np.full(1, -1, np.int32))
                    size += 1
                    done += 1
                ids = np.concatenate(parts)
                starts = np.array(starts)
                per: list[list[tuple[int, int, int]]] = [[] for _ in range(done - first)]
                for s in t["searches"]:
                    ends, rows = s.find(ids)
                    docs = np.searchsorted(starts, ends, "right") - 1
                    for d, e, k in zip(docs.tolist(), (ends - starts[docs]).tolist(), s.items[rows].tolist()):
                        per[d].append((e - s.m + 1, e + 1, k))
                for hits in per:
                    spans.append([{"start": a, "end": b} for a, b in sorted({(a, b) for a, b, _ in hits})])
                    items.append(sorted({t["names"][k] for *_, k in hits}, key=lambda x: (x is None, x or "")))
            return {"n_words": n_words, "spans": spans, "items": items}

        return run

    return start


def find_benchmark(
    docs: DataFrame,
    bench: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    carry: list[str] | None = None,
    block_words: int = 500_000,
) -> DataFrame:
    """Occurrences of benchmark windows: struct `row` (the carried columns), n_words, n_hit, spans, items.

    spans: (start, end) word positions of every occurrence, end exclusive; items: ids of the items with
    one, as strings. The benchmark is a stated query set: it is cut into blocks of at most block_words
    words, each broadcast by itself (some 60 MB at most) and searched in one more narrow pass; with one block, the
    documents are not shuffled. A null or empty text has no words; items without words have no
    windows; a null item id is an item of its own, listed last; repeated rows are judged one by one. With several blocks the texts are
    written once under a number, each block adds its hits by number, and only one block's tables are held at a time.
    """
    spark = docs.sparkSession
    fields = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    cols = list(docs.columns) if carry is None else list(carry)
    blocks = _blocks(bench, item, item_text, window, block_words)
    shared, later = spark.sparkContext.broadcast(next(blocks)), next(blocks, None)
    if later is None:
        found = per_text(docs, text, cols, fields, _scan(shared))
    else:  # a pass for each block, which writes what it finds and lets go of its tables
        src = docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*[docs[c] for c in cols]).alias("r"), docs[text].alias("t"))
        src, hits, first = written(src, "bench-texts"), None, None
        while shared is not None:
            got = per_text(src, "t", ["n"], fields, _scan(shared)).select("row.n", "n_words", "spans", "items")
            if first is None:
                got = first = written(got, "bench-first")
            else:
                got = written(got.where(F.size("items") > 0), "bench-hits")
            shared.destroy()
            got = got.where(F.size("items") > 0).drop("n_words")
            hits = got if hits is None else hits.unionByName(got)
            shared = None if later is None else spark.sparkContext.broadcast(later)
            later = None if later is None else next(blocks, None)
        # a document's hits are a row for each block that has some
        together = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        hits = hits.groupBy("n").agg(together("spans"), together("items"))
        sized = first.select("n", "n_words").join(hits, "n", "left")
        none = {c: F.array().cast(t) for c, t in hits.dtypes if c != "n"}
        found = src.select("n", F.col("r").alias("row")).join(sized, "n").select("row", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])
    ordered = F.array_sort("spans")
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return found.select("row", "n_words", covered.alias("n_hit"), ordered.alias("spans"), F.array_sort("items").alias("items"))


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
