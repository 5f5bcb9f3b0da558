"""Substring dedup with run-length indexes over the places that can repeat.

A byte goes if a `length`-byte string that covers it also starts anywhere else in the corpus. Steps:

1. `chunks`: the bytes of many documents in one row, in a table bucketed by chunk.
2. Hashes only bring together what may be equal. A window of `length` bytes is anchored at its leftmost least hash of a shorter
   string; windows of one anchor at neighbouring offsets make a segment, keyed by the hash of the bytes that all windows
   of such a segment share. Equal windows have equal keys. Segments of a key that stands at one place only can't repeat and go
   no further; those of a key with very many different contents are dealt again by fewer offsets, down to one.
3. The bytes of the other segments, one for each content in a chunk, meet in shards. A shard compares them byte by byte, builds a
   run-compressed Burrows-Wheeler transform with sampled run ends over the different ones, streams the matching statistics of
   all its segments from the samples, and marks the windows that match elsewhere. Nothing else marks a window.
4. Each chunk lays the marked windows over its bytes.

All messages are plain rows dealt by hash, so their number grows with the input and not with chunks times buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import bucketed, mix64, n_buckets, pack, release, small_batches, unpack, written

#: Bytes of a chunk (a longer text is one of its own), of windows hashed at once, for each bucket, and of a shard's text.
CHUNK_BYTES, SLICE, BUCKET_BYTES, SHARD_BYTES = 6 << 20, 1 << 19, 16 << 20, 3 << 19
#: Chunks whose equal segments are compared in one shard; further ones are compared with the first in shards of their own.
CLASS_ROWS = 64
#: No UTF-8 text holds this byte; it ends each segment of an index.
STOP = 0xFF
#: Offsets from its anchor that a segment may span: at first, for keys of very many contents, and for those that still have too many.
SPANS = (64, 8, 1)
_PLACE = 256  # a place is the first window of a segment times this, plus its windows


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for the byte values, and the powers of an odd base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    of = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
    return of, up, down


class _Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(12, len(data).bit_length())
        of, up, self.down = _powers(n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(of[data] * up[: len(data)])])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def _over(x: np.ndarray, w: int, least) -> np.ndarray:
    """The least (or greatest) of each w neighbours, by doubling."""
    have = 1
    y = x
    while 2 * have <= w:
        y = least(y[:-have], y[have:])
        have *= 2
    return least(y[: len(x) - w + 1], y[w - have : w - have + len(x) - w + 1])


def spans(length: int) -> list[int]:
    """The numbers of offsets of a segment, level by level; the last is 1, where a key is the hash of one window."""
    return sorted({max(1, min(s, length // 3)) for s in SPANS} | {1}, reverse=True)


def _segments(data: np.ndarray, lens: np.ndarray, length: int, gram: int, span: int, active: np.ndarray | None = None):
    """Of each slice of a chunk: (keys, starts, windows, content hashes) of its segments.

    lens: bytes of each document. Windows never cross an end. active: the windows to look at, all if None.
    """
    ends = np.cumsum(lens)
    low = np.uint64((1 << 20) - 1)  # a slice has fewer places
    for a in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[a : a + SLICE + length - 1]
        n = len(part) - length + 1
        at = np.arange(n)
        valid = ends[np.searchsorted(ends, at + a, "right")] - (at + a) >= length
        if active is not None:
            valid &= active[a : a + n]
        if not valid.any():
            continue
        hashes = _Hashes(part)
        m = len(part) - gram + 1
        grams = (hashes.of(slice(0, m), slice(gram, gram + m)) & ~low) | np.arange(m, dtype=np.uint64)
        anchor = (_over(grams, length - gram + 1, np.minimum) & low).astype(np.int64)
        del grams
        block = (anchor - at) // span
        new = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(valid & np.concatenate([[True], new | ~valid[:-1]]))
        last = np.flatnonzero(valid & np.concatenate([new | ~valid[1:], [True]]))
        core = anchor[first] - block[first] * span
        keys = hashes.of(core, core - span + 1 + length)
        windows = last - first + 1
        yield keys, first + a, windows, hashes.of(first, last + length) ^ mix64(windows.astype(np.uint64))


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, size = TaskContext.get().partitionId(), 0, 0
    rows, texts, lens = [], [], []

    def close() -> pa.RecordBatch:
        nonlocal made
        all_rows = pa.concat_arrays(rows)
        cols = [
            pa.array([(part << 24) + made], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(all_rows)], pa.int32()), all_rows),
            pa.array([pack(np.array(lens, np.int64))], pa.binary()),
            pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()),
        ]
        made += 1
        for x in (rows, texts, lens):
            x.clear()
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "rows", "lens", "text"])

    for b in batches:
        for k, t in enumerate(b.column(1).to_pylist()):
            texts.append(t or b"")
            lens.append(len(t or b""))
            rows.append(b.column(0).slice(k, 1))
            size += lens[-1]
            if size >= CHUNK_BYTES:
                size = 0
                yield close()
    if lens:
        yield close()
    release()


def _bytes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk, and the lengths of its documents."""
    lens = unpack(row["lens"])
    return np.frombuffer(zstandard.decompress(row["text"]), np.uint8), lens


def _repeats(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each of the counts, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the stretches at a and at b differ, byte by byte."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 4096):
        n = sizes[i : i + 4096]
        at = _repeats(n)
        other = data[np.repeat(a[i : i + 4096], n) + at] != data[np.repeat(b[i : i + 4096], n) + at]
        out[i : i + 4096] = np.add.reduceat(other, np.cumsum(n) - n) > 0
    return out


#: rest: the starts of further segments of the chunk with the same bytes.
_REQUEST = "bucket int, key long, content long, chunk long, place long, rest binary"


def _asked(chunk: int, data: np.ndarray, lens: np.ndarray, length: int, gram: int, span: int, buckets: int, active=None) -> pa.RecordBatch | None:
    """A row for each different segment of a chunk."""
    got = list(_segments(data, lens, length, gram, span, active))
    if not got:
        return None
    keys, starts, windows, content = map(np.concatenate, zip(*got))
    del got
    o = np.lexsort((content, keys))
    keys, starts, windows, content = keys[o], starts[o], windows[o], content[o]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (content[1:] != content[:-1]) | (windows[1:] != windows[:-1])])
    lead = starts[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    same = np.flatnonzero(~new)
    new[same[_unequal(data, starts[same], lead[same], windows[same] + length - 1)]] = True  # equal hashes, other bytes
    first = np.flatnonzero(new)
    members = np.diff(np.append(first, len(new)))
    rest: list[bytes | None] = [None] * len(first)
    small = starts.astype(np.int32)
    for k in np.flatnonzero(members > 1).tolist():
        rest[k] = small[first[k] + 1 : first[k] + members[k]].tobytes()
    key = keys[first]
    cols = [
        pa.array((key % np.uint64(buckets)).astype(np.int32)),
        pa.array(key.view(np.int64)),
        pa.array(content[first].view(np.int64)),
        pa.array(np.full(len(first), chunk)),
        pa.array(starts[first] * _PLACE + windows[first]),
        pa.array(rest, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "key", "content", "chunk", "place", "rest"])


def _requests(length: int, gram: int, span: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = _asked(row["chunk"], *_bytes(row), length, gram, span, buckets)
                if out is not None:
                    for k in range(0, len(out), 20_000):
                        yield out.slice(k, 20_000)
                del out
                release()

    return run


def _requests_again(length: int, gram: int, span: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows of segments that are to be dealt by fewer offsets."""
        out = []
        for row in left.to_pylist() if len(right) else []:
            data, lens = _bytes(row)
            starts, windows, _ = _members(right)
            active = np.zeros(len(data) + 1, np.int32)
            np.add.at(active, starts, 1)
            np.add.at(active, starts + windows, -1)
            got = _asked(row["chunk"], data, lens, length, gram, span, buckets, np.cumsum(active) > 0)
            if got is not None:
                out.append(got)
            del data, active
            release()
        schema = pa.schema([("bucket", pa.int32()), *[(c, pa.int64()) for c in ("key", "content", "chunk", "place")], ("rest", pa.binary())])
        return pa.Table.from_batches(out, schema)

    return run


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, row of the table) of each segment that the rows stand for."""
    place = table["place"].to_numpy()
    more = pc.fill_null(pc.binary_length(table["rest"]), 0).to_numpy() // 4
    rest = np.frombuffer(b"".join(x for x in table["rest"].to_pylist() if x), np.int32).astype(np.int64)
    row = np.concatenate([np.arange(len(place)), np.repeat(np.arange(len(place)), more)])
    return np.concatenate([place // _PLACE, rest]), (place % _PLACE)[row], row


_ROUTE = "chunk long, place long, rest binary, shard long"
#: The shard of segments that are dealt again.
AGAIN = -1


def _route(length: int, shard_bytes: int, class_rows: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        """One bucket of keys: the shards to which segments go. Segments of a key that stands once go nowhere."""
        bucket = table["bucket"][0].as_py()
        key, content = (table[c].to_numpy() for c in ("key", "content"))
        o = np.lexsort((content, key))
        key, content = key[o], content[o]
        members = 1 + pc.fill_null(pc.binary_length(table["rest"]), 0).to_numpy()[o] // 4
        size = table["place"].to_numpy()[o] % _PLACE + length
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[True], content[1:] != content[:-1]])
        of_key, of_class = np.cumsum(new_key) - 1, np.cumsum(new) - 1
        twice = (np.bincount(of_key, members) > 1)[of_key]
        again = twice & (np.bincount(of_key, size * new) > (np.inf if last else shard_bytes))[of_key]
        sent = twice & ~again
        # one row of each content goes to the shard of the key, and so do the others if they are few
        rank = np.arange(len(o)) - np.flatnonzero(new)[of_class]
        rows = np.bincount(of_class)
        main = sent & (new | (rows <= class_rows)[of_class])
        per_key = np.bincount(of_key, size * main)
        shard = ((np.cumsum(per_key) - per_key) // shard_bytes).astype(np.int64)[of_key]
        # of contents in very many chunks, the first is compared with each group of the others in a shard of its own
        parts = np.where(rows > class_rows, -(-rows // class_rows), 0)
        base = (1 << 19) + np.cumsum(parts) - parts
        lead = np.flatnonzero(sent & new & (rows > class_rows)[of_class])
        other = np.flatnonzero(sent & ~main)
        take = np.concatenate([np.flatnonzero(main), np.repeat(lead, parts[of_class[lead]]), other, np.flatnonzero(again)])
        to = np.concatenate([
            shard[main], np.repeat(base[of_class[lead]], parts[of_class[lead]]) + _repeats(parts[of_class[lead]]),
            base[of_class[other]] + rank[other] // class_rows,
        ]) + (bucket << 20)
        to = np.concatenate([to, np.full(int(again.sum()), AGAIN)])
        return table.select(["chunk", "place", "rest"]).take(pa.array(o[take])).append_column("shard", pa.array(to, pa.int64()))

    return run


def _send(length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of the segments of a chunk that may repeat, for the shards."""
        texts: list[bytes] = []
        for row in left.to_pylist() if len(right) else []:
            data, _ = _bytes(row)
            whole, place = data.tobytes(), right["place"].to_numpy()
            texts = [whole[a : a + n] for a, n in zip((place // _PLACE).tolist(), (place % _PLACE + length - 1).tolist())]
            del data, whole
        out = (right if texts else right.slice(0, 0)).select(["shard", "chunk", "place", "rest"]).append_column("text", pa.array(texts, pa.binary()))
        release()
        return out

    return run


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; STOP beyond the end."""
    padded = np.concatenate([text, np.full(8, STOP, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_order(text: np.ndarray, eights: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` bytes at least, ties by place: prefix doubling on those still tied."""
    n = len(text)
    order = np.argsort(eights, kind="stable")
    ranked = eights[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    have = 8
    while have < depth:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            break
        sub = order[tied]
        after = np.where(sub + have < n, rank[np.minimum(sub + have, n - 1)] + 1, 0)
        key = rank[sub] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        sub, key = sub[o], key[o]
        order[tied] = sub
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        have *= 2
    return order


def _common(eights: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, `most` at most."""
    n, out = len(eights), most.copy()
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        diff = eights[np.minimum(a[live] + k, n - 1)] ^ eights[np.minimum(b[live] + k, n - 1)]
        rest, at = diff[diff != 0], live[diff != 0]
        bits = np.zeros(len(rest), np.int64)  # equal leading bytes
        for j in range(1, 8):
            bits += (rest >> np.uint64(64 - 8 * j)) == 0
        out[at] = np.minimum(k + bits, most[at])
        k += 8
        live = live[(diff == 0) & (most[live] > k)]
    return out


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of a collection of segments, with the text places at both ends of each run.

    The collection is given as its different segments, each closed by STOP, and how often each stands in it; copies lie beside
    each other in the order of suffixes, so they only make runs longer. What precedes a segment is unlike anything else: the
    first place of each copy is a run of its own. Once built, only the runs and the text are kept.
    """

    def __init__(self, text: np.ndarray, first: np.ndarray, copies: np.ndarray):
        self.text, n = text, len(text)
        sizes = np.diff(np.append(first, n))
        self.left = np.repeat(first + sizes - 1, sizes) - np.arange(n)  # bytes to the end of the segment; no match goes beyond
        self.first, self.copies = first, copies
        self.eights = _eights(text)
        order = suffix_order(text, self.eights, int(self.left.max(initial=0)) + 1)
        before = text[order - 1].astype(np.int16)
        start = (order == 0) | (before == STOP)
        border = np.flatnonzero(start[1:] | start[:-1] | (before[1:] != before[:-1])) if n else np.empty(0, np.int64)
        runs = np.concatenate([[0], border + 1]) if n else border
        self.heads = np.where(start[runs], STOP, before[runs])  # the byte of each run, STOP for the start of a segment
        weight = np.repeat(copies, sizes)[order]
        self.lengths = np.add.reduceat(weight, runs) if n else runs
        self.begins, self.ends = order[runs], order[np.append(border, n - 1)] if n else order  # sampled places
        del order, before, weight

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest match of what follows with what follows another place of the collection.

        Inside a run, the match of a suffix with its neighbour is that of the place before, less one; so matches
        are compared at the sampled run ends alone, and streamed from there over the text.
        """
        n = len(self.text)
        reach = np.zeros(n, np.int64)  # end of the longest known match from a place or one before it
        a, b = self.ends[:-1], self.begins[1:]
        common = _common(self.eights, a, b, np.minimum(self.left[a], self.left[b]))
        reach[b] = b + common
        reach[a] = np.maximum(reach[a], a + common)
        twice = self.first[self.copies > 1]  # the runs of one place that copies of a segment begin with match to its end
        reach[twice] = twice + self.left[twice]
        return np.maximum.accumulate(reach) - np.arange(n)


def _index(length: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard: indexes its segments, and gives back the runs of windows that match elsewhere in it."""
        coded = table["text"].combine_chunks().dictionary_encode()  # the different segments, told apart byte by byte
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        starts, _, row = _members(table)
        chunks = table["chunk"].to_numpy()[row]
        code = code[row]
        stop = bytes([STOP])
        text = np.frombuffer(stop.join(texts) + stop, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(sizes) - sizes
        del texts, coded, table
        hit = np.flatnonzero(RunIndex(text, first, np.bincount(code, minlength=len(first))).matching_statistics() >= length)
        new = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1])) if len(hit) else hit
        at, n = hit[new], np.diff(np.append(new, len(hit)))  # runs of windows
        of = np.searchsorted(first, at, "right") - 1
        by, per = np.searchsorted(of, code), np.bincount(of, minlength=len(first))[code]
        which = np.repeat(by, per) + _repeats(per)  # the runs of each member's segment
        who = np.repeat(np.arange(len(code)), per)
        s, c, chunk = starts[who] + at[which] - first[of[which]], n[which], chunks[who]
        o = np.lexsort((s, chunk))
        s, c, chunk = s[o].astype(np.int32), c[o].astype(np.int32), chunk[o]
        cut = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(chunk)) if len(chunk) else np.zeros(1, int)
        out = pa.table(
            {
                "chunk": pa.array(chunk[cut[:-1]], pa.int64()),
                "starts": pa.array([pack(s[i:j]) for i, j in zip(cut, cut[1:])], pa.binary()),
                "counts": pa.array([pack(c[i:j]) for i, j in zip(cut, cut[1:])], pa.binary()),
            }
        )
        del text, hit, which, who, s, c
        release()
        return out

    return run


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    length: int = 200,
    gram: int = 24,
    shard_bytes: int = SHARD_BYTES,
    class_rows: int = CLASS_ROWS,
) -> DataFrame:
    """Struct `row` (the carried columns), n_bytes, n_removed, spans, kept.

    Every byte goes that a `length`-byte string covers which also starts anywhere else, the same document
    included; strings are judged on the input. spans: maximal removed stretches of a document in bytes, end
    exclusive; kept: the remaining bytes, which may cut a character. A null text counts as empty;
    repeated rows are copies of each other. An empty table gives an empty result.

    gram (at most length): bytes of the strings whose hashes anchor windows. Hashes deal segments to shards and leave out those
    whose key stands once; whatever is removed has been compared byte by byte in the index of a shard. shard_bytes: bytes of
    different segments of one key beyond which its windows are dealt by fewer offsets, up to three times.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept_cols = docs.columns if carry is None else list(carry)
    src = docs.select(F.struct(*[docs[c] for c in kept_cols]).alias("row"), docs[text].cast("binary").alias("text"))
    size = int(docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0)
    buckets, parts = n_buckets(size, BUCKET_BYTES), n_buckets(size, CHUNK_BYTES)
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("rows", T.ArrayType(src.schema["row"].dataType)),
            T.StructField("lens", T.BinaryType()),
            T.StructField("text", T.BinaryType()),
        ]
    )
    chunks = bucketed(src.mapInArrow(_pack_chunks, schema), "chunk", parts, "substring_chunks")
    slim = chunks.select("chunk", "lens", "text")
    routes, again = None, None
    for span in spans(length):
        if again is None:
            asked = slim.mapInArrow(_requests(length, gram, span, buckets), _REQUEST)
        else:
            asked = slim.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(_requests_again(length, gram, span, buckets), _REQUEST)
        routed = written(asked.groupBy("bucket").applyInArrow(_route(length, shard_bytes, class_rows, span == 1), _ROUTE), "substring-routes")
        routes = routed if routes is None else routes.unionByName(routed)
        again = routed.where(f"shard = {AGAIN}")
        if not again.limit(1).count():
            break
    sent = routes.where(f"shard <> {AGAIN}")
    segments = slim.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(
        _send(length), "shard long, chunk long, place long, rest binary, text binary"
    )
    marks = segments.groupBy("shard").applyInArrow(_index(length), "chunk long, starts binary, counts binary")

    result = T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    result = T.StructType([T.StructField("row", chunks.schema["rows"].dataType.elementType), *result.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(result)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for k, row in enumerate(left.select(["lens", "text"]).to_pylist()):
            data, lens = _bytes(row)
            change = np.zeros(len(data) + 1, np.int32)
            for r in right.select(["starts", "counts"]).to_pylist():
                s, n = unpack(r["starts"]), unpack(r["counts"])
                np.add.at(change, s, 1)
                np.add.at(change, s + n + length - 1, -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            del change
            found, kept = [], []
            removed = []
            end = 0
            for m in lens.tolist():
                mine = gone[end : end + m]
                step = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist()
                found.append([{"start": x, "end": y} for x, y in zip(step[::2], step[1::2])])
                kept.append(data[end : end + m][~mine].tobytes() if step else data[end : end + m].tobytes())
                removed.append(int(mine.sum()))
                end += m
            rows = left["rows"]
            rows = (rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows).slice(k, 1).flatten()
            cols = [rows, pa.array(lens, pa.int64()), pa.array(removed, pa.int64()), pa.array(found, arrow.field("spans").type), pa.array(kept, pa.binary())]
            out.append(pa.table(cols, names=arrow.names))
            release()
        return pa.concat_tables(out) if out else arrow.empty_table()

    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(finish, result)
