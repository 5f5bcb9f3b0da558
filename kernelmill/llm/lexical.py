"""Ranked lexical search: documents become bags of the items' terms, equal bags are scored once, lists of the best are merged."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import at_most, shared_dir
from .toplists import NO_ID, SCHEMA, TopLists, filled, merged
from .util import WORD_TABLE, per_text, release, small_batches, word_pieces, written

#: Different terms that the items of one pass over the documents have in all, items that share a pass, and cells of a table of scores.
MOST_TERMS, MOST_ITEMS, CELLS = 1_000_000, 100_000, 4_000_000
#: Words whose terms are counted at once, and bytes of different bags that a task gathers before it gives them on.
PIECE_WORDS, CLASS_BYTES = 200_000, 16 << 20
#: Sums of doubles are exact below this many.
EXACT = 2**53


def _items(texts: list) -> dict:
    return {"terms": [sorted({w for ws in word_pieces((t or b"").translate(WORD_TABLE)) for w in ws}) for t in texts]}


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """(item id, its terms) of items with at most MOST_TERMS terms, or of one item, streamed to the driver one block after another."""
    found = per_text(items, text, [item], "terms array<binary>", lambda: _items)
    found = found.select(F.col("row").getField(item).alias("item"), F.explode("terms").alias("term")).distinct()
    rows = written(found, "lexical-items")
    block, own, n = [], None, 0
    for r in rows.repartitionByRange("item").sortWithinPartitions("item", "term").toLocalIterator():
        if own is None or own[0] != r["item"]:
            if n >= MOST_TERMS or len(block) >= MOST_ITEMS:
                yield block
                block, n = [], 0
            own = (r["item"], [])
            block.append(own)
        own[1].append(bytes(r["term"]))
        n += 1
    if block:
        yield block


def _bags(shared):
    """A pass that counts a block's terms in each text: n (terms with repeats, in the block or not) and bag."""

    def start():
        vocab = shared.value
        get, size = vocab.get, max(1, len(vocab))
        kind = "<u2" if size <= 1 << 16 else "<u4"

        def run(texts: list) -> dict:
            n_words, bags, parts, keys, held = [], [], [], [], 0
            for row, t in enumerate(texts):
                n = 0
                for ws in word_pieces((t or b"").translate(WORD_TABLE)):
                    ids = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
                    parts.append(ids[ids >= 0] + row * size)
                    n += len(ws)
                    held += len(ws)
                    if held > PIECE_WORDS:
                        keys.append(np.unique(np.concatenate(parts), return_counts=True))
                        parts, held = [], 0
                n_words.append(n)
            if parts:
                keys.append(np.unique(np.concatenate(parts), return_counts=True))
            key, tf = _summed(keys)
            cut = np.searchsorted(key, np.arange(len(texts) + 1) * size)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                most = int(tf[a:b].max(initial=0))
                width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 8
                bags.append(bytes([width]) + (key[a:b] % size).astype(kind).tobytes() + tf[a:b].astype(f"<u{width}").tobytes())
            return {"n": n_words, "bag": bags}

        return run

    return start


def _summed(keys: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the sum of the counts of each."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0]
    key, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
    return key, np.bincount(where, np.concatenate([c for _, c in keys])).astype(np.int64)


def _unbagged(bags: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the entries of all bags."""
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    lens = np.array([(len(b) - 1) // (kind.itemsize + b[0]) for b in bags], np.int64)
    none = np.empty(0, np.int64)
    terms = [none] + [np.frombuffer(b, kind, n, 1) for b, n in zip(bags, lens.tolist())]
    tfs = [none] + [np.frombuffer(b, f"<u{b[0]}", n, 1 + n * kind.itemsize) for b, n in zip(bags, lens.tolist())]
    return np.repeat(np.arange(len(bags)), lens), np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.int64)


def _frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(_unbagged(b.column(0).to_pylist(), size)[1], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in at_most(bags.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), size, "terms"):
        out[r["term"]] = r["df"]
    return out


def _lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m = 100 - 90 + (90 n N) div L."""
    if len(n) and 90 * int(n.max()) * docs >= 2**63:
        return np.array([10 + 90 * int(v) * docs // terms for v in n], np.int64)
    return 10 + 90 * n * docs // max(terms, 1)


def _classes(bags: DataFrame, docs: int, terms: int, k: int) -> DataFrame:
    """(m, bag, ids): documents of one bag and m are one class, with the k smallest of their ids, null ids last.

    Tasks gather the classes among their own documents first, so that a class of very many copies gives a few rows a task; those rows meet by
    a hash of m and bag, and only those with equal bytes are one class. A score needs no more members than a list can take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0

        def give() -> pa.RecordBatch:
            hashes = [xxhash.xxh64_intdigest(bag, seed=m) - (1 << 63) for m, bag in held]
            ids = [[None if i == NO_ID else i for i in sorted(own)[:k]] for own in held.values()]
            cols = [pa.array(hashes, pa.int64()), pa.array([m for m, _ in held], pa.int64()), pa.array([b for _, b in held], pa.binary()), pa.array(ids, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["h", "m", "bag", "ids"])

        for b in batches:
            ids, n = filled(b.column(0)).tolist(), b.column(1).to_numpy()
            for i, m, bag in zip(ids, _lengths(n, docs, terms).tolist(), b.column(2).to_pylist()):
                if len(bag) == 1:  # no term of any item: no score
                    continue
                own = held.get((m, bag))
                if own is None:
                    held[m, bag] = own = []
                    size += len(bag) + 200
                own.append(i)
                if len(own) >= 8 * k + 64:
                    own.sort()
                    del own[k:]
            if size > CLASS_BYTES:
                yield give()
                held.clear()
                size = 0
        yield give()
        release()

    found = bags.select("id", "n", "bag").mapInArrow(run, "h long, m long, bag binary, ids array<long>")
    members = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k)
    return found.groupBy("h", "m", "bag").agg(members.alias("ids")).select("m", "bag", "ids")


def _scorer(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offsets, postings, n_items, exact = shared.value
        lists = TopLists(n_items, k, 1)
        size, step = len(weights), max(1, CELLS // max(1, n_items))
        for b in batches:
            ids = b.column(2)
            first = filled(pc.list_element(ids, 0))
            order = np.argsort(first, kind="stable")
            m, bags, members = b.column(0).to_numpy(), b.column(1).to_pylist(), ids.to_pylist()
            for a in range(0, len(order), step):
                own = order[a : a + step]
                s = _scores(m[own], [bags[x] for x in own.tolist()], weights, offsets, postings, n_items, exact, size)
                item, c = lists.offer_tile(s)
                of = [members[x] for x in own[c].tolist()]
                n = np.fromiter(map(len, of), np.int64, len(of))
                flat = np.fromiter((NO_ID if i is None else i for x in of for i in x), np.int64, int(n.sum()))
                lists.add(np.repeat(item, n), np.repeat(s[item, c].astype(np.int64), n), flat)
        yield lists.table(np.arange(n_items), TaskContext.get().partitionId(), np.arange(n_items))
        release()

    return run


def _scores(m: np.ndarray, bags: list[bytes], weights, offsets, postings, n_items: int, exact: bool, size: int) -> np.ndarray:
    """[items, classes] scores. Sums of doubles below EXACT are exact; else (exact false) they are of 64-bit integers."""
    row, term, tf = _unbagged(bags, size)
    impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    n = offsets[term + 1] - offsets[term]
    out = np.zeros(n_items * len(bags), np.float64 if exact else np.int64)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):  # postings of about CELLS at once
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS)))
        part = n[a:z]
        at = np.repeat(offsets[term[a:z]] - (np.cumsum(part) - part), part) + np.arange(part.sum())
        cell = postings[at] * len(bags) + np.repeat(row[a:z], part)
        if exact:
            out += np.bincount(cell, np.repeat(impact[a:z], part), len(out))
        else:
            np.add.at(out, cell, np.repeat(impact[a:z], part))
        a = z
    return out.reshape(n_items, len(bags))


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for each item, of those above 0; equal scores by smaller id, null ids last.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. With N documents that have a term, L their terms with
    repeats, n those of a document, df the documents that hold a term and tf its occurrences in one: w = floor(1000 ln((2N + 2) / (2 df + 1))),
    m = 10 + (90 n N) div L, and a score is the sum over the item's different terms of w ((10^9 tf) div (1000 tf + 8 m)).

    Documents are cut down to the vocabulary of the items: a bag of (term, tf). Those of equal bag and m are one class, scored once for all
    items; its members stand in a list by ascending id. A benchmark is a stated query set: items go out in blocks of MOST_TERMS terms, or one
    item, and each block is a pass over the documents. Texts are never shuffled, only different bags and short lists.

    A null or empty text has no term: such a document is not counted, such an item has no row. Rows of one item id (null is one) are one item
    with the terms of all; each row of docs is a document, so repeated rows may stand in a list one after another. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lexical-lists-{uuid.uuid4().hex}"
    kind = items.schema[item_id].dataType
    out, sums = None, None
    for number, block in enumerate(_blocks(items, item_id, item_text)):
        vocab: dict[bytes, int] = {}
        coded = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in ws), np.int64, len(ws)) for _, ws in block]
        shared = spark.sparkContext.broadcast(vocab)
        bags = per_text(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")), "text", ["id"], "n long, bag binary", _bags(shared))
        bags = written(bags.select(F.col("row.id").cast("long").alias("id"), "n", "bag").where("n > 0"), "lexical-bags")
        shared.destroy()
        if sums is None:
            sums = bags.agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = int(sums[0]), int(sums[1] or 0)
        df = _frequencies(bags, len(vocab)).tolist()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
        # the items of each term
        term, item = np.concatenate(coded), np.repeat(np.arange(len(block)), [len(x) for x in coded])
        postings = item[np.argsort(term, kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocab)))])
        exact = int(weights.max(initial=0)) * 1_000_000 * max(map(len, coded)) < EXACT
        shared = spark.sparkContext.broadcast((weights, offsets, postings, len(block), exact))
        small_batches(spark)
        lists = _classes(bags, n_docs, n_terms, k).mapInArrow(_scorer(shared, k), SCHEMA)
        lists.write.parquet(f"{path}/{number}")
        shared.destroy()
        best = merged(spark.read.schema(SCHEMA).parquet(f"{path}/{number}"), k)
        names = spark.createDataFrame([(x, i) for i, (x, _) in enumerate(block)], _row(("item_id", kind), ("q", T.LongType())))
        got = best.join(F.broadcast(names), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], _row(("item_id", kind), ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))) if out is None else out


def _row(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*x) for x in fields])
