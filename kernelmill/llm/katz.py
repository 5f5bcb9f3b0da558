"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, packed partitioned tables.

Documents are packed into chunks. A chunk asks the tables for each of its different n-grams once, so what
is shuffled is pre-aggregated and no frequent word makes a hot key: n-grams are dealt by their hash.

1. `chunks`: the token sequence of some MB of text in one row, in a table bucketed by chunk;
2. `counts`: tables of training counts by order and hash, and each chunk's answers from them;
3. `backoff`: for each order from 2 up, tables of context totals and backoff weights by hash, and each chunk's answers;
4. each chunk scores its tokens, recursively from the highest order down.

A chunk deals its keys to a fixed number of ranges of hashes. Where a range is too large for one task, the rows of many chunks are
dealt again to its parts together, and answers come back the same way: rows stay in proportion to the input (`exchanged`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import bucketed, mix64, n_buckets, pack, pack_sorted, release, small_batches, unpack, unpack_sorted, word_pieces, written

#: Text bytes of a chunk (a longer text is a chunk of its own), and text bytes for each bucket of the tables.
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: Ranges to which a chunk deals its keys, and chunks whose rows are dealt again together.
RANGES, GROUP_CHUNKS = 256, 256
PIECE = 200_000
#: Counts up to this are discounted.
GT_MAX = 5
END = b" "


def _hashes(texts: list) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of the tokens of each text, its end included, and the number of tokens."""
    out, lens, flat = [], [], []

    def close() -> None:
        d = pa.array(flat, pa.binary()).dictionary_encode()
        h = np.fromiter((xxhash.xxh64_intdigest(x) for x in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
        out.append(h[d.indices.to_numpy()])
        flat.clear()

    for t in texts:
        n = 1
        for w in word_pieces(t.lower() if t else b""):
            n += len(w)
            flat.extend(w)
            if len(flat) >= PIECE:
                close()
        lens.append(n)
        flat.append(END)
    if flat:
        close()
    return out, lens


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: rows, and the packed tokens as places in a sorted vocabulary of hashes."""
    part, made = TaskContext.get().partitionId(), 0
    rows, train, tokens, lens, size = [], [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal made, size
        vocab, ids = np.unique(np.concatenate(tokens), return_inverse=True)
        all_rows = pa.concat_arrays(rows)
        cols = [
            pa.array([(part << 24) + made], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(all_rows)], pa.int32()), all_rows),
            *(pa.array([pack(x)], pa.binary()) for x in (np.array(train, np.uint8), np.array(lens, np.int32), ids.astype(np.int32))),
            pa.array([pack_sorted(vocab)], pa.binary()),
        ]
        made += 1
        for x in (rows, train, tokens, lens):
            x.clear()
        size = 0
        release()
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "rows", "train", "lens", "ids", "vocab"])

    for b in batches:
        texts, learn = b.column(1).to_pylist(), b.column(2).to_pylist()
        first = 0
        while first < len(texts):
            last = first
            while last < len(texts) and (last == first or size < CHUNK_BYTES):
                size += len(texts[last] or b"")
                last += 1
            got, n = _hashes(texts[first:last])
            tokens += got
            lens += n
            rows.append(b.column(0).slice(first, last - first))
            train += [bool(x) for x in learn[first:last]]
            first = last
            if size >= CHUNK_BYTES:
                yield close()
    if lens:
        yield close()


class _Chunk:
    """The n-grams of a chunk, order by order. Order k: `at` (n-gram of each token), and for each different
    n-gram its key, the (k-1)-gram before its last word (`hist`; the last place: start of text) and the (k-1)-gram
    without its first word (`suffix`)."""

    def __init__(self, row: dict, order: int):
        vocab = unpack_sorted(row["vocab"])
        ids = unpack(row["ids"]).astype(np.int64)
        self.lens, self.train = unpack(row["lens"]).astype(np.int64), unpack(row["train"]).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.learn = np.repeat(self.train, self.lens)
        self.keys, self.at, self.hist, self.suffix = [vocab], [ids], [None], [None]
        with np.errstate(over="ignore"):
            for k in range(2, order + 1):
                below, start = self.at[-1], len(self.keys[-1])
                hist = np.empty(len(ids), np.int64)
                hist[1:] = below[:-1]
                hist[self.starts] = start
                _, one, at = np.unique(hist * len(vocab) + ids, return_index=True, return_inverse=True)
                self.at.append(at)
                self.hist.append(hist[one])
                self.suffix.append(below[one])
                context = self.contexts(k)
                self.keys.append(mix64(context[hist[one]] * np.uint64(0x9E3779B97F4A7C15) + vocab[ids[one]]))

    def contexts(self, k: int) -> np.ndarray:
        """Keys of the contexts of order k; the last is the start of a text."""
        return np.append(self.keys[k - 2], mix64(np.uint64([k]))[0])

    def train_counts(self, k: int) -> np.ndarray:
        return np.bincount(self.at[k - 1][self.learn], minlength=len(self.keys[k - 1]))


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


_ASKED = "chunk long, ord int, range int, keys binary, v array<binary>"
_ANSWER = "chunk long, ord int, range int, v array<binary>, stats array<long>"


def _range(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each ascending 64-bit key, of so many equal ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, last) of runs of equal numbers."""
    at = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else np.zeros(1, int)
    return [(int(part[i]), int(i), int(j)) for i, j in zip(at, at[1:])]


def _asking(chunk: int, k: int, keys: np.ndarray, values: list[np.ndarray], ranges: int) -> dict:
    """The rows by which a chunk asks for ascending keys of order k."""
    cut = _cuts(_range(keys, ranges))
    return {
        "chunk": [chunk] * len(cut),
        "ord": [k] * len(cut),
        "range": [r for r, *_ in cut],
        "keys": [pack_sorted(keys[i:j]) for _, i, j in cut],
        "v": [[pack(x[i:j]) for x in values] for _, i, j in cut],
    }


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _table(rows: dict, ddl: str) -> pa.Table:
    """Columns as an Arrow table of the types and the order of ddl."""
    return pa.table({c: pa.array(rows[c], _ARROW[kind]) for c, kind in map(str.split, ddl.split(", "))})


def exchanged(asked: DataFrame, answer, ranges: int, parts: int, chunks: int, name: str) -> DataFrame:
    """The answers (_ANSWER) to all rows asked (_ASKED), and rows of chunk -1 with a table's own sums.

    answer(keys of each row, values of each row) gives the values for each row's keys, and sums; it sees all rows of a part of a range.
    parts: of each range; with more than one, GROUP_CHUNKS of the chunks (so many there are) or so are dealt to the parts together.
    """
    if parts == 1:
        one = lambda t: _answered(t, answer, "chunk")
        return written(asked.groupBy("ord", "range").applyInArrow(one, _ANSWER), name)
    grouped = asked.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-chunks // GROUP_CHUNKS)))))
    together = "grp long, ord int, range int, part int, keys binary, who binary, v array<binary>"

    def deal(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        who = np.repeat(table["chunk"].to_numpy(), [len(x) for x in keys])
        values = [np.concatenate(x) for x in zip(*[[unpack(a) for a in v] for v in table["v"].to_pylist()])]
        keys = np.concatenate(keys)
        o = np.lexsort((who, keys))
        cut = _cuts(_range(keys[o], ranges * parts) % parts)
        rows = {
            **{c: [table[c][0].as_py()] * len(cut) for c in ("grp", "ord", "range")},
            "part": [x for x, *_ in cut],
            "keys": [pack_sorted(keys[o[i:j]]) for _, i, j in cut],
            "who": [pack(who[o[i:j]]) for _, i, j in cut],
            "v": [[pack(x[o[i:j]]) for x in values] for _, i, j in cut],
        }
        return _table(rows, together)

    back = "grp long, ord int, range int, part int, who binary, v array<binary>, stats array<long>"
    solved = written(grouped.groupBy("ord", "range", "grp").applyInArrow(deal, together).groupBy("ord", "range", "part").applyInArrow(lambda t: _answered(t, answer, "grp", back), back), f"{name}-parts")

    def undeal(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        who = np.concatenate([unpack(r["who"]) for r in rows])
        values = [np.concatenate(x) for x in zip(*[[unpack(a) for a in r["v"]] for r in rows])]
        o = np.argsort(who, kind="stable")
        cut = _cuts(who[o])
        out = {"chunk": [c for c, *_ in cut], "ord": [rows[0]["ord"]] * len(cut), "range": [rows[0]["range"]] * len(cut)}
        return _table({**out, "v": [[pack(x[o[i:j]]) for x in values] for _, i, j in cut], "stats": [None] * len(cut)}, _ANSWER)

    sums = solved.where("grp < 0").select(F.col("grp").alias("chunk"), "ord", "range", "v", "stats")
    return written(solved.where("grp >= 0").groupBy("ord", "range", "grp").applyInArrow(undeal, _ANSWER).unionByName(sums), name)


def _answered(table: pa.Table, answer, src: str, ddl: str = _ANSWER) -> pa.Table:
    """The rows of a part of a range with their answers, and one (of source -1) with its sums."""
    table = table.sort_by(src)
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    values = [np.concatenate(x) for x in zip(*[[unpack(a) for a in v] for v in table["v"].to_pylist()])]
    found, stats = answer(keys, values)
    ends = np.cumsum([len(x) for x in keys])
    cut = list(zip([0, *ends[:-1]], ends))
    rows = {c: [*table[c].to_pylist(), table[c][0].as_py()] for c in table.column_names if c not in ("keys", "v", src)}
    rows |= {src: [*table[src].to_pylist(), -1], "v": [*([pack(x[i:j]) for x in found] for i, j in cut), None], "stats": [None] * len(cut) + [stats]}
    out = _table(rows, ddl)
    del keys, values, found, rows
    release()
    return out


def _count_requests(order: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(["chunk", "train", "lens", "ids", "vocab"]).to_pylist():
                chunk = _Chunk(row, order)
                for k in range(1, order + 1):
                    o = np.argsort(chunk.keys[k - 1])
                    rows = _asking(row["chunk"], k, chunk.keys[k - 1][o], [_small(chunk.train_counts(k)[o])], ranges)
                    yield from _table(rows, _ASKED).combine_chunks().to_batches()
                del chunk
                release()

    return run


def _count(asked: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """Adds up counts; of the rows that have an n-gram, the first answers for it when contexts are summed up."""
    keys, one, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    total = np.bincount(at, values[0], len(keys)).astype(np.int64)
    own = np.zeros(len(at), np.uint8)
    own[one] = 1
    kinds = np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)[1 : GT_MAX + 2]
    return [_small(total[at]), own], [int(total.sum()), int((total > 0).sum()), *kinds.tolist()]


def good_turing(n: list[int]) -> np.ndarray:
    """Discount factors of the counts 0 to GT_MAX + 1 (that and more: 1) from the numbers of n-grams that occur once, twice, ...

    Where the estimate is no factor between 0 and 1 (small or odd tables), half a count is taken off instead.
    """
    d = np.ones(GT_MAX + 2)
    r = np.arange(1, GT_MAX + 1)
    n = np.array(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = (GT_MAX + 1) * n[GT_MAX] / n[0]
        factor = ((r + 1) * n[1 : GT_MAX + 1] / (r * n[:GT_MAX]) - tail) / (1 - tail)
    d[1 : GT_MAX + 1] = factor if np.all(np.isfinite(factor) & (factor > 0) & (factor < 1)) else (r - 0.5) / r
    return d


class _Scorer:
    """A chunk with its answers: probabilities of its different n-grams, from order 1 up."""

    def __init__(self, row: dict, answers: list[dict], model: dict, order: int):
        self.chunk, self.model = _Chunk(row, order), model
        by: dict[int, list[dict]] = {}
        for a in sorted(answers, key=lambda a: a["range"]):
            by.setdefault(a["ord"], []).append(a)
        values = lambda k, j: np.concatenate([unpack(a["v"][j]) for a in by[k]])
        self.counts, self.own, self.context = [], [], [None]
        for k in range(1, order + 1):
            o = np.argsort(self.chunk.keys[k - 1])
            self.counts.append(self._placed(o, values(k, 0).astype(np.int64)))
            self.own.append(self._placed(o, values(k, 1)).astype(bool))
        for k in range(2, order + 1):
            if CONTEXT + k in by:
                o = np.argsort(self.chunk.contexts(k))
                self.context.append([self._placed(o, values(CONTEXT + k, j)) for j in (0, 1)])
        self.prob = [self._unigrams()]
        for k in range(2, len(self.context) + 1):
            total, alpha = self.context[k - 1]
            c, hist = self.counts[k - 1], self.chunk.hist[k - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = self.discounted(k) / total[hist]
            self.prob.append(np.where(c > 0, seen, alpha[hist] * self.prob[-1][self.chunk.suffix[k - 1]]))

    @staticmethod
    def _placed(order: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[order] = values
        return out

    def discounted(self, k: int) -> np.ndarray:
        c = self.counts[k - 1]
        return c * self.model["discount"][k - 1][np.minimum(c, GT_MAX + 1)]

    def _unigrams(self) -> np.ndarray:
        """Discounted shares; the rest is the probability of a word that training has not seen."""
        return np.where(self.counts[0] > 0, self.discounted(1) / self.model["total"], self.model["unknown"])

    def context_sums(self, k: int) -> tuple[np.ndarray, ...]:
        """Over the n-grams of order k that this chunk answers for: count, discounted count and lower-order probability of each context."""
        take = self.own[k - 1] & (self.counts[k - 1] > 0)
        hist, n = self.chunk.hist[k - 1][take], len(self.chunk.keys[k - 2]) + 1
        low = self.prob[k - 2][self.chunk.suffix[k - 1]][take]
        return tuple(np.bincount(hist, x[take] if len(x) != len(hist) else x, n) for x in (self.counts[k - 1], self.discounted(k), low))


#: Answers about the contexts of order k have the order CONTEXT + k.
CONTEXT = 1000


def _backoff(asked: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """Totals of contexts, and the weights that make each context's probabilities sum to 1."""
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total, kept, low = (np.bincount(at, x, len(keys)) for x in values)
    # A context of which no count was discounted keeps back one count, so that unseen words stay possible.
    spare = (total > 0) & (total - kept < 1e-9)
    total, kept = np.where(spare, total + 1, total), np.where(spare, total, kept)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(total > 0, (1 - kept / total) / np.maximum(1 - low, 1e-12), 1.0)
    return [total[at], alpha[at]], []


def score_documents(
    docs: DataFrame, learn: str, text: str = "text", carry: list[str] | None = None, order: int = 2
) -> DataFrame:
    """Struct `row` (the carried columns), n_tokens, n_known, train_tokens, base_score, score.

    Learns a Katz model of `order` words from the rows where the column `learn` is true, and scores all
    rows. A-Z are lower-cased; tokens are runs without ASCII white space and one end a text. base_score:
    log10 of add-one unigram shares; score: log10 of the Katz model. Words are known by 64-bit XXH64.
    Counts up to 5 are discounted by Good-Turing factors; a word that training has not seen takes the unigrams'
    left-over. Null and empty texts are the end token alone; repeated rows count and score as often as
    they stand; with nothing to learn from, every token has probability 1 in the model.

    Counting, discounts and weights cover all training rows; all tables grow with the corpus and are dealt
    by hash, so a frequent word or context is one key. The chunk table is bucketed, so that the passes over it don't shuffle it. Every sum is made in
    a fixed order: reruns agree.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.columns if carry is None else list(carry)
    src = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("row"), docs[text].cast("binary").alias("text"), F.coalesce(docs[learn], F.lit(False)).alias("learn")
    )
    size = int(docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0)
    chunk_parts = n_buckets(size, CHUNK_BYTES // 2)
    ranges = min(RANGES, n_buckets(size, BUCKET_BYTES))
    parts = n_buckets(size, BUCKET_BYTES * ranges, 1)
    row_type = src.schema["row"].dataType
    schema = T.StructType.fromDDL("chunk long, train binary, lens binary, ids binary, vocab binary")
    schema = T.StructType([schema["chunk"], T.StructField("rows", T.ArrayType(row_type)), *schema.fields[1:]])
    chunks = bucketed(src.mapInArrow(_pack_chunks, schema), "chunk", chunk_parts, "katz_chunks")
    n_chunks = chunks.count() if parts > 1 else 0

    asked = chunks.select("chunk", "train", "lens", "ids", "vocab").mapInArrow(_count_requests(order, ranges), _ASKED)
    counts = exchanged(asked, _count, ranges, parts, n_chunks, "katz-counts")
    stats = counts.where("chunk = -1").select("ord", F.posexplode("stats").alias("i", "x")).groupBy("ord", "i").agg(F.sum("x").alias("x"))
    found = np.zeros((order + 1, GT_MAX + 3), np.int64)
    for r in stats.collect():
        found[r["ord"], r["i"]] = r["x"]
    total, kinds = int(found[1, 0]), int(found[1, 1])
    model = {"discount": [good_turing(found[k, 2:].tolist()) for k in range(1, order + 1)], "total": float(max(total, 1)), "unknown": 1.0}
    if total:
        r = np.arange(1, GT_MAX + 1)
        model["unknown"] = float((found[1, 2 : 2 + GT_MAX] * r * (1 - model["discount"][0][r])).sum() / total)
        if model["unknown"] <= 0:
            model |= {"total": total + 1.0, "unknown": 1 / (total + 1.0)}

    answers = counts.where("chunk >= 0").drop("stats")
    slim = chunks.select("chunk", "train", "lens", "ids", "vocab")

    def summing(k: int):
        def sums(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for row in left.to_pylist():
                s = _Scorer(row, right.to_pylist(), model, k)
                keys = s.chunk.contexts(k)
                o = np.argsort(keys)
                out.append(_table(_asking(row["chunk"], CONTEXT + k, keys[o], [x[o] for x in s.context_sums(k)], ranges), _ASKED))
                del s
                release()
            return pa.concat_tables(out) if out else _table({c: [] for c in ("chunk", "ord", "range", "keys", "v")}, _ASKED)

        return sums

    for k in range(2, order + 1):
        known = answers.where(f"ord <= {k} or ord > {CONTEXT}")
        partial = slim.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(summing(k), _ASKED)
        weights = exchanged(partial, _backoff, ranges, parts, n_chunks, "katz-backoff")
        answers = answers.unionByName(weights.where("chunk >= 0").drop("stats"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for k, row in enumerate(left.drop_columns(["rows"]).to_pylist()):
            s = _Scorer(row, right.to_pylist(), model, order)
            add = lambda x: np.add.reduceat(x, s.chunk.starts)
            c = s.counts[0][s.chunk.at[0]]
            rows = left["rows"].combine_chunks() if isinstance(left["rows"], pa.ChunkedArray) else left["rows"]
            rows = rows.slice(k, 1).flatten()
            out.append(
                pa.table(
                    {
                        "row": rows,
                        "n_tokens": s.chunk.lens,
                        "n_known": add((c > 0).astype(np.int64)),
                        "train_tokens": np.full(len(rows), total),
                        "base_score": add(np.log10((c + 1) / (total + kinds + 1))),
                        "score": add(np.log10(s.prob[-1])[s.chunk.at[-1]]),
                    }
                )
            )
            del s
            release()
        return pa.concat_tables(out) if out else fields_type.empty_table()

    result = T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    result = T.StructType([T.StructField("row", chunks.schema["rows"].dataType.elementType), *result.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    fields_type = to_arrow_schema(result)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, result)
