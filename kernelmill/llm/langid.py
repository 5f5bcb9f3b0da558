"""Language identification with one interpolated Kneser-Ney character model per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import per_text, small_batches, written

ORDER = 4
#: Different letters that a model tells apart: four of them fill a 64-bit number. The rarer ones of a larger alphabet are one symbol.
MOST_LETTERS = (1 << 15) - 2
#: Bytes of texts coded at once, and groups that the n-grams of a language reach the driver in.
PIECE, GROUPS = 1 << 18, 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with each run of other characters as one 0, and the offset of each text. What is no UTF-8 becomes U+FFFD."""
    low = [t.decode(errors="replace").lower() for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp] == 1, cp, 0)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    keep[bounds[:-1][bounds[:-1] < len(cp)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return cp[keep], total[bounds]


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE bytes, cut before white space; where there is none, at the beginning of a character."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        if found := _BLANK.search(text, end, end + PIECE):
            end = found.start()
        else:
            while end < len(text) and end < at + PIECE + 3 and text[end] & 0xC0 == 0x80:
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _coded(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, code points, offsets, code points just before) of runs of texts of about PIECE bytes. A longer text comes in parts, so
    memory doesn't grow with it; each part is told the last ORDER - 1 code points before it, which for whole texts are none."""
    none = np.empty(0, np.int64)
    first = size = 0

    def run(a: int, z: int):
        return (a, z, *_codes([t or b"" for t in texts[a:z]]), none)

    for k, t in enumerate(texts):
        n = len(t or b"")
        if n > PIECE:
            if first < k:
                yield run(first, k)
            before = none
            for part in _cut(t):
                cp, _ = _codes([part])
                if len(before) and before[-1] == 0 and len(cp) and cp[0] == 0:  # the run goes on
                    cp = cp[1:]
                yield k, k + 1, cp, np.array([0, len(cp)]), before
                before = np.concatenate([before, cp])[1 - ORDER :]
            first, size = k + 1, 0
        elif size + n > PIECE:
            yield run(first, k)
            first, size = k, n
        else:
            size += n
    if first < len(texts):
        yield run(first, len(texts))


def _grams(ids: np.ndarray, offsets: np.ndarray, size: int, before: np.ndarray) -> np.ndarray:
    """The packed ORDER-gram that ends at each place; before a text stand zeros. before: the numbers just before the first place."""
    skip = len(before)
    if skip:
        ids, offsets = np.concatenate([before, ids]), np.array([0, skip + len(ids)])
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = ids.astype(np.uint64)
    for k in range(1, ORDER):
        earlier = np.zeros(len(ids), np.uint64)
        earlier[k:] = ids[:-k]
        key += np.where(place >= k, earlier, 0) * np.uint64(size**k)
    return key[skip:]


class Model:
    """Sorted arrays of packed n-grams for each language and order, with discounted probabilities and backoff weights."""

    def __init__(self, alphabet: np.ndarray, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """alphabet: the code points that have a number of their own; counts: ORDER-grams of each language."""
        self.alphabet = np.sort(alphabet)
        self.size = len(alphabet) + 2  # 0: no letter, 1: a letter that training has not seen
        self.langs = sorted(counts)
        self.tables = [self._fit(*counts[x]) for x in self.langs]
        self.limits: dict[str, tuple[float, float, float]] = {}

    def number(self, cp: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, cp)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == cp if len(self.alphabet) else np.zeros(len(cp), bool)
        return np.where(cp == 0, 0, np.where(known, at + 2, 1))

    def _fit(self, keys: np.ndarray, n: np.ndarray) -> list[tuple]:
        """From order 1 up: (n-grams, discounted probability, contexts, backoff weight)."""
        out = []
        size = np.uint64(self.size)
        for order in range(ORDER, 0, -1):
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = keys // size
            ctx, where = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(where, n), np.bincount(where)
            out.append((keys, (n - d) / total[where], ctx, d * kinds / total))
            # continuation counts: how many different letters stand before each shorter n-gram
            keys, n = np.unique(keys % np.uint64(self.size ** (order - 1)), return_counts=True)
        return out[::-1]

    def kinds(self) -> np.ndarray:
        """How many different letters each language has in training, the break between words among them, and one for all others."""
        return np.array([len(tables[0][0]) + 1 for tables in self.tables])

    def logprob(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of the last character of each ORDER-gram, a column per language."""
        out = np.empty((len(keys), len(self.langs)))
        for j, tables in enumerate(self.tables):
            p = np.full(len(keys), 1.0 / self.size)
            for order, (grams, prob, ctx, back) in enumerate(tables, 1):
                g = keys % np.uint64(self.size**order)
                c = g // np.uint64(self.size)
                at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                seen = ctx[at] == c
                p = np.where(seen, back[at], 1.0) * p
                at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                p += np.where(grams[at] == g, prob[at], 0.0)
            out[:, j] = np.log2(p)
        return out

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits a character for each text and language, characters, letters) of whole texts in UTF-8; long ones add up over their parts."""
        sums, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for first, last, cp, offsets, before in _coded(texts):
            keys = _grams(self.number(cp), offsets, self.size, self.number(before))
            kinds, where = np.unique(keys, return_inverse=True)
            lp = self.logprob(kinds)
            own = np.diff(offsets)
            n[first:last] += own
            letters[first:last] += np.diff(np.concatenate([[0], np.cumsum(cp != 0)])[offsets])
            full = np.flatnonzero(own > 0)
            if len(full):
                for j in range(len(self.langs)):
                    sums[first + full, j] += np.add.reduceat(lp[where, j], offsets[:-1][full])
        return -sums / np.maximum(n, 1)[:, None], n, letters


def fit(train: DataFrame, text: str, lang: str, order_by: Column, max_chars: int = 8_000_000) -> Model:
    """A model from labelled rows: a sample of about max_chars characters in all, divided among the languages.

    Rows with null text or lang are left out. The sample takes whole rows whose hash of order_by (a
    column that tells rows apart) falls below the share of its language; of it, a fifth is kept back
    to calibrate rejection; a language of which fewer than five texts are kept back rejects nothing. The bound makes what the driver gathers at most max_chars n-grams. Of alphabets
    beyond MOST_LETTERS letters, the rarest share one symbol. Where no labelled row has a letter, the model knows no language.
    """
    small_batches(train.sparkSession)
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn(lang, F.make_valid_utf8(F.col(lang)))
    sizes = {r[0]: int(r[1] or 0) for r in rows.groupBy(F.col(lang)).agg(F.sum(F.length(text))).collect()}
    if not sizes:
        return Model(np.empty(0, np.int64), {})
    share = {k: min(1.0, max_chars / len(sizes) / max(v, 1)) for k, v in sizes.items()}
    u = F.pmod(F.xxhash64(order_by, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    part = F.pmod(F.xxhash64(order_by, F.lit("part")), F.lit(5)) == 0
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(lang))
    sample = written(rows.where(u < limit).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"), part.alias("held")), "langid")

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, cp, _, _ in _coded(b.column(0).to_pylist()):
                cp, n = np.unique(cp, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cp.astype(np.int64)), pa.array(n)], names=["cp", "n"])

    letters = sample.select("text").mapInArrow(count_letters, "cp long, n long").where("cp > 0").groupBy("cp").agg(F.sum("n").alias("n"))
    found = letters.orderBy(F.desc("n"), "cp").limit(MOST_LETTERS).collect()
    shell = Model(np.array([r["cp"] for r in found], np.int64), {})

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for name in sorted(set(names)):
                for _, _, cp, offsets, before in _coded([texts[k] for k in np.flatnonzero(names == name)]):
                    keys, n = np.unique(_grams(shell.number(cp), offsets, shell.size, shell.number(before)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def packed(t: pa.Table) -> pa.Table:
        data = [[t[c].to_numpy().astype(np.int64).tobytes()] for c in ("gram", "n")]
        return pa.table({"lang": t["lang"][:1], "gram": pa.array(data[0], pa.binary()), "n": pa.array(data[1], pa.binary())})

    counted = sample.where("not held").select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    of_lang: dict[str, list] = {}
    for r in counted.groupBy("lang", F.pmod(F.xxhash64("gram"), F.lit(GROUPS))).applyInArrow(packed, "lang string, gram binary, n binary").collect():
        of_lang.setdefault(r["lang"], []).append((np.frombuffer(r["gram"], np.int64), np.frombuffer(r["n"], np.int64)))
    counts = {}
    for name, parts in of_lang.items():
        keys, n = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        order = np.argsort(keys)  # packed grams are below 2^60
        counts[name] = (keys[order].astype(np.uint64), n[order].astype(np.float64))
    model = Model(shell.alphabet, counts)
    if not counts:
        return model

    def own_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            h, n, _ = model.entropies(b.column(1).to_pylist())
            col = [model.langs.index(x) if x in model.langs else 0 for x in names]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h[np.arange(len(n)), col])], names=["lang", "n", "h"])

    held = sample.where("held").select("lang", "text").mapInArrow(own_entropy, "lang string, n long, h double").where("n > 0").toPandas()
    model.limits = _limits(held, model.langs)
    return model


def _limits(held, langs: list[str]) -> dict[str, tuple[float, float, float]]:
    """(mean bits a character, variance of long texts, variance that a character adds) of each language."""
    out = {}
    for x in langs:
        own = held[held["lang"] == x] if len(held) else held
        if len(own) < 5:
            out[x] = (float("inf"), 0.0, 0.0)  # too little to calibrate with: nothing is rejected
            continue
        mean = float(np.average(own["h"], weights=own["n"]))
        sq = (own["h"] - mean) ** 2
        long = sq[own["n"] >= own["n"].median()]
        out[x] = (mean, float(long.mean()), float((sq * own["n"]).mean()))
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, z: float = 8.0) -> DataFrame:
    """Struct `row` (the carried columns), lang_pred, score, entropy (bits a character), rejected.

    The language is the one of lowest length-normalised cross-entropy over the whole text (ties: the
    first by name); score is its softmax share, with at most 50 characters' weight. Rejected: texts
    that are null or without a letter (lang_pred `und`, score 0), and texts whose cross-entropy is over
    z calibrated standard deviations, for a text of this length, above the mean of the language, and over
    half way from that mean to the language's own letters at random. One
    narrow pass; a model without languages gives `und` and rejects only texts without letters; the model is broadcast, its size bounded by the sample.
    Repeated rows are scored alike. Bytes that are no UTF-8 count as other characters. A text of any length is scored part by part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        kinds = m.kinds()
        limits = np.array([m.limits.get(x, (np.inf, 0.0, 0.0)) for x in m.langs])

        def run(texts: list) -> dict:
            h, n, letters = m.entropies(texts)
            none = letters == 0
            if not m.langs:
                k = len(texts)
                return {"lang_pred": ["und"] * k, "score": [0.0] * k, "entropy": [0.0] * k, "rejected": none.tolist()}
            best = h.argmin(axis=1)
            own = h[np.arange(len(h)), best]
            p = 1 / np.exp2((own[:, None] - h) * np.minimum(n, 50)[:, None]).sum(axis=1)
            mean, wide, each = limits[best].T
            # nor is a text far off that is still nearer to the language than to letters at random
            far = own > np.maximum(mean + z * np.sqrt(wide + each / np.maximum(n, 1)), (mean + np.log2(kinds[best])) / 2)
            pred = ["und" if x else m.langs[j] for x, j in zip(none.tolist(), best.tolist())]
            return {"lang_pred": pred, "score": np.where(none, 0.0, p).tolist(), "entropy": np.where(none, 0.0, own).tolist(), "rejected": (none | far).tolist()}

        return run

    return per_text(docs, text, carry, "lang_pred string, score double, entropy double, rejected boolean", start)
