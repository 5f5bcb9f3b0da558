"""The strings that a weight table rates highest: layered dynamic programs and pruned frontiers.

Weights are (model_id, pos, gram, w) with grams of one length n. A layer is a table keyed by (model_id, last gram); its
rows are bounded by models times |A|^n times k, whatever the length. Each layer is one equi-join on the n-1 letters that
neighbouring grams share and one window; lineage is cut every few layers.
Ties are broken by score, then by the string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import letters_of
from ..params import KernelParams
from ..shared import at_most, materialized
from ._blocks import letter_matrix, position_matrix
from .kernels import descriptor_matrix

#: Layers between two cuts of the lineage.
CUT = 4


def _gram_length(weights: DataFrame) -> int:
    sizes = [r[0] for r in weights.select(F.length("gram")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("weights need grams of one length")
    return sizes[0]


def _overlap(layer: DataFrame, weights: DataFrame, pos: int | None, n: int) -> DataFrame:
    """Each string of a layer with every gram that may follow."""
    step = (weights if pos is None else weights.where(F.col("pos") == pos)).select("model_id", F.col("gram").alias("next"), "w")
    step = step.withColumn("shared", F.substring("next", 1, n - 1) if n > 1 else F.lit(""))
    tail = layer.withColumn("shared", F.substring("gram", 2, n - 1) if n > 1 else F.lit(""))
    return tail.join(step, ["model_id", "shared"])


def _positions(weights: DataFrame) -> bool:
    """Whether the table tells positions apart; a table without pos, or all null, holds at every position."""
    return "pos" in weights.columns and weights.where("pos is not null").limit(1).count() > 0


def layer_max(weights: DataFrame, length: int) -> DataFrame:
    """(model_id, layer, gram, score): the best score of a string of layer + n letters that ends with gram."""
    n, by_pos = _gram_length(weights), _positions(weights)
    if length < n:
        raise ValueError("length must be at least n")
    first = weights.where("pos = 0") if by_pos else weights
    layer = first.select("model_id", F.lit(0).alias("layer"), "gram", F.col("w").alias("score"))
    out = layer
    for p in range(1, length - n + 1):
        grown = _overlap(layer, weights, p if by_pos else None, n)
        layer = grown.groupBy("model_id", F.lit(p).alias("layer"), F.col("next").alias("gram")).agg((F.max("score") + F.first("w")).alias("score"))
        if p % CUT == 0:
            layer = materialized(layer, "layer")
        out = out.unionByName(layer)
    return out


def _best(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "seq")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grow(layer: DataFrame, weights: DataFrame, first: int, last: int, n: int, k: int, by: list[str], forbidden: DataFrame | None, by_pos: bool) -> DataFrame:
    """Layers first to last, keeping the k best strings for each last gram."""
    for p in range(first, last + 1):
        grown = _overlap(layer, weights, p if by_pos else None, n)
        if forbidden is not None:
            grown = _allowed(grown.withColumn("edge", F.concat(F.substring("gram", 1, 1), "next")), forbidden, p, n)
        grown = grown.select(*by, F.col("next").alias("gram"), (F.col("score") + F.col("w")).alias("score"), F.concat("seq", F.substring("next", n, 1)).alias("seq"))
        layer = _best(grown, k, [*by, "gram"]).drop("rank")
        if p % CUT == 0:
            layer = materialized(layer, "layer")
    return layer


def _allowed(rows: DataFrame, forbidden: DataFrame, p: int, n: int) -> DataFrame:
    """rows without forbidden grams at p and without forbidden steps (grams of n + 1 letters) from p - 1 to p."""
    grams = forbidden.where((F.col("pos") == p) & (F.length("gram") == n)).select(F.col("gram").alias("next"))
    steps = forbidden.where((F.col("pos") == p - 1) & (F.length("gram") == n + 1)).select(F.col("gram").alias("edge"))
    rows = rows.join(grams, "next", "left_anti")
    return rows.join(steps, "edge", "left_anti") if "edge" in rows.columns else rows


def _check_k(weights: DataFrame, n: int, length: int, k: int) -> None:
    letters = weights.select(F.substring("gram", 1, 1)).distinct().count()
    if k < 1 or k > letters**length:
        raise ValueError("k must be between 1 and the number of strings")


def k_best_strings(weights: DataFrame, length: int, k: int, ends: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """(model_id, rank, seq, score) of the k best strings of `length` letters for each model.

    ends: (model_id, gram, w) added by the last gram. forbidden: (pos, gram) that no string may hold there, with n letters,
    or n + 1 for a step between neighbouring grams. If length < n (weights rolled up with end weights), the grams are cut to length.
    """
    n, by_pos = _gram_length(weights), _positions(weights)
    _check_k(weights, n, length, k)
    first = weights.where("pos = 0") if by_pos else weights
    start = first.select("model_id", "gram", F.col("w").alias("score"), F.col("gram").alias("seq"))
    if forbidden is not None:
        start = _allowed(start.withColumnRenamed("gram", "next"), forbidden, 0, n).withColumnRenamed("next", "gram")
    last = max(0, length - n)
    layer = _grow(start, weights, 1, last, n, k, ["model_id"], forbidden, by_pos)
    return _finish(layer, ends, length, k, ["model_id"])


def _finish(layer: DataFrame, ends: DataFrame | None, length: int, k: int, by: list[str]) -> DataFrame:
    if ends is not None:
        layer = layer.join(ends.select("model_id", "gram", F.col("w").alias("more")), ["model_id", "gram"]).withColumn("score", F.col("score") + F.col("more"))
    rows = layer.select(*by, F.substring("seq", 1, length).alias("seq"), "score")
    rows = rows.groupBy(*by, "seq").agg(F.max("score").alias("score"))
    return _best(rows, k, by).select(*by, "rank", "seq", "score")


def best_string(weights: DataFrame, length: int, ends: DataFrame | None = None) -> DataFrame:
    """(model_id, seq, score) of the best string of `length` letters; one row of weights without positions is used at every position."""
    return k_best_strings(weights, length, 1, ends).drop("rank")


def best_string_in_range(weights: DataFrame, ends: DataFrame, shortest: int, longest: int, min_n: int, normalized: bool) -> DataFrame:
    """(model_id, length, seq, value): best string over a range of lengths, all at least n.

    normalized: greatest score / sqrt(norm); else least norm - 2 score; norm is the number of grams of min_n to n letters.
    ends: (model_id, length, gram, w).
    """
    n, by_pos = _gram_length(weights), _positions(weights)
    if not n <= shortest <= longest:
        raise ValueError("n <= shortest <= longest is needed")
    first = weights.where("pos = 0") if by_pos else weights
    layer = first.select("model_id", "gram", F.col("w").alias("score"), F.col("gram").alias("seq"))
    out = None
    for size in range(n, longest + 1):
        if size > n:
            layer = _grow(layer, weights, size - n, size - n, n, 1, ["model_id"], None, by_pos)
        if size >= shortest:
            norm = float(sum(size - m + 1 for m in range(min_n, n + 1)))
            done = _finish(layer, ends.where(F.col("length") == size).drop("length"), size, 1, ["model_id"])
            value = F.col("score") / norm**0.5 if normalized else 2 * F.col("score") - norm
            done = done.select("model_id", F.lit(size).alias("length"), "seq", value.alias("v"))
            out = done if out is None else out.unionByName(done)
    best = out.groupBy("model_id").agg(F.max_by(F.struct("length", "seq", "v"), F.struct("v", -F.col("length"))).alias("b"))
    return best.select("model_id", "b.length", "b.seq", (F.col("b.v") if normalized else -F.col("b.v")).alias("value"))


def complete_prefix(weights: DataFrame, prefixes: DataFrame, length: int, k: int) -> DataFrame:
    """(prefix_id, model_id, rank, seq, score): the k best strings of `length` letters that start with each prefix (prefix_id, prefix) of n or more letters."""
    n = _gram_length(weights)
    size = F.length("prefix")
    shortest, longest = prefixes.agg(F.min(size), F.max(size)).first()
    if shortest is not None and not n <= shortest <= longest <= length:
        raise ValueError("prefixes need n to length letters")
    by, layer = ["prefix_id", "model_id"], None
    places = F.explode(F.sequence(F.lit(0), F.length("prefix") - n)).alias("pos")
    grams = prefixes.select("prefix_id", "prefix", places).withColumn("gram", F.expr(f"substring(prefix, pos + 1, {n})"))
    scored = grams.join(weights, ["pos", "gram"]).groupBy("prefix_id", "prefix", "model_id").agg(F.sum("w").alias("score"))
    ready = scored.select(*by, F.substring("prefix", -n, n).alias("gram"), "score", F.col("prefix").alias("seq"))
    for size in range(length if shortest is None else shortest, length + 1):
        new = ready.where(F.length("seq") == size)
        if layer is not None:
            new = new.unionByName(_grow(layer, weights, size - n, size - n, n, k, by, None, True))
        layer = new
    return _finish(layer, None, length, k, by)


class _Norms:
    """Bounds of the kernel of a string with itself, where its end is known and the letters before are free.

    A free letter stands for the one that gives least (or most) against each known letter, place by place, so known letters bound the cross part too;
    only pairs of two different free places fall back on the least similarity of all.
    """

    def __init__(self, letters: list[str], vectors: np.ndarray, params: KernelParams, kernel: str, min_n: int, objective: str, length: int):
        self.letters, self.n, self.min_n, self.length, self.objective = letters, params.n, min_n, length, objective
        s = letter_matrix(vectors, params.sigma_c)[:-1, :-1] if kernel == "gs" else np.eye(len(letters))
        self.p = position_matrix(length, length, params.sigma_p)
        self.least, self.most = (np.block([[s, f(s, axis=0)[:, None]], [f(s, axis=0)[None, :], np.full((1, 1), f(s))]]) for f in (np.min, np.max))

    def norm(self, codes: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Kernels of coded strings with themselves under letter similarities s; a place is like itself."""
        m = codes.shape[1]
        s = s[codes[:, :, None], codes[:, None, :]]
        s[:, np.arange(m), np.arange(m)] = 1.0
        total, chain = np.zeros_like(s), np.ones_like(s)
        for t in range(min(self.n, m)):
            chain = chain[:, : m - t, : m - t] * s[:, t:, t:]
            if t + 1 >= self.min_n:
                total[:, : m - t, : m - t] += chain
        return np.einsum("aij,ij->a", total, self.p)

    def bound(self, seqs: list[str], best: np.ndarray) -> np.ndarray:
        """Most that the objective can be for strings that end so and score at most `best`; the objective itself for whole strings."""
        number, free = {c: i for i, c in enumerate(self.letters)}, self.length - len(seqs[0])
        codes = np.array([[len(self.letters)] * free + [number[c] for c in x] for x in seqs])
        low = self.norm(codes, self.least)
        if self.objective == "distance":
            return 2 * best - low
        high = self.norm(codes, self.most) if free and (best < 0).any() else low
        return best / np.sqrt(np.where(best >= 0, low, high))


def _frontier(weights: DataFrame, descriptors: DataFrame, params: KernelParams, length: int, k: int, kernel: str, objective: str, min_n: int, max_frontier: int, floor: float = -np.inf) -> tuple[DataFrame, float, bool]:
    """((seq, score) of the k best, the k-th best score, whether exact) for one model.

    An ending carries the weights of its grams after the first (tail), and the best that all before can give comes by a join with the layer of its first
    gram: weights and layers stay tables, of any size. Strings with a gram that has no weight don't occur.
    """
    n = _gram_length(weights)
    if length < n:
        raise ValueError("length must be at least n")
    spark, letters = weights.sparkSession, letters_of(descriptors)
    weights = materialized(weights.select(*weights.columns), "bound-weights")
    layers = materialized(layer_max(weights, length).select("layer", "gram", F.col("score").alias("best")), "bound-layers")
    shared = spark.sparkContext.broadcast(_Norms(letters, descriptor_matrix(descriptors), params, kernel, min_n, objective, length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 10_000):
                part = b.iloc[a : a + 10_000]
                yield pd.DataFrame({"seq": part["seq"], "tail": part["tail"], "score": shared.value.bound(part["seq"].tolist(), part["best"].to_numpy(float))})

    def bounded(rows: DataFrame, first: int) -> DataFrame:
        """rows (seq, tail) with the bound of each as score."""
        layer = layers.where(F.col("layer") == first).select(F.col("gram").alias("g"), "best")
        found = rows.join(layer, F.substring("seq", 1, n) == F.col("g")).select("seq", "tail", (F.col("best") + F.col("tail")).alias("best"))
        return found.mapInPandas(run, "seq string, tail double, score double")

    def longer(rows: DataFrame, first: int) -> DataFrame:
        """Endings that begin at `first`, with each letter before them."""
        own = weights.where(F.col("pos") == first).select(F.col("gram").alias("g"), "w")
        c = F.explode(F.array(*[F.lit(x) for x in letters])).alias("c")
        return rows.join(own, F.substring("seq", 1, n) == F.col("g")).select("seq", (F.col("tail") + F.col("w")).alias("tail"), c).select(F.concat("c", "seq").alias("seq"), "tail")

    last = weights.where(F.col("pos") == length - n).select(F.col("gram").alias("seq"), F.lit(0.0).alias("tail"))

    def level(rows: DataFrame, first: int, above: float, most: int | None) -> tuple[DataFrame, bool]:
        got = bounded(rows, first).where(F.col("score") >= above)
        if most is None:
            return materialized(got.repartition(spark.sparkContext.defaultParallelism, "seq"), "frontier"), True
        got = materialized(got, "frontier")
        full = got.count() <= most
        return (got if full else got.orderBy(F.desc("score"), "seq").limit(most)), full

    def sweep(above: float, most: int | None) -> tuple[DataFrame, bool]:
        rows, exact = level(last, length - n, above, most)
        for first in range(length - n - 1, -1, -1):
            rows, full = level(longer(rows, first + 1), first, above, most)
            exact = exact and full
        return rows.select("seq", "score"), exact

    def kth(rows: DataFrame) -> float:
        best = rows.orderBy(F.desc("score")).limit(k).collect()
        return best[-1]["score"] if len(best) == k else -np.inf

    beam, _ = sweep(floor, 4 * k + 16)
    above = max(floor, kth(beam))
    above -= abs(above) * 1e-12 if np.isfinite(above) else 0.0
    rows, exact = sweep(above, max_frontier)
    return rows.orderBy(F.desc("score"), "seq").limit(k), max(floor, kth(rows)), exact


def _ranked(rows: DataFrame, exact: bool) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "seq")  # k rows
    return rows.select(F.row_number().over(order).alias("rank"), "seq", "score", F.lit(exact).alias("is_exact"))


def k_best_normalized(weights: DataFrame, descriptors: DataFrame, params: KernelParams, length: int, k: int, kernel: str = "gs", min_n: int = 1, max_frontier: int = 2_000_000) -> DataFrame:
    """(rank, seq, score, is_exact): the k strings of greatest score / sqrt(k(y, y)), under the letter-similarity ("gs") or the exact-match ("exact") kernel.

    weights: (pos, gram, w) of one model in fold-last form. A beam of some 4k strings gives a first threshold; then all endings whose
    bound reaches it are grown letter by letter to the left, dealt over the cluster. If a level has more than max_frontier, the
    best are kept and is_exact is false. Where the score is negative, the bound divides by the greatest norm.
    """
    rows, _, exact = _frontier(weights, descriptors, params, length, k, kernel, "normalized", min_n, max_frontier)
    return _ranked(rows, exact)


def _best_over_lengths(tables: dict[int, DataFrame], descriptors, params, kernel, objective, min_n, max_frontier) -> DataFrame:
    floor, found, exact = -np.inf, None, True
    for length, weights in sorted(tables.items()):
        rows, floor, full = _frontier(weights, descriptors, params, length, 1, kernel, objective, min_n, max_frontier, floor)
        rows = rows.withColumn("length", F.lit(length))
        found, exact = (rows if found is None else found.unionByName(rows)), exact and full
    return found.orderBy(F.desc("score"), "length", "seq").limit(1).withColumn("is_exact", F.lit(exact))


def best_normalized_in_range(tables: dict[int, DataFrame], descriptors: DataFrame, params: KernelParams, kernel: str = "gs", min_n: int = 1, max_frontier: int = 2_000_000) -> DataFrame:
    """(seq, score, length, is_exact): the single best normalised string over lengths; tables: the fold-last weights of each length. The best so far is the next length's threshold."""
    return _best_over_lengths(tables, descriptors, params, kernel, "normalized", min_n, max_frontier)


def best_distance(tables: dict[int, DataFrame], descriptors: DataFrame, params: KernelParams, min_n: int = 1, max_frontier: int = 2_000_000) -> DataFrame:
    """(seq, distance, length, is_exact): the string of least k(y, y) - 2 score under the exact-match kernel of min_n to params.n letters."""
    best = _best_over_lengths(tables, descriptors, params, "exact", "distance", min_n, max_frontier)
    return best.select("seq", (-F.col("score")).alias("distance"), "length", "is_exact")


def design(train: DataFrame, coef_col: str, descriptors: DataFrame, params: KernelParams, length: int, k: int) -> DataFrame:
    """(rank, seq, score, is_exact): the k strings that a fitted model rates highest; train: (id, seq, coefficient). Centring is ignored."""
    from .weights import gram_weights, normalized_coef

    rows = train.select("id", "seq", F.col(coef_col).alias("coef"))
    if params.normalized:
        rows = normalized_coef(rows, descriptors, params)
    weights = materialized(gram_weights(rows, descriptors, params, length, fold_last=True), "design")
    if params.normalized:
        return k_best_normalized(weights, descriptors, params, length, k)
    return k_best_strings(weights, length, k).select("rank", "seq", "score", F.lit(True).alias("is_exact"))


def rank_candidates(scores: DataFrame, k: int, score: str = "score", by: str | None = None) -> DataFrame:
    """The k rows of greatest score (ties by id), overall or in each group: the screening of a given table of strings."""
    if by is None:
        return scores.orderBy(F.desc(score), "id").limit(k)
    order = Window.partitionBy(by).orderBy(F.desc(score), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
