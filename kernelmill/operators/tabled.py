"""Ridge fits whose features outgrow the driver: coefficients stay tables, whatever their number.

The unknowns are one coefficient a string. (C + alpha / s) c = y is solved by conjugate gradients whose vectors are columns of a table of strings and
whose dot products are aggregations. A product by the kernel goes through the features: sums by (n, pos, gram), M applied by two exchanges
(`smoothed`), and sums by string. The kernel of all strings with a few landmarks preconditions the fit; it changes the number of steps, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import chars, gram_features, length_range, letters_of
from ..params import KernelParams
from ..shared import materialized
from ._blocks import letter_matrix, padded, pair_kernel, position_matrix, self_kernel
from .kernels import descriptor_matrix

#: Cells that a task smooths at once, letters of a string, landmarks, and steps of a fit.
MOST_CELLS, MOST_PLACES, LANDMARKS, STEPS = 20_000_000, 5000, 64, 500
#: A feature with over a SHARES-th of all occurrences (and over LEAST) is dealt into parts of that size before joins: SHARES such features at most.
SHARES, LEAST = 10_000, 10_000
#: Cells of a block of last halves with all first halves.
BLOCK_CELLS = 1_000_000
TOL = 1e-10


@dataclass
class TableModel:
    """A model whose coefficients u (n, pos, gram, v0, v1, ...) are a table, a column for each target; a prediction is features · (M u) · scale + intercept."""

    params: KernelParams
    descriptors: DataFrame
    u: DataFrame
    alpha: np.ndarray
    intercept: np.ndarray
    scale: float
    targets: list[str]
    steps: int = 0


@dataclass(frozen=True)
class Alphabet:
    """Letters in order, and their similarity with a zero row and column for padding."""

    letters: tuple[str, ...]
    sim: np.ndarray


def alphabet_of(descriptors: DataFrame, params: KernelParams) -> Alphabet:
    return Alphabet(tuple(letters_of(descriptors)), letter_matrix(descriptor_matrix(descriptors), params.sigma_c))


# -- M by two exchanges ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _numbers(letters: tuple[str, ...], n: int) -> tuple[dict[str, int], list[str]]:
    """(number of each string of n letters, the strings in order)."""
    every = ["".join(x) for x in product(letters, repeat=n)]
    return {x: i for i, x in enumerate(every)}, every


def _spread(grid: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """[grams of n letters, rest] smoothed over each letter."""
    size, rest = len(s), grid.shape[1]
    grid = grid.reshape(*[size] * n, rest)
    for t in range(n):
        grid = np.moveaxis(np.tensordot(s, grid, (1, t)), 0, t)
    return grid.reshape(size**n, rest)


def _placed(number: dict[str, int], grams: pa.ChunkedArray) -> np.ndarray:
    found = [number.get(x, -1) for x in grams.to_pylist()]
    if -1 in found:
        raise ValueError("letter outside the alphabet")
    return np.array(found, np.int64)


def smoothed(coefs: DataFrame, asked: DataFrame, alphabet: Alphabet, params: KernelParams, columns: Sequence[str], far: int | None = None) -> DataFrame:
    """(n, pos, gram, *columns): M v at the grams asked for (n, pos, gram), different ones; v: the columns of coefs (n, pos, gram, *columns), one row a feature.

    M is a product of a factor for the places and one for each letter. Grams that share their first half meet, and places and last letters are smoothed there;
    then those that share their second half meet, with the grams asked for. A group holds |A|^ceil(n/2) grams at most, however many features or strings there
    are; messages are observed first halves times possible second halves, a packed row over the places for each. far: letters of the longest string, looked up
    where it isn't given.
    """
    letters, columns = alphabet.letters, list(columns)
    t, deep = len(columns), (params.n + 1) // 2
    if far is None:
        far = max(x.agg(F.max(F.col("pos") + F.col("n"))).first()[0] or 1 for x in (coefs, asked))
    if far > MOST_PLACES or far * len(letters) ** deep * t > MOST_CELLS:
        raise ValueError(f"strings of {far} letters and halves of {deep} letters over {len(letters)} outgrow a task")
    s, sigma = alphabet.sim[:-1, :-1], params.sigma_p
    half = lambda x: x.withColumn("head", F.expr("substring(gram, 1, cast(n div 2 as int))")).withColumn("tail", F.expr("substring(gram, cast(n div 2 as int) + 1, n)"))
    # last halves travel in blocks of neighbours, as many as a task takes with all first halves
    size = len(letters)
    width = {n: int(max(1, min(size ** (n - n // 2), BLOCK_CELLS // (size ** (n // 2) * far * t)))) for n in range(1, params.n + 1)}

    def tails(key: tuple, table: pa.Table) -> pa.Table:
        n = key[0].as_py()
        k = n - n // 2
        number, every = _numbers(letters, k)
        grid = np.zeros((far, len(every), t))
        grid[table["pos"].to_numpy(), _placed(number, table["tail"])] = np.column_stack([table[c].to_numpy() for c in columns])
        grid = np.tensordot(position_matrix(far, far, sigma), grid, (1, 0)).transpose(1, 0, 2).reshape(len(every), far * t)
        grid, at = _spread(grid, s, k), range(0, len(every), width[n])
        data = pa.array([grid[a : a + width[n]].tobytes() for a in at], pa.binary())
        return pa.table({"n": pa.array([n] * len(at), pa.int32()), "head": pa.array([key[1].as_py()] * len(at)), "block": pa.array(range(len(at)), pa.int64()), "data": data})

    kind = "n int, pos int, gram string" + "".join(f", {c} double" for c in columns)

    def heads(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n, block = key[0].as_py(), key[1].as_py()
        h = n // 2
        number, _ = _numbers(letters, h)
        out = np.zeros((len(right), t))
        if len(left) and len(right):
            rows = np.stack([np.frombuffer(x) for x in left["data"].to_pylist()])
            grid = np.zeros((len(number), rows.shape[1]))
            grid[_placed(number, left["head"])] = rows
            grid = _spread(grid, s, h).reshape(len(number), -1, far, t)
            tail = _placed(_numbers(letters, n - h)[0], right["tail"]) - block * width[n]
            out = grid[_placed(number, right["head"]), tail, right["pos"].to_numpy()]
        return pa.table({**{c: right[c] for c in ("n", "pos", "gram")}, **{c: out[:, j] for j, c in enumerate(columns)}})

    code = F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, i)])
    unknown = F.raise_error(F.lit("letter outside the alphabet")).cast("int")
    number = F.aggregate(chars("tail"), F.lit(0).cast("long"), lambda a, c: a * size + F.coalesce(code[c], unknown))
    widths = F.create_map(*[F.lit(x) for pair in width.items() for x in pair])
    block = F.floor(number / widths[F.col("n")]).cast("long")
    typed = lambda x: x.select(F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"), "gram", *[c for c in columns if c in x.columns])
    packed = half(typed(coefs)).groupBy("n", "head").applyInArrow(tails, "n int, head string, block long, data binary")
    return packed.groupBy("n", "block").cogroup(half(typed(asked)).withColumn("block", block).groupBy("n", "block")).applyInArrow(heads, kind)


_KEYS = ["n", "pos", "gram"]


@dataclass
class _Asked:
    """The different features (n, pos, gram) of some strings, written, and (n, pos, gram, parts) of the frequent ones, SHARES rows at most."""

    features: DataFrame
    frequent: DataFrame


def _asked(rows: DataFrame, n: int) -> _Asked:
    counted = materialized(gram_features(rows.select("id", "seq"), 1, n).groupBy(_KEYS).agg(F.count("*").alias("found")), "tabled-features")
    most = max(LEAST, (counted.agg(F.sum("found")).first()[0] or 0) // SHARES)
    return _Asked(counted.select(_KEYS), counted.where(F.col("found") > most).select(*_KEYS, F.ceil(F.col("found") / most).cast("int").alias("parts")))


def _weighed(grams: DataFrame, key: str, w: DataFrame, asked: _Asked) -> DataFrame:
    """grams joined with their weights; a frequent feature's rows are dealt by a hash of `key`, its weight goes to all its parts."""
    parts, small = F.coalesce(F.col("parts"), F.lit(1)), F.broadcast(asked.frequent)
    left = grams.join(small, _KEYS, "left").withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("parts")
    right = w.join(small, _KEYS, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*_KEYS, "part"])


# -- the fit -----------------------------------------------------------------------------------------------------------


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).reshape(-1), pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)


def _total(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of what `of` gives for each batch, `size` doubles, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["x"])

    parts = rows.mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "x"))
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # `size` rows
        out[r["i"]] = r["x"]
    return out


def _once(df: DataFrame, targets: Sequence[str], weight: str | None) -> DataFrame:
    """(id, seq, w, times, y): the different strings with the sum of their weights, their number, and the weighted mean of each target. A fit's squared
    errors of equal strings differ from those of their mean by a constant, so the fit is the same."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    lost = F.lit(float("nan"))  # a missing value spoils the fit, it isn't left out
    sums = [F.sum(F.coalesce(w * F.col(c).cast("double"), lost)).alias(f"__y{j}") for j, c in enumerate(targets)]
    rows = df.groupBy("seq").agg(F.min("id").alias("id"), F.sum(F.coalesce(w, lost)).alias("w"), F.count("*").cast("double").alias("times"), *sums)
    y = F.array(*[F.when(F.col("w") == 0, 0.0).otherwise(F.try_divide(f"__y{j}", "w")) for j in range(len(targets))])
    return rows.select("id", "seq", "w", "times", y.alias("y"))


def _with_landmarks(df: DataFrame, targets: Sequence[str], weight: str | None, marks: list[str], alphabet: Alphabet, params: KernelParams) -> DataFrame:
    """(id, seq, s, unit, times, y, near) of the different strings: s the root of the weight, unit what a string's features count, near its kernel with the
    landmarks."""
    letters, sim = {c: i for i, c in enumerate(alphabet.letters)}, alphabet.sim

    def coded(seqs: list[str]) -> np.ndarray:
        if any(c not in letters for x in seqs for c in x):
            raise ValueError("letter outside the alphabet")
        return padded([[letters[c] for c in x] for x in seqs])

    def units(codes: np.ndarray) -> np.ndarray:
        own = self_kernel(codes, sim, params.sigma_p, params.n) if codes.shape[1] else np.zeros(len(codes))
        return np.where(own > 0, 1 / np.sqrt(np.where(own > 0, own, 1.0)), 0.0) if params.normalized else np.ones(len(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = coded(marks)
        zu = units(z)
        for b in batches:
            x = coded(b.column("seq").to_pylist())
            unit = units(x)
            near = (pair_kernel(x, z, sim, params.sigma_p, params.n) if x.shape[1] else np.zeros((len(x), len(z)))) * unit[:, None] * zu
            own = [b.column(c) for c in ("id", "seq", "s")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(unit), b.column("times"), b.column("y"), _lists(near)], names=["id", "seq", "s", "unit", "times", "y", "near"])

    rows = _once(df, targets, weight).select("id", "seq", F.sqrt("w").alias("s"), "times", "y")
    return rows.mapInArrow(run, f"id {dict(df.dtypes)['id']}, seq string, s double, unit double, times double, y array<double>, near array<double>")


def _kernel_times(rows: DataFrame, values: list, asked: _Asked, far: int, alphabet: Alphabet, params: KernelParams) -> tuple[DataFrame, DataFrame]:
    """((id, q0, q1, ...) the sums of the kernel with all rows times their values, of strings with a letter; the sums by feature)."""
    names = [f"v{j}" for j in range(len(values))]
    given = rows.select(F.struct(*[(F.col("unit") * v).alias(c) for c, v in zip(names, values)]).alias("id"), "seq")
    coefs = gram_features(given, 1, params.n).groupBy("n", "pos", "gram").agg(*[F.sum(F.col("id")[c]).alias(c) for c in names])
    w = smoothed(coefs, asked.features, alphabet, params, names, far)
    grams = gram_features(rows.select(F.struct("id", "unit").alias("id"), "seq"), 1, params.n)
    sums = _weighed(grams, "id.id", w, asked).groupBy(F.col("id.id").alias("id"))
    return sums.agg(*[(F.first("id.unit") * F.sum(c)).alias(f"q{j}") for j, c in enumerate(names)]), coefs


def fit_tabled(
    df: DataFrame,
    descriptors: DataFrame,
    params: KernelParams,
    alpha: float | Sequence[float] = 1.0,
    center: bool = False,
    sample_weight: str | None = None,
    targets: Sequence[str] = ("y",),
    landmarks: int = LANDMARKS,
) -> TableModel:
    """What fit_ridge fits, with coefficients as tables: any number of strings and of features. Ids must be different. Equal strings are one row. A step writes the
    different strings once, with a vector's values; all targets share the steps. Settled when the residual of each target has fallen to TOL of its values, else an error after STEPS steps."""
    targets = list(targets)
    t = len(targets)
    alphas = np.broadcast_to(np.asarray(alpha, float), (t,)).copy()
    if (alphas <= 0).any() or landmarks < 1:
        raise ValueError("alpha and landmarks must be positive")
    marks = [r[0] for r in df.where("seq <> ''").select("seq").distinct().orderBy(F.xxhash64("seq"), "seq").limit(landmarks).collect()]
    if not marks:
        raise ValueError("no rows to fit")
    alphabet = alphabet_of(descriptors, params)
    rows = materialized(_with_landmarks(df, targets, sample_weight, marks, alphabet, params), "tabled-rows")
    asked = _asked(rows, params.n)
    count, far, m = int(rows.agg(F.sum("times")).first()[0]), int(length_range(rows).first()["max_len"]), len(marks)
    scale, y_mean = 1.0, np.zeros(t)
    if center:
        ones, _ = _kernel_times(rows, [F.col("times")], asked, far, alphabet, params)
        mean = ones.join(rows.select("id", "times"), "id").agg(F.sum(F.col("times") * F.col("q0"))).first()[0] / count**2
        own = _own(rows, descriptors, params)
        if own - mean <= 0:
            raise ValueError("the kernel has no variance over these strings")
        scale = 1 / (own - mean)
        y_mean = np.array(df.agg(*[F.avg(F.col(c).cast("double")) for c in targets]).first(), float)

    # near (less its means) times root of the landmarks' own kernel: B B' is about the kernel, and (B B' + alpha) has an inverse by B'B
    def products(b: pa.RecordBatch) -> np.ndarray:
        x, s = np.column_stack([_matrix(b, "near"), np.ones(b.num_rows)]), b.column("s").to_numpy()
        return np.concatenate([((x * (s * s)[:, None]).T @ x).reshape(-1), b.column("times").to_numpy() @ x])

    flat = _total(rows, products, (m + 1) ** 2 + m + 1)
    shift = np.eye(m + 1)[:, :m].copy()
    if center:
        shift[m] = -flat[-(m + 1) : -1] / count
    root = shift @ _landmark_root(marks, alphabet, params) * np.sqrt(scale)  # [near, 1] @ root is a row of B / s
    gram = root.T @ flat[: (m + 1) ** 2].reshape(m + 1, m + 1) @ root
    inner = [np.linalg.inv((gram + gram.T) / 2 + a * np.eye(len(gram))) for a in alphas]

    def br(b: pa.RecordBatch) -> np.ndarray:
        """B'r of each target, and r'r."""
        x, r = np.column_stack([_matrix(b, "near"), np.ones(b.num_rows)]), _matrix(b, "r")
        return np.concatenate([(root.T @ (x.T @ (r * b.column("s").to_numpy()[:, None]))).reshape(-1), (r * r).sum(axis=0)])

    names = ["id", "seq", "s", "unit", "times", "near", "x", "r", "p"]
    kind = f"id {dict(df.dtypes)['id']}, seq string, s double, unit double, times double, near array<double>, x array<double>, r array<double>, p array<double>"

    def turned(state: DataFrame, back: np.ndarray, beta: np.ndarray) -> DataFrame:
        """p becomes P r + beta p; back: for each target, what takes [near, 1] to the part that B knows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, r = np.column_stack([_matrix(b, "near"), np.ones(b.num_rows)]), _matrix(b, "r")
                z = (r - (x @ back) * b.column("s").to_numpy()[:, None]) / alphas
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), _lists(z + beta * _matrix(b, "p"))], names=names)

        return state.mapInArrow(run, kind)

    def conditioned(state: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(back of each target, r'Pr, r'r)."""
        flat = _total(state, br, len(gram) * t + t)
        b_r, rr = flat[:-t].reshape(len(gram), t), flat[-t:]
        taken = np.column_stack([inner[j] @ b_r[:, j] for j in range(t)])
        return root @ taken, (rr - (b_r * taken).sum(axis=0)) / alphas, rr

    zeros = F.array(*[F.lit(0.0)] * t)
    first = F.array(*[F.col("s") * (F.col("y")[j] - float(y_mean[j])) for j in range(t)])
    state = rows.select("id", "seq", "s", "unit", "times", "near", zeros.alias("x"), first.alias("r"), zeros.alias("p"))
    back, now, begin = conditioned(state)
    state, done = turned(state, back, np.zeros(t)), begin <= 0
    steps = 0
    while not done.all():
        if steps == STEPS:
            raise RuntimeError(f"the fit did not settle in {STEPS} steps")
        steps += 1
        value = [F.col("s") * F.col("p")[j] for j in range(t)]
        if center:
            sums = state.agg(*[F.sum(v) for v in value]).first()
            value = [v - F.col("times") * F.lit(float(x) / count) for v, x in zip(value, sums)]
        q, _ = _kernel_times(state, value, asked, far, alphabet, params)
        state = materialized(state.join(q, "id", "left"), "tabled-step")
        got = [F.coalesce(F.col(f"q{j}"), F.lit(0.0)) for j in range(t)]
        means = np.array(state.agg(*[F.sum(F.col("times") * x) / count for x in got]).first()) if center else np.zeros(t)
        ap = [F.col("s") * (got[j] - float(means[j])) * scale + float(alphas[j]) * F.col("p")[j] for j in range(t)]
        curve = np.array(state.agg(*[F.sum(F.col("p")[j] * ap[j]) for j in range(t)]).first())
        a = np.where(done, 0.0, now / np.where(done, 1.0, curve))
        x = F.array(*[F.col("x")[j] + float(a[j]) * F.col("p")[j] for j in range(t)])
        r = F.array(*[F.col("r")[j] - float(a[j]) * ap[j] for j in range(t)])
        state = state.select("id", "seq", "s", "unit", "times", "near", x.alias("x"), r.alias("r"), "p")
        was = now
        back, now, rr = conditioned(state)
        beta = np.where(done, 0.0, now / np.where(done, 1.0, was))
        done |= rr <= TOL**2 * begin
        state = turned(state, back, beta)
    c = [F.col("s") * F.col("x")[j] for j in range(t)]
    if center:
        sums = state.agg(*[F.sum(v) for v in c]).first()
        c = [v - F.col("times") * F.lit(float(x) / count) for v, x in zip(c, sums)]
    q, u = _kernel_times(state, c, asked, far, alphabet, params)
    intercept = y_mean
    if center:
        totals = q.join(state.select("id", "times"), "id").agg(*[F.sum(F.col("times") * F.col(f"q{j}")) for j in range(t)]).first()
        intercept = y_mean - scale * np.array(totals) / count
    return TableModel(params, descriptors, materialized(u, "tabled-model"), alphas, intercept, scale, targets, steps)


def _own(rows: DataFrame, descriptors: DataFrame, params: KernelParams) -> float:
    """The mean kernel with themselves of the strings that the rows stand for."""
    from .kernels import gs_self

    if params.normalized:
        own = rows.select("times", F.when(F.col("unit") > 0, 1.0).otherwise(0.0).alias("k"))
    else:
        own = rows.select("id", "times").join(gs_self(rows, descriptors, params), "id", "left")
    return own.agg(F.sum(F.col("times") * F.coalesce("k", F.lit(0.0))) / F.sum("times")).first()[0]


def _landmark_root(marks: list[str], alphabet: Alphabet, params: KernelParams) -> np.ndarray:
    """R with R R' the inverse of the landmarks' own kernel, where it has one."""
    letters = {c: i for i, c in enumerate(alphabet.letters)}
    z = padded([[letters[c] for c in x] for x in marks])
    k = pair_kernel(z, z, alphabet.sim, params.sigma_p, params.n)
    if params.normalized:
        unit = 1 / np.sqrt(np.diag(k))
        k = k * unit[:, None] * unit
    w, v = np.linalg.eigh((k + k.T) / 2)
    keep = w > w.max() * 1e-10
    return v[:, keep] / np.sqrt(w[keep])


def weights_of(model: TableModel, grams: DataFrame) -> DataFrame:
    """(n, pos, gram, v0, v1, ...) M u · scale for a table of (n, pos, gram), different ones."""
    names = [f"v{j}" for j in range(len(model.targets))]
    w = smoothed(model.u, grams, alphabet_of(model.descriptors, model.params), model.params, names)
    return w.select("n", "pos", "gram", *[(F.col(c) * float(model.scale)).alias(c) for c in names])


def predict_tabled(model: TableModel, df: DataFrame) -> DataFrame:
    """(id, target, prediction) for every string of df (id, seq); ids must be different."""
    from .kernels import gs_self

    feats = gram_features(df.select("id", "seq"), 1, model.params.n)
    asked = _asked(df, model.params.n)
    sums = _weighed(feats, "id", weights_of(model, asked.features), asked).groupBy("id").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(len(model.targets))])
    rows = df.select("id").join(sums, "id", "left")
    norm = F.lit(1.0)
    if model.params.normalized:
        rows, norm = rows.join(gs_self(df, model.descriptors, model.params), "id", "left"), F.sqrt("k")
    each = [F.struct(F.lit(name).alias("target"), (F.coalesce(F.col(f"v{j}") / norm, F.lit(0.0)) + float(model.intercept[j])).alias("prediction")) for j, name in enumerate(model.targets)]
    return rows.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.target", "x.prediction")
