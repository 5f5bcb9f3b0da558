"""Ridge fits of all parameter sets and folds of a grid together, where features are too many for sums of their pairs.

For one kernel and fold, (G M + alpha) u = b for all alphas has one Krylov space: conjugate gradients for the least alpha give the
others by recurrences of numbers (a shift changes no residual's direction). A pass over the strings multiplies for all kernels
and folds at once, so a grid takes as many passes as its slowest fit takes steps, however many sets it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..params import KernelParams
from ..shared import at_most
from ._passes import CodedRows, padded_rows
from .learn import MOST_CELLS, Features, centre_of, coded_matrix, sums_by_fold, training_rows

#: Steps at most, and how far the residual of each fit has to fall.
STEPS, TOL = 4000, 1e-11


def grid_of_shifts(df: DataFrame, f: Features, sets: pd.DataFrame, normalized: bool, center: bool, fold: str) -> list[dict]:
    """A row (param_id, sigma_p, sigma_c, n, alpha, fold, phase, r2, mse, rows) for each set, fold and phase. sets: of one gram length.

    Kernels are taken together as far as their coefficients fit a model's cells, at least one at a time.
    """
    n = int(sets["n"].iloc[0])
    kernels = [(KernelParams(float(sp), float(sc), n, normalized), part) for (sp, sc), part in sets.groupby(["sigma_p", "sigma_c"])]
    folds = sorted(r[0] for r in at_most(df.select(fold).distinct(), 1000, "folds"))
    alphas = max(len(part) for _, part in kernels)
    at_once = max(1, MOST_CELLS // (2 * len(folds) * alphas * (len(f) + 1)))
    out = []
    for a in range(0, len(kernels), at_once):
        out += _solved(df, f, kernels[a : a + at_once], folds, center, fold)
    return out


def _rows(df: DataFrame, f: Features, kernels: list[KernelParams], folds: list, fold: str) -> CodedRows:
    """Rows with meta: the fold's place, y, and 1 / sqrt(k(x, x)) under each kernel (1 where it is not normalised)."""
    place = {k: i for i, k in enumerate(folds)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y, which, seqs = b["y0"].to_numpy(float), b["fold"].map(place).to_numpy(float), b["seq"].tolist()
            scales = np.ones((len(b), len(kernels)))
            for j, p in enumerate(kernels):
                if p.normalized:
                    for of, _, own in coded_matrix(seqs, f, p):
                        scales[of, j] = 1 / np.sqrt(np.where(own > 0, own, np.inf))
            for of, idx, _ in coded_matrix(seqs, f, kernels[0]):
                yield pd.DataFrame({"meta": np.column_stack([which[of], y[of], scales[of]]).tolist(), "idx": list(idx.astype(np.int32))})

    return CodedRows(training_rows(df, ["y"], None, fold).mapInPandas(run, "meta array<double>, idx array<int>"), "shifted-rows")


def _solved(df: DataFrame, f: Features, kernels: list[tuple[KernelParams, pd.DataFrame]], folds: list, center: bool, fold: str) -> list[dict]:
    d, nk, nf = len(f), len(kernels), len(folds)
    rows = _rows(df, f, [p for p, _ in kernels], folds, fold)
    kernel_of, fold_of = np.repeat(np.arange(nk), nf), np.tile(np.arange(nf), nk)  # of each column
    cols = nk * nf
    b, mean, g, means_y = np.zeros((d, cols)), np.zeros((d, cols)), np.zeros((d, cols)), np.zeros(cols)
    scale, count = np.ones(cols), np.zeros(cols)
    for j, (p, _) in enumerate(kernels):
        sums = sums_by_fold(df, f, p, ["y"], None, fold, pairs=False)
        total = sum(sums.values(), start=next(iter(sums.values())) - next(iter(sums.values())))
        for i, k in enumerate(folds):
            c, x = j * nf + i, total - sums[k]
            b[:, c], count[c] = x.b[:, 0], x.rows
            if center:
                mean[:, c], _, scale[c] = centre_of(x, f, p)
                g[:, c], means_y[c] = x.g, x.y[0] / x.rows
                b[:, c] = x.b[:, 0] - x.g * means_y[c] - mean[:, c] * (x.sy[0] - means_y[c] * x.s)

    def smooth(v: np.ndarray) -> np.ndarray:
        """M v, each column under its own kernel; v: [features, columns, ...]."""
        out = np.empty_like(v)
        for j, (p, _) in enumerate(kernels):
            own = kernel_of == j
            part = v[:, own].reshape(d, -1)
            out[:, own] = f.apply(part, p).reshape(v[:, own].shape)
        return out * scale.reshape(1, -1, *[1] * (v.ndim - 2))

    def products(totals, given, meta, block):
        (t,) = given
        v2 = meta[:, 2 + kernel_of] ** 2
        q = block.dots(t) * v2 * (meta[:, :1] != fold_of)  # rows of the fold itself don't train
        block.scatter(totals[0], q)

    def gram(t: np.ndarray) -> np.ndarray:
        (got,) = rows.sums((padded_rows(t),), [(d + 1, cols)], products, cols)
        got = got[:d]
        if center:
            mt = (mean * t).sum(axis=0)
            got = got - mean * (g * t).sum(axis=0) - g * mt + count * mean * mt
        return got

    # one column of alphas for each kernel and fold; shorter lists are filled up with their last
    alphas = [part.sort_values("alpha")["alpha"].to_numpy(float) for _, part in kernels]
    na = max(map(len, alphas))
    shift = np.stack([np.pad(x, (0, na - len(x)), mode="edge") for x in alphas])[kernel_of]  # [columns, alphas]
    u = _multi_shift(gram, smooth, b, shift)
    w = smooth(u)  # [features, columns, alphas]
    intercept = np.zeros((cols, na))
    if center:
        intercept = means_y[:, None] - (mean[:, :, None] * w).sum(axis=0)

    def errors(totals, given, meta, block):
        w, intercept = given
        error = block.dots(w) * np.repeat(meta[:, 2 + kernel_of], na, axis=1) + intercept - meta[:, 1:2]
        for i in range(nf):
            own = meta[:, 0] == i
            totals[0][i] += (error[own] ** 2).sum(axis=0)
            totals[1][i] += [own.sum(), meta[own, 1].sum(), (meta[own, 1] ** 2).sum()]

    sse, stats = rows.sums((padded_rows(w.reshape(d, -1)), intercept.reshape(-1)), [(nf, cols * na), (nf, 3)], errors, cols * na)
    sse = sse.reshape(nf, cols, na)
    out = []
    for j, (p, part) in enumerate(kernels):
        for r, own in enumerate(part.sort_values("alpha").itertuples()):
            for i, k in enumerate(folds):
                for phase, of in (("train", [x for x in range(nf) if x != i]), ("test", [i])):
                    rows_, y, yy = stats[of].sum(axis=0)
                    left, spread = sse[of, j * nf + i, r].sum(), yy - y**2 / rows_
                    out.append(
                        {
                            "param_id": int(own.param_id), "sigma_p": p.sigma_p, "sigma_c": p.sigma_c, "n": float(p.n), "alpha": float(own.alpha), "fold": int(k), "phase": phase,
                            "r2": float(1 - left / spread) if spread > 0 else float("nan"), "mse": float(left / rows_), "rows": float(rows_),
                        }
                    )
    return out


def _multi_shift(gram, smooth, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """u [features, columns, alphas] with (G M + alpha) u = b for each column and each of its ascending alphas."""
    d, cols = b.shape
    extra = shift - shift[:, :1]
    u, p = np.zeros((d, *shift.shape)), np.repeat(b[:, :, None], shift.shape[1], axis=2)
    r, seed = b.copy(), b.copy()
    mr = smooth(r)
    mp, now = mr.copy(), (r * mr).sum(axis=0)
    begin = np.where(now > 0, now, 1.0)
    z_was, z_now = np.ones(shift.shape), np.ones(shift.shape)
    a_was, beta_was = np.ones(cols), np.zeros(cols)
    for _ in range(STEPS):
        live = now > TOL**2 * begin
        if not live.any():
            return u
        ap = gram(mp) + shift[:, 0] * seed
        curve = (mp * ap).sum(axis=0)
        a = np.where(live, now / np.where(curve > 0, curve, 1.0), 0.0)
        r = r - a * ap
        mr = smooth(r)
        was, now = now, np.where(live, (r * mr).sum(axis=0), now)
        beta = np.where(live, now / np.where(was > 0, was, 1.0), 0.0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
            below = z_was * a_was[:, None] * (1 + extra * a[:, None]) + (a * beta_was)[:, None] * (z_was - z_now)
            z_new = np.where(below != 0, z_now * z_was * a_was[:, None] / below, 0.0)
            ratio = np.where(z_now != 0, z_new / z_now, 0.0)
        z_new, ratio = (np.where(live[:, None], np.nan_to_num(x), y) for x, y in ((z_new, z_now), (ratio, 1.0)))
        u += (a[:, None] * ratio) * p
        p = np.where(live[:, None], z_new[None] * r[:, :, None] + (beta[:, None] * ratio**2) * p, p)
        seed = np.where(live, r + beta * seed, seed)
        mp = np.where(live, mr + beta * mp, mp)
        z_was, z_now = np.where(live[:, None], z_now, z_was), z_new
        a_was, beta_was = np.where(live, a, a_was), np.where(live, beta, beta_was)
    raise RuntimeError(f"the fits did not settle in {STEPS} steps")
