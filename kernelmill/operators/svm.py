"""Support vector machines on strings in feature form, for any number of strings and any number of features that a model may hold.

The primal problem, min 1/2 |w|^2 + C sum s loss(y f), is solved by Newton steps in u, where w = sum of u times the features' vectors and
f = F M u + b. A step solves (I + F'cF M) d = -g by conjugate gradients in the inner product of M, c being the curvatures of the loss: a pass
over the strings for each product, no kernel of strings and no matrix of features. With few features the sums F'cF come from one pass instead,
and the step is solved in the driver. All pairs of classes are solved together, so their number doesn't multiply the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import KernelParams
from ..shared import at_most
from ._passes import CodedRows, padded_rows
from .learn import MOST_CELLS, MOST_DENSE, StringModel, centre_of, coded_matrix, observed_features, predict_ridge, sums_by_fold

#: Classes at most, and widths of the smoothed corner of the hinge: each fit starts from the one before. Where a fit doesn't settle from there, widths between
#: the two are taken first, down to this ratio of neighbours.
MOST_CLASSES, WIDTHS, NARROWEST = 100, (3.0, 1.0, 0.3, 0.1, 0.03, 0.01), 0.97
#: Newton steps for a width, products of a step, step lengths tried, and how far the gradient has to fall.
NEWTON, PRODUCTS, LENGTHS, TOL = 60, 400, 0.5 ** np.arange(20), 1e-8
#: The share of a penalty by which a step has to lower it for its value to decide.
GAIN = 1e-9


def _loss(margin: np.ndarray, width: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, slope, curvature) of the squared hinge (width None), or of the hinge with its corner rounded over `width` to both sides."""
    if width is None:
        gap = np.maximum(0.0, 1 - margin)
        return gap**2, -2 * gap, 2.0 * (gap > 0)
    t = (1 + width - margin) / (2 * width)
    inside = (t > 0) & (t < 1)
    return np.where(t >= 1, 1 - margin, np.where(inside, width * t**2, 0.0)), -np.clip(t, 0, 1), inside / (2 * width)


def _coded(df: DataFrame, f, params: KernelParams, weight: str | None, classes: list) -> CodedRows:
    """Rows with meta: the class's place, the weight, and 1 / sqrt(k(x, x)), or 1 where the kernel is not normalised."""
    s = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    code = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, k)])[F.col("y")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c, s = b["c"].to_numpy(float), b["s"].to_numpy(float)
            for of, idx, own in coded_matrix(b["seq"].tolist(), f, params):
                v = 1 / np.sqrt(np.where(own > 0, own, np.inf)) if params.normalized else np.ones(len(of))
                yield pd.DataFrame({"meta": np.column_stack([c[of], s[of], v]).tolist(), "idx": list(idx.astype(np.int32))})

    return CodedRows(df.select("seq", code.cast("int").alias("c"), s.alias("s")).mapInPandas(run, "meta array<double>, idx array<int>"), "svm-rows")


def _signs(n: int) -> np.ndarray:
    """[classes, pairs]: the sign of a class in each pair, 0 in those of others."""
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    out = np.zeros((n, len(pairs)))
    for k, (i, j) in enumerate(pairs):
        out[i, k], out[j, k] = -1.0, 1.0
    return out


def fit_svm(
    df: DataFrame, descriptors: DataFrame, params: KernelParams, C: float = 1.0, sample_weight: str | None = None, max_iter: int = NEWTON, center: bool = False, loss: str = "hinge"
) -> StringModel:
    """Support vector classifier of column y on the strings of df (seq, y, ...): one model for each pair of classes, all solved together.

    loss: `hinge`, with its corner rounded over 0.01 to both sides, so that the objective is within C * 0.0025 a string of the hinge's; or
    `squared`. The intercept has no penalty. center: the kernel is centred and scaled by its variance; as the intercept is free, centring
    alone changes nothing. Any number of strings fits; a model may hold MOST_FEATURES different (n, pos, gram). An error where a fit does not
    settle in max_iter Newton steps for a width next to one before, or where a class is alone.
    """
    if loss not in ("hinge", "squared"):
        raise ValueError("loss is hinge or squared")
    if C <= 0:
        raise ValueError("C must be positive")
    f = observed_features(df, descriptors, params.n)
    classes = sorted(r[0] for r in at_most(df.select("y").where("y is not null").distinct(), MOST_CLASSES, "classes"))
    if len(classes) < 2:
        raise ValueError("two classes are needed")
    df = df.where("y is not null")
    scale = centre_of(sums_by_fold(df.withColumn("y", F.lit(0.0)), f, params, ["y"], None)[0], f, params)[2] if center else 1.0
    # strings of a class that are equal are one row of their weights' sum: the penalty is the same
    s = F.lit(1.0) if sample_weight is None else F.col(sample_weight).cast("double")
    rows, sign = _coded(df.groupBy("seq", "y").agg(F.sum(s).alias("s")), f, params, "s", classes), _signs(len(classes))
    d, pairs = len(f), sign.shape[1]
    if (d + 1) * pairs > MOST_CELLS:
        raise ValueError("more coefficients than a model may hold")
    dense = d <= MOST_DENSE and pairs * d * d <= MOST_CELLS // 4
    smooth = lambda x: f.apply(x, params) * scale
    u, b = np.zeros((d, pairs)), np.zeros(pairs)
    solved = lambda u, b, width, tol: _newton(rows, sign, u, b, smooth, C, width, dense, max_iter, tol)
    u, b = solved(u, b, None, TOL) if loss == "squared" else _narrowed(solved, u, b)
    names = [(x, y) for i, x in enumerate(classes) for y in classes[i + 1 :]]
    return StringModel(params, f, u, np.full(pairs, float(C)), b, scale, [f"{x}|{y}" for x, y in names], names)


class Unsettled(RuntimeError):
    """A fit that did not settle."""


def _narrowed(solved: Callable, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fit at the last of WIDTHS, from those at wider ones. The heavier the rows, the nearer to each other the widths have to be."""
    at, ratio = WIDTHS[0], WIDTHS[1] / WIDTHS[0]
    u, b = solved(u, b, at, 1e-3)
    while at > WIDTHS[-1]:
        width = WIDTHS[-1] if at * ratio < WIDTHS[-1] / ratio**0.5 else at * ratio
        try:
            u, b = solved(u, b, width, 1e-3 if width > WIDTHS[-1] else TOL)
        except Unsettled:
            ratio = max(ratio, width / at) ** 0.5
            if ratio > NARROWEST:
                raise
        else:
            at, ratio = width, max(ratio**1.5, WIDTHS[1] / WIDTHS[0])
    return u, b


def _newton(rows: CodedRows, signs: np.ndarray, u: np.ndarray, b: np.ndarray, smooth: Callable, C: float, width: float | None, dense: bool, most: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    d, pairs = u.shape
    mu, first = smooth(u), None
    inner = lambda x, mx, xb, y, yb: (mx * y).sum(axis=0) + xb * yb

    def slopes(t, given, meta, block):
        mu, b = given
        sign, s, v = signs[meta[:, 0].astype(int)], meta[:, 1:2], meta[:, 2:]
        value, slope, curve = _loss(sign * (block.dots(mu) * v + b), width)
        used = sign != 0
        t[0] += (C * s * value * used).sum(axis=0)
        g = C * s * slope * sign
        t[1] += g.sum(axis=0)
        block.scatter(t[2], g * v)
        c = C * s * curve * used
        t[3] += c.sum(axis=0)
        if dense:  # sums over pairs of features, too
            block.scatter(t[4], c * v)
            place = np.cumsum(c.any(axis=1)) - 1  # rows without curvature add nothing
            some, of = np.flatnonzero(c.any(axis=1)), c.any(axis=1)[block.row]
            row, idx = place[block.row[of]], block.idx[of]
            for a in range(0, len(some), 2000):
                own, of = some[a : a + 2000], (row >= a) & (row < a + 2000)
                x = np.zeros((len(own), d + 1))
                np.add.at(x, (row[of] - a, idx[of]), 1.0)
                for j in range(c.shape[1]):
                    t[5][j] += x.T @ (x * (c[own, j] * v[own, 0] ** 2)[:, None])

    def products(t, given, meta, block):
        mu, b, mp, pb = given
        sign, s, v = signs[meta[:, 0].astype(int)], meta[:, 1:2], meta[:, 2:]
        _, _, curve = _loss(sign * (block.dots(mu) * v + b), width)
        q = C * s * curve * (sign != 0) * (block.dots(mp) * v + pb)
        t[0] += q.sum(axis=0)
        block.scatter(t[1], q * v)

    def lengths(t, given, meta, block):
        mu, b, mp, pb = given
        sign, s, v = signs[meta[:, 0].astype(int)], meta[:, 1:2], meta[:, 2:]
        at, move, used = block.dots(mu) * v + b, block.dots(mp) * v + pb, sign != 0
        for k, x in enumerate(LENGTHS):
            loss, slope, _ = _loss(sign * (at + x * move), width)
            t[0][k] += (C * s * loss * used).sum(axis=0)
            t[1][k] += (C * s * slope * sign * move).sum(axis=0)

    shapes = [(pairs,), (pairs,), (d + 1, pairs), (pairs,)] + ([(d + 1, pairs), (pairs, d + 1, d + 1)] if dense else [])
    for _ in range(most):
        found = rows.sums((padded_rows(mu), b), shapes, slopes, pairs)
        value, gb, gu = found[0] + (u * mu).sum(axis=0) / 2, found[1], u + found[2][:d]
        mg = smooth(gu)
        norm = np.sqrt(np.maximum(inner(gu, mg, gb, gu, gb), 0))
        first = np.maximum(norm, 1e-300) if first is None else first
        live = norm > tol * np.maximum(first, 1e-3 * C)
        if not live.any():
            return u, b
        damp = 1e-10 * C + np.where(found[3] > 0, 0.0, np.abs(gb))  # without curvature, an intercept moves by one at most
        # conjugate gradients for the step, all pairs together
        x, xb = np.zeros_like(u), np.zeros(pairs)
        r, rb, mr = -gu * live, -gb * live, -mg * live
        p, pb, mp = r.copy(), rb.copy(), mr.copy()
        now = begin = inner(r, mr, rb, r, rb)
        goal = np.minimum(0.1, np.sqrt(norm / first)) ** 2 if not dense else np.full(pairs, 1e-24)
        for _ in range(PRODUCTS if not dense else 10 * PRODUCTS):
            open_ = live & (now > goal * begin) & (now > 0)
            if not open_.any():
                break
            if dense:
                h = found[5][:, :d, :d]
                qu = np.stack([h[j] @ mp[:, j] + found[4][:d, j] * pb[j] for j in range(pairs)], axis=1)
                qb = np.array([found[4][:d, j] @ mp[:, j] for j in range(pairs)]) + found[3] * pb
            else:
                qb, q = rows.sums((padded_rows(mu), b, padded_rows(mp), pb), [(pairs,), (d + 1, pairs)], products, pairs)
                qu = q[:d]
            qu, qb = qu + p, qb + damp * pb
            curve = (mp * qu).sum(axis=0) + pb * qb
            a = np.where(open_ & (curve > 0), now / np.where(curve > 0, curve, 1.0), 0.0)
            x, xb, r, rb = x + a * p, xb + a * pb, r - a * qu, rb - a * qb
            mr = smooth(r)
            was, now = now, inner(r, mr, rb, r, rb)
            beta = np.where(open_, now / np.where(was > 0, was, 1.0), 0.0)
            p, pb, mp = r + beta * p, rb + beta * pb, mr + beta * mp
        mx = smooth(x)
        tried, slope = rows.sums((padded_rows(mu), b, padded_rows(mx), xb), [(len(LENGTHS), pairs)] * 2, lengths, pairs)
        t = LENGTHS[:, None]
        tried = tried + ((u * mu).sum(axis=0) + 2 * t * (x * mu).sum(axis=0) + t**2 * (x * mx).sum(axis=0)) / 2
        slope = np.abs(slope + (x * mu).sum(axis=0) + t * (x * mx).sum(axis=0))
        best, flat = tried.argmin(axis=0), slope.argmin(axis=0)
        # a gain that sums of doubles don't tell from none is told by the slope, which is 0 at a convex function's least value
        clear = value - tried[best, np.arange(pairs)] > GAIN * np.abs(value)
        better = live & (clear | (slope[flat, np.arange(pairs)] < np.abs((gu * mx).sum(axis=0) + gb * xb)))
        best = np.where(clear, best, flat)
        if not better.any():  # as exact as sums of doubles are
            if (norm[live] <= 1e-5 * np.maximum(first, 1e-3 * C)[live]).all():
                return u, b
            raise Unsettled("the fit does not get better")
        t = np.where(better, LENGTHS[best], 0.0)
        u, b, mu = u + t * x, b + t * xb, mu + t * mx
    raise Unsettled(f"the fit did not settle in {most} steps")


def predict_svm(model: StringModel, df: DataFrame) -> DataFrame:
    """(id, label): the class with most votes of the pairwise models; ties go to the first class."""
    pairs = df.sparkSession.createDataFrame([(t, float(a), float(b)) for t, (a, b) in zip(model.targets, model.classes)], "target string, a double, b double")
    votes = predict_ridge(model, df).join(F.broadcast(pairs), "target").select("id", F.when(F.col("prediction") > 0, F.col("b")).otherwise(F.col("a")).alias("label"))
    counted = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def svm_coefficients(model: StringModel, df: DataFrame, loss: str = "hinge", sample_weight: str | None = None) -> DataFrame:
    """(id, target, coef): the coefficient of each training string in each pair of its class, -C s y slope(y f); zero for those outside the margin."""
    s = F.lit(1.0) if sample_weight is None else F.col(sample_weight).cast("double")
    spark = df.sparkSession
    pairs = spark.createDataFrame([(t, float(a), float(b), float(c)) for t, (a, b), c in zip(model.targets, model.classes, model.alpha)], "target string, a double, b double, c double")
    rows = predict_ridge(model, df).join(F.broadcast(pairs), "target").join(df.select("id", F.col("y").cast("double").alias("y"), s.alias("s")), "id")
    rows = rows.where("y = a or y = b").withColumn("sign", F.when(F.col("y") == F.col("b"), 1.0).otherwise(-1.0))
    margin = F.col("sign") * F.col("prediction")
    last = F.lit(WIDTHS[-1])
    slope = 2 * F.greatest(F.lit(0.0), 1 - margin) if loss == "squared" else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 + last - margin) / (2 * last)))
    return rows.select("id", "target", (F.col("c") * F.col("s") * F.col("sign") * slope).alias("coef"))
