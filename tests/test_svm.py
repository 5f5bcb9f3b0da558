"""Support vector machines: the conditions and the duality gap of dense problems, many features, classes and odd tables."""

import math
import random

import numpy as np
import pytest

from kernelmill.operators import learn, svm
from kernelmill.params import KernelParams
from tests.test_kernels import LETTERS, k


@pytest.fixture(scope="module")
def desc(spark):
    return spark.createDataFrame(LETTERS, "letter string, letter_idx int, descriptors array<double>")


def strings(n, size, seed, letters="ABC"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(size[0], size[1] + 1)))
        out.append((i, x, float(x.count("A") > len(x) / 3) if rng.random() < 0.85 else float(rng.random() < 0.5), rng.choice([0.5, 1.0, 2.0])))
    return out


def dense(rows, sp, sc, n, normalized):
    xs = [r[1] for r in rows]
    own = [k(x, x, sp, sc, n) or 1.0 for x in xs]
    return np.array([[k(a, b, sp, sc, n) / (math.sqrt(p * q) if normalized else 1.0) for b, q in zip(xs, own)] for a, p in zip(xs, own)])


@pytest.mark.parametrize("loss,normalized,center,most", [("hinge", True, False, 1000), ("squared", False, True, 1000), ("squared", True, False, 0)])
def test_gap_to_the_dual(spark, desc, monkeypatch, loss, normalized, center, most):
    """The fit's value is that of the dual problem at its own coefficients: no other fit has a lower one."""
    monkeypatch.setattr(svm, "MOST_DENSE", most)
    rows = strings(60, (3, 6), 1)
    df = spark.createDataFrame(rows, "id long, seq string, y double, s double").repartition(3)
    C, p = 0.7, KernelParams(1.3, 0.9, 2, normalized)
    model = svm.fit_svm(df, desc, p, C, sample_weight="s", center=center, loss=loss)
    K = dense(rows, 1.3, 0.9, 2, normalized)
    if center:
        means = K.mean(axis=0)
        K = (K - means[:, None] - means[None, :] + K.mean()) / (np.mean(np.diag(K)) - K.mean())
    got = {r.id: r.prediction for r in learn.predict_ridge(model, df).collect()}
    f, y, s = np.array([got[r[0]] for r in rows]), np.array([2 * r[2] - 1 for r in rows]), np.array([r[3] for r in rows])
    coef = {r.id: r.coef for r in svm.svm_coefficients(model, df, loss, "s").collect()}
    c = np.array([coef[r[0]] for r in rows])
    assert abs(c.sum()) < 1e-5 and np.ptp(f - K @ c) < 1e-5  # f = K c + b
    a, gap = c * y, np.maximum(0, 1 - y * f)
    primal = c @ K @ c / 2 + C * (s * (gap if loss == "hinge" else gap**2)).sum()
    dual = a.sum() - c @ K @ c / 2 - (0 if loss == "hinge" else (a**2 / (4 * C * s)).sum())
    assert (a > -1e-9).all() and (loss == "squared" or (a <= C * s + 1e-9).all())
    assert 0 <= primal - dual + 1e-6 <= (0.0025 * C * s.sum() * 2 if loss == "hinge" else 1e-5) + 1e-6
    labels = {r.id: r.label for r in svm.predict_svm(model, df).collect()}
    assert all(labels[r[0]] == float(v > 0) for r, v in zip(rows, f))


def test_more_strings_and_features_than_fit_together(spark):
    """3200 strings of 15 letters over 12: more than 1700 features, by products alone."""
    rng = np.random.default_rng(2)
    letters = "ABCDEFGHIJKL"
    desc = spark.createDataFrame([(c, i, rng.standard_normal(4).tolist()) for i, c in enumerate(letters)], "letter string, letter_idx int, descriptors array<double>")
    rows = strings(3200, (15, 15), 3, letters)
    rows = [(i, x, float(x.count("A") + x.count("B") > 2), s) for i, x, _, s in rows]
    df = spark.createDataFrame(rows, "id long, seq string, y double, s double")
    model = svm.fit_svm(df, desc, KernelParams(1.0, 0.4, 2, True), 10.0, loss="squared")
    assert len(model.features) > 1700
    got = {r.id: r.label for r in svm.predict_svm(model, df).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.97


def test_classes(spark, desc):
    rows = [(0, "AAAA", 0.0), (1, "AABA", 0.0), (2, "CCCC", 1.0), (3, "CCBC", 1.0), (4, "BBBB", 2.0), (5, "BBBA", 2.0), (6, "", 0.0), (7, "ACB", None)]
    df = spark.createDataFrame(rows, "id long, seq string, y double")
    model = svm.fit_svm(df, desc, KernelParams(1.0, 0.5, 2), 10.0)
    got = {r.id: r.label for r in svm.predict_svm(model, df.where("id < 6")).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0}
    for bad in ({"loss": "other"}, {"C": 0.0}):
        with pytest.raises(ValueError):
            svm.fit_svm(df, desc, KernelParams(1.0, 0.5, 2), **bad)
    with pytest.raises(ValueError, match="two classes"):
        svm.fit_svm(df.where("y = 1"), desc, KernelParams(1.0, 0.5, 2))
