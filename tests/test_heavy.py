"""Fits of tables with very many rows, as rows of great weight stand for them: what is left of their equations is what doubles leave."""

import numpy as np
import pytest

from kernelmill.operators import learn, svm
from kernelmill.params import KernelParams
from tests.test_tabled import LETTERS, strings


@pytest.fixture(scope="module")
def desc(spark):
    return spark.createDataFrame(LETTERS, "letter string, letter_idx int, descriptors array<double>")


@pytest.mark.parametrize("center", [False, True])
def test_equations_of_heavy_rows(spark, desc, center):
    """(K + alpha / s) c = y, and of a centred kernel (C + alpha / s) c = y - mean: duals amplify the errors of a fit by the weights."""
    df, p = strings(spark, "ABC", 200, 1, 8).selectExpr("id", "seq", "y", "2e4 * s AS s"), KernelParams(1.5, 1.2, 2)
    model = learn.fit_ridge(df, desc, p, 1.0, center, "s")
    coef = {r.id: r.coef for r in learn.dual_coefficients(model, df, "s").collect()}
    rows = df.collect()
    c, y, s = (np.array(v) for v in ([coef[r.id] for r in rows], [r.y for r in rows], [r.s for r in rows]))
    K, _ = learn._rows_kernel(rows, learn.observed_features(df, desc, 2), p)
    if center:
        means = K.mean(axis=0)
        K, y = (K - means[:, None] - means[None, :] + K.mean()) / (np.mean(np.diag(K)) - K.mean()), y - y.mean()
    assert np.abs(K @ c + c / s - y).max() < 5e-6


def test_nested_predictions_of_a_small_alpha(spark, desc):
    """Predictions out of fold are kernel sums with the duals of the chosen set's fit on the other folds. A small alpha weighs rows as many copies do."""
    df, p = strings(spark, "ABC", 150, 1, 8).select("id", "seq", "y"), KernelParams(1.5, 1.2, 2)
    got, _ = learn.nested_cv(df, desc, {"sigma_p": [1.5], "sigma_c": [1.2], "n": [2], "alpha": [5e-5]}, 3, 3, normalized=False)
    found = {r.id: (r.fold, r.prediction) for r in got.collect()}
    rows = df.collect()
    K, _ = learn._rows_kernel(rows, learn.observed_features(df, desc, 2), p)
    for fold in range(3):
        train = df.where(df.id.isin([i for i, (own, _) in found.items() if own != fold]))
        coef = {r.id: r.coef for r in learn.dual_coefficients(learn.fit_ridge(train, desc, p, 5e-5), train).collect()}
        sums = K @ np.array([coef.get(r.id, 0.0) for r in rows])
        assert max(abs(found[r.id][1] - v) for r, v in zip(rows, sums) if found[r.id][0] == fold) < 5e-6


@pytest.mark.parametrize("normalized,C,weight", [(True, 1.0, 5e2), (False, 0.01, 5e3)])
def test_vectors_of_heavy_rows(spark, desc, normalized, C, weight):
    """The conditions of the least penalty, f - b = K c and sum c = 0, where strings weigh what thousands of copies do."""
    df, p = strings(spark, "ABC", 300, 1, 6).selectExpr("id", "seq", "double(z > 0 OR seq LIKE '%AB%') AS y", f"{weight} * s AS s"), KernelParams(1.5, 1.2, 2, normalized)
    model = svm.fit_svm(df, desc, p, C, sample_weight="s")
    got = {r.id: r.prediction for r in learn.predict_ridge(model, df).collect()}
    coef = {r.id: r.coef for r in svm.svm_coefficients(model, df, sample_weight="s").collect()}
    rows = df.collect()
    K, _ = learn._rows_kernel(rows, learn.observed_features(df, desc, 2), p)
    c, f = np.array([coef[r.id] for r in rows]), np.array([got[r.id] for r in rows])
    assert abs(c.sum()) < 5e-6 and np.abs(f - model.intercept[0] - K @ c).max() < 5e-6
