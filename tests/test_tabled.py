"""Ridge fits whose coefficients are tables."""

import itertools
import math

import numpy as np
import pytest

from kernelmill.operators import learn, tabled
from kernelmill.params import KernelParams

LETTERS = [("A", 0, [0.2, -1.1, 0.7]), ("C", 1, [1.3, 0.4, -0.6]), ("B", 2, [-0.8, 0.9, 0.3])]


@pytest.fixture(scope="module")
def desc(spark):
    return spark.createDataFrame(LETTERS, "letter string, letter_idx int, descriptors array<double>")


def strings(spark, letters, n, least, most, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, "".join(rng.choice(list(letters), rng.integers(least, most + 1))), float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, seq string, y double, z double, s double").repartition(3)


@pytest.mark.parametrize("n,cells", [(1, 1), (2, 60), (3, 50), (3, 10**6)])
def test_smoothing_by_halves(spark, desc, monkeypatch, n, cells):
    monkeypatch.setattr(tabled, "BLOCK_CELLS", cells)
    vec = {c: np.array(v) for c, _, v in LETTERS}
    rng = np.random.default_rng(1)
    all_features = [(k, p, "".join(g)) for k in range(1, n + 1) for p in range(4) for g in itertools.product("ABC", repeat=k)]
    coefs = [(*f, float(rng.normal()), float(rng.normal())) for f in all_features if rng.random() < 0.3]
    asked = [f for f in all_features if rng.random() < 0.5]
    p = KernelParams(1.3, 0.9, n)
    got = tabled.smoothed(spark.createDataFrame(coefs, "n int, pos int, gram string, v0 double, v1 double"), spark.createDataFrame(asked, "n int, pos int, gram string"), tabled.alphabet_of(desc, p), p, ["v0", "v1"]).collect()
    assert sorted((r.n, r.pos, r.gram) for r in got) == sorted(asked)
    for r in got:
        want = np.zeros(2)
        for k, pos, gram, a, b in coefs:
            if k == r.n:
                m = math.exp(-((pos - r.pos) ** 2) / (2 * 1.3**2)) * math.prod(math.exp(-((vec[x] - vec[y]) ** 2).sum() / (2 * 0.9**2)) for x, y in zip(gram, r.gram))
                want += [m * a, m * b]
        assert [r.v0, r.v1] == pytest.approx(list(want))


@pytest.mark.parametrize("normalized,center,weight", [(False, False, "s"), (True, True, None), (False, True, "s")])
def test_fits_as_in_the_driver(spark, desc, monkeypatch, normalized, center, weight):
    """Equal strings, an empty one, new strings longer than any known: the same predictions and dual coefficients."""
    df = strings(spark, "ABC", 60, 0, 6)
    p, alpha = KernelParams(1.3, 0.9, 2, normalized), [0.5, 2.0]
    new = spark.createDataFrame([(100, "ABCABCAB"), (101, ""), (102, "BB")], "id long, seq string")
    wanted = learn.fit_ridge(df, desc, p, alpha, center, weight, ["y", "z"])
    monkeypatch.setattr(learn, "MOST_FEATURES", 10)
    if weight and center:  # frequent features in parts
        monkeypatch.setattr(tabled, "LEAST", 3)
        asked = tabled._asked(df, 2)
        assert 0 < asked.frequent.count() < asked.features.count() and asked.frequent.where("parts > 2").count()
    model = learn.fit_ridge(df, desc, p, alpha, center, weight, ["y", "z"])
    assert isinstance(model, tabled.TableModel) and model.steps <= 60
    for at in (df, new):
        want = {(r.id, r.target): r.prediction for r in learn.predict_ridge(wanted, at).collect()}
        assert {(r.id, r.target): r.prediction for r in learn.predict_ridge(model, at).collect()} == pytest.approx(want, abs=1e-6)
    grams = spark.createDataFrame([(1, 0, "A"), (2, 7, "CB")], "n int, pos int, gram string")
    want = {(r.gram, r.target): r.w for r in learn.model_weights(wanted, grams).collect()}
    assert {(r.gram, r.target): r.w for r in learn.model_weights(model, grams).collect()} == pytest.approx(want, abs=1e-6)


def test_limits(spark, desc, monkeypatch):
    df = strings(spark, "ABC", 8, 1, 4)
    with pytest.raises(ValueError, match="no rows"):
        tabled.fit_tabled(df.limit(0), desc, KernelParams(1.0, 1.0, 2))
    monkeypatch.setattr(tabled, "STEPS", 0)
    with pytest.raises(RuntimeError, match="settle"):
        tabled.fit_tabled(df, desc, KernelParams(1.0, 1.0, 2))
    monkeypatch.setattr(tabled, "MOST_CELLS", 5)
    with pytest.raises(ValueError, match="outgrow"):
        tabled.smoothed(spark.createDataFrame([(2, 0, "AB", 1.0)], "n int, pos int, gram string, v0 double"), spark.createDataFrame([(2, 0, "AB")], "n int, pos int, gram string"), tabled.alphabet_of(desc, KernelParams(1.0, 1.0, 2)), KernelParams(1.0, 1.0, 2), ["v0"])


def test_five_letters_over_twenty(spark):
    """Grams of five letters over twenty: 3.4 million a place could occur. The residuals of (K + alpha) c = y, by the dense kernel of the strings."""
    names = "ACDEFGHIKLMNPQRSTVWY"
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(20, 4))
    desc = spark.createDataFrame([(c, i, v.tolist()) for i, (c, v) in enumerate(zip(names, vectors))], "letter string, letter_idx int, descriptors array<double>")
    df, p = strings(spark, names, 150, 6, 9), KernelParams(1.5, 1.0, 5, True)
    model = tabled.fit_tabled(df, desc, p, 1.0, landmarks=32)
    got = {r.id: r.prediction for r in tabled.predict_tabled(model, df).collect()}
    rows = df.collect()
    f = learn.observed_features(df, desc, 5)
    k, _ = learn._rows_kernel(rows, f, p)
    y = np.array([r.y for r in rows])
    want = k @ np.linalg.solve(k + np.eye(len(k)), y)
    assert [got[r.id] for r in rows] == pytest.approx(list(want), abs=1e-6)
    assert model.steps < 40
