"""Kernels, ridge models, weights and designs against plain formulas on small alphabets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelmill.functions import grams as G
from kernelmill.operators import _blocks, design, kernels, learn
from kernelmill.operators import weights as W
from kernelmill.params import KernelParams
from kernelmill.sources.tables import normalize_descriptors, read_descriptors, read_labelled, write_table

LETTERS = [("A", 0, [0.2, -1.1, 0.7]), ("C", 1, [1.3, 0.4, -0.6]), ("B", 2, [-0.8, 0.9, 0.3])]
VEC = {c: np.array(v) for c, _, v in LETTERS}
# Rows A, S and W of the BLOSUM62 scores, columns in the order A R N D C Q E G H I L K M F P S T W Y V.
BLOSUM = {
    "A": [4, -1, -2, -2, 0, -1, -1, 0, -2, -1, -1, -1, -1, -2, -1, 1, 0, -3, -2, 0],
    "S": [1, -1, 1, 0, -1, 0, 0, 0, -1, -2, -2, 0, -1, -2, -1, 4, 1, -3, -2, -2],
    "W": [-3, -3, -4, -4, -2, -2, -3, -2, -2, -3, -2, -3, -1, 1, -4, -3, -2, 11, 2, -3],
}


def k(x, z, sp, sc, n, vec=VEC, exact=False, min_n=1):
    total = 0.0
    for i in range(len(x)):
        for j in range(len(z)):
            prod = 1.0
            for t in range(min(n, len(x) - i, len(z) - j)):
                a, b = x[i + t], z[j + t]
                prod *= float(a == b) if exact else math.exp(-((vec[a] - vec[b]) ** 2).sum() / (2 * sc**2))
                if t + 1 >= min_n:
                    total += math.exp(-((i - j) ** 2) / (2 * sp**2)) * prod
    return total


@pytest.fixture(scope="module")
def desc(spark):
    return spark.createDataFrame(LETTERS, "letter string, letter_idx int, descriptors array<double>")


SEQS = ["ABC", "A", "CCBA", "BABAB", "ABC", "CB"]
YS = [1.0, -2.0, 0.5, 3.0, 1.5, 0.0]


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame(list(zip(range(6), SEQS, YS, [1.0, 2.0, 0.5, 1.0, 1.0, 3.0])), "id long, seq string, y double, s double")


@pytest.mark.parametrize("n,normalized,block", [(2, True, 4), (3, False, 100)])
def test_gram(strings, desc, n, normalized, block):
    p = KernelParams(1.3, 0.9, n, normalized)
    for right in (None, strings):
        got = {(r.id_a, r.id_b): r.k for r in kernels.gs_gram(strings, desc, p, right, block).collect()}
        assert len(got) == 36
        for i, x in enumerate(SEQS):
            for j, z in enumerate(SEQS):
                want = k(x, z, 1.3, 0.9, n)
                if normalized:
                    want /= math.sqrt(k(x, x, 1.3, 0.9, n) * k(z, z, 1.3, 0.9, n))
                assert got[i, j] == pytest.approx(want, abs=1e-12)


def test_exact_kernel(strings):
    got = {(r.id_a, r.id_b): r.k for r in kernels.exact_gram(strings, strings, 1.3, 2, 3).collect()}
    for i, x in enumerate(SEQS):
        for j, z in enumerate(SEQS):
            assert got.get((i, j), 0.0) == pytest.approx(k(x, z, 1.3, 0, 3, exact=True, min_n=2), abs=1e-12)
    own = {r.id: r.k for r in kernels.exact_self(strings, 1.3, 1, 2).collect()}
    assert own[3] == pytest.approx(k(SEQS[3], SEQS[3], 1.3, 0, 2, exact=True))


def test_neighbors_agree_with_the_full_table(strings, desc):
    p = KernelParams(1.3, 0.9, 2, True)
    full = sorted(((r.id_a, -r.k, r.id_b) for r in kernels.gs_gram(strings, desc, p).collect()))
    got = sorted((r.id_a, -r.k, r.id_b) for r in kernels.neighbors(strings, strings, desc, p, k=2, block=2).collect())
    for a in range(6):
        best = [x[1] for x in full if x[0] == a][:2]
        assert [x[1] for x in got if x[0] == a] == pytest.approx(best)
    with pytest.raises(ValueError):
        kernels.neighbors(strings, strings, desc, p)


def dense(p, center, weights, alpha, y):
    K = np.array([[k(a, b, p.sigma_p, p.sigma_c, p.n) for b in SEQS] for a in SEQS])
    if p.normalized:
        d = np.sqrt(np.diag(K))
        K = K / np.outer(d, d)
    mean = 0.0
    if center:
        var = np.mean(np.diag(K)) - K.mean()
        K = (K - K.mean(1)[:, None] - K.mean(0)[None, :] + K.mean()) / var
        mean = np.mean(y)
    s = np.sqrt(np.array(weights))
    c = s * np.linalg.solve(K * np.outer(s, s) + alpha * np.eye(len(K)), s * (np.array(y) - mean))
    return K @ c + mean, c


@pytest.mark.parametrize("normalized,center,weighted", [(False, False, False), (True, False, True), (False, True, True), (True, True, False)])
def test_ridge_equals_the_dense_solution(strings, desc, normalized, center, weighted):
    p = KernelParams(1.3, 0.9, 2, normalized)
    model = learn.fit_ridge(strings, desc, p, 0.7, center, "s" if weighted else None)
    got = {r.id: r.prediction for r in learn.predict_ridge(model, strings).collect()}
    want, dual = dense(p, center, [1.0, 2.0, 0.5, 1.0, 1.0, 3.0] if weighted else [1.0] * 6, 0.7, YS)
    assert [got[i] for i in range(6)] == pytest.approx(list(want), abs=1e-9)
    if not center:
        coef = {r.id: r.coef for r in learn.dual_coefficients(model, strings, "s" if weighted else None).collect()}
        assert [coef[i] for i in range(6)] == pytest.approx(list(dual), abs=1e-8)


def test_known_values_of_the_smoke_fixture(spark):
    desc = normalize_descriptors(spark.createDataFrame([(c, i, [float(x) for x in v]) for i, (c, v) in enumerate(BLOSUM.items())], "letter string, letter_idx int, descriptors array<double>"))
    train = spark.createDataFrame([(0, "AAAAA", 1.2), (1, "WSWSW", 40.0), (2, "SWSWS", 54.0)], "id long, seq string, y double")
    test = spark.createDataFrame([(9, "AWWSA")], "id long, seq string")
    for normalized, dual, value in ((False, [-13.495285, -0.334890, 15.670795], 31.820506), (True, [-20.578769, 15.125496, 29.319485], 24.090968)):
        model = learn.fit_ridge(train, desc, KernelParams(3.0, 3.0, 1, normalized), 1.0)
        coef = {r.id: r.coef for r in learn.dual_coefficients(model, train).collect()}
        assert [coef[i] for i in range(3)] == pytest.approx(dual, abs=2e-5)
        assert learn.predict_ridge(model, test).first().prediction == pytest.approx(value, abs=2e-5)


def all_strings(n):
    return ["".join(x) for x in itertools.product("ABC", repeat=n)]


def test_weights_score_like_the_model(spark, strings, desc):
    p = KernelParams(1.3, 0.9, 2)
    train = strings.withColumnRenamed("y", "coef")
    w = W.gram_weights(train, desc, p, 3, True)
    every = spark.createDataFrame(list(enumerate(all_strings(3))), "id long, seq string")
    got = {r.id: r.score for r in W.score_strings(w, every).collect()}
    for i, x in enumerate(all_strings(3)):
        assert got[i] == pytest.approx(sum(c * k(z, x, 1.3, 0.9, 2) for c, z in zip(YS, SEQS)), abs=1e-9)


@pytest.mark.parametrize("shift", [0.0, -50.0])
def test_designs_equal_full_enumeration(spark, strings, desc, shift):
    p = KernelParams(1.3, 0.9, 2)
    train = strings.select("id", "seq", (F.col("y") + shift).alias("coef"))
    w = W.gram_weights(train, desc, p, 3, True).cache()
    value = {x: sum((c + shift) * k(z, x, 1.3, 0.9, 2) for c, z in zip(YS, SEQS)) for x in all_strings(3)}
    plain = sorted(value.values(), reverse=True)[:7]
    assert [r.score for r in design.k_best_strings(w, 3, 7).orderBy("rank").collect()] == pytest.approx(plain)
    norm = sorted((v / math.sqrt(k(x, x, 1.3, 0.9, 2)) for x, v in value.items()), reverse=True)[:5]
    got = design.k_best_normalized(w, desc, p, 3, 5).orderBy("rank").collect()
    assert [r.score for r in got] == pytest.approx(norm) and got[0].is_exact
    best = min((k(x, x, 1.3, 0, 2, exact=True) - 2 * v, x) for x, v in value.items())
    assert design.best_distance({3: w}, desc, p).first().distance == pytest.approx(best[0])


def test_normalized_designs_over_twenty_letters(spark):
    """Grams of five letters over twenty: bounds are joins, so no table of all 3.2 million grams is needed. Against all strings that the grams allow."""
    rng, letters, size, p = random.Random(4), "ACDEFGHIKLMNPQRSTVWY", 8, KernelParams(1.1, 0.8, 5)
    vec = {c: np.array([rng.gauss(0, 1) for _ in range(3)]) for c in letters}
    desc = spark.createDataFrame([(c, i, v.tolist()) for i, (c, v) in enumerate(vec.items())], "letter string, letter_idx int, descriptors array<double>")
    base = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(40)]
    base += [x[:j] + rng.choice(letters) + x[j + 1 :] for x in base for j in (1, 6)]
    w = {(i, x[i : i + 5]): rng.gauss(0.3, 1.0) for x in base for i in range(size - 4)}
    whole = {g: v for (i, g), v in w.items() if i == 0}
    for i in range(1, size - 4):
        whole = {x + g[-1]: v + w[i, g] for x, v in whole.items() for (j, g) in w if j == i and g[:-1] == x[-4:]}
    table = spark.createDataFrame([(0, i, g, v) for (i, g), v in w.items()], "model_id int, pos int, gram string, w double")
    want = sorted(((v / math.sqrt(k(x, x, 1.1, 0.8, 5, vec)), x) for x, v in whole.items()), reverse=True)[:6]
    got = design.k_best_normalized(table, desc, p, size, 6).orderBy("rank").collect()
    assert [r.seq for r in got] == [x for _, x in want] and [r.score for r in got] == pytest.approx([v for v, _ in want]) and got[0].is_exact


def test_bounds_hold(desc):
    """No string that ends as given has a kernel with itself outside the bounds."""
    vectors = np.array([v for _, _, v in LETTERS])
    for kernel, min_n in (("gs", 1), ("exact", 1), ("exact", 2)):
        b = design._Norms(list("ACB"), vectors, KernelParams(1.3, 0.9, 3), kernel, min_n, "normalized", 5)
        for end in ("B", "AB", "CABA"):
            codes = np.array([[3] * (5 - len(end)) + ["ACB".index(c) for c in end]])
            low, high = b.norm(codes, b.least)[0], b.norm(codes, b.most)[0]
            own = [k(x, x, 1.3, 0.9, 3, exact=kernel == "exact", min_n=min_n) for x in all_strings(5) if x.endswith(end)]
            assert low <= min(own) + 1e-9 and max(own) <= high + 1e-9


def test_design_limits(spark, strings, desc):
    w = W.gram_weights(strings.withColumnRenamed("y", "coef"), desc, KernelParams(1.3, 0.9, 2), 3, True).cache()
    assert design.k_best_strings(w, 3, 27).count() == 27
    with pytest.raises(ValueError):
        design.k_best_strings(w, 3, 28)
    with pytest.raises(ValueError):
        W.gram_weights(strings.withColumnRenamed("y", "coef"), desc, KernelParams(1.3, 0.9, 2), 1)


def test_folds_grid_and_nested_search(strings, desc, spark):
    folds = learn.kfold(strings, 4, "id")
    assert [r.fold for r in folds.orderBy("id").collect()] == [0, 0, 1, 1, 2, 3]
    grid = learn.param_grid(spark, {"sigma_p": [1.3], "sigma_c": [0.9], "n": [1, 2], "alpha": [0.7]})
    cv = learn.grid_search(folds, desc, grid, normalized=False)
    assert cv.count() == 2 * 4 * 2
    r = cv.where("phase = 'train' and fold = 0 and n = 2").first()
    rest = folds.where("fold <> 0")
    model = learn.fit_ridge(rest, desc, KernelParams(1.3, 0.9, 2), 0.7)
    scored = learn.predict_ridge(model, rest).join(rest, "id")
    want = learn.regression_metrics(scored).first()
    assert (r.r2, r.mse) == pytest.approx((want.r2, want.mse))
    rows, chosen = learn.nested_cv(strings, desc, {"sigma_p": [1.3], "sigma_c": [0.9], "n": [1], "alpha": [0.7, 7.0]}, 3, 2, normalized=False)
    assert rows.count() == 6 and chosen.count() == 3


@pytest.mark.parametrize("rows", [3000, 0])
def test_fits_of_many_features(spark, monkeypatch, rows):
    """600 random peptides have more features than are summed in pairs: solved by rows, and by passes over the strings."""
    monkeypatch.setattr(learn, "MOST_ROWS", rows)
    rng = np.random.default_rng(7)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    vec = {c: rng.normal(size=3) for c in letters}
    table = spark.createDataFrame([(c, i, v.tolist()) for i, (c, v) in enumerate(vec.items())], "letter string, letter_idx int, descriptors array<double>")
    seqs = ["".join(rng.choice(list(letters), 15)) for _ in range(600 if rows else 150)]
    if not rows:
        monkeypatch.setattr(learn, "MOST_DENSE", 500)
    y, s = rng.normal(size=len(seqs)), rng.uniform(0.5, 2, len(seqs))
    df = spark.createDataFrame([(i, x, float(a), float(b)) for i, (x, a, b) in enumerate(zip(seqs, y, s))], "id long, seq string, y double, s double")
    p, alpha = KernelParams(2.0, 1.0, 2, True), 0.5 if rows else 30.0
    codes = np.array([[letters.index(c) for c in x] for x in seqs])
    sim = _blocks.letter_matrix(np.array(list(vec.values())), 1.0)
    K = _blocks.pair_kernel(codes, codes, sim, 2.0, 2)
    K = K / np.sqrt(np.outer(np.diag(K), np.diag(K)))
    K = (K - K.mean(1)[:, None] - K.mean(0)[None, :] + K.mean()) / (np.mean(np.diag(K)) - K.mean())
    r = np.sqrt(s)
    want = K @ (r * np.linalg.solve(K * np.outer(r, r) + alpha * np.eye(len(K)), r * (y - y.mean()))) + y.mean()
    model = learn.fit_ridge(df, table, p, alpha, center=True, sample_weight="s")
    assert len(model.features) > learn.MOST_DENSE
    got = {r.id: r.prediction for r in learn.predict_ridge(model, df).collect()}
    assert [got[i] for i in range(len(seqs))] == pytest.approx(list(want), abs=1e-7)
    if rows:
        monkeypatch.setattr(learn, "MOST_CELLS", 0)  # no table of all weights: they are made for the grams that occur
        again = {r.id: r.prediction for r in learn.predict_ridge(model, df.limit(20)).collect()}
        assert [again[i] for i in again] == pytest.approx([got[i] for i in again])


@pytest.mark.parametrize("normalized,center", [(True, False), (False, True)])
def test_grid_of_many_features_equals_the_sums(spark, strings, desc, monkeypatch, normalized, center):
    folds = learn.kfold(strings, 3, "id")
    values = {"sigma_p": [1.3, 0.4], "sigma_c": [0.9], "n": [1, 2], "alpha": [3.0, 0.7, 20.0]}
    grid = learn.random_search(spark, values, 7, seed=1)
    ids = [r.param_id for r in grid.collect()]
    assert len(ids) == 7 and set(ids) == {r.param_id for r in learn.random_search(spark, values, 7, seed=1).collect()}
    key = lambda df: sorted((r.param_id, r.fold, r.phase, r.alpha, r.rows, round(r.r2, 6), round(r.mse, 6)) for r in df.collect())
    want = key(learn.grid_search(folds, desc, grid, normalized, center))
    monkeypatch.setattr(learn, "MOST_DENSE", 0)
    assert key(learn.grid_search(folds, desc, grid, normalized, center)) == want


def dense_ridge(train, test, sp, sc, n, alpha):
    """Predictions for the strings of test of a fit on (seq, y) of train."""
    K = np.array([[k(a, b, sp, sc, n) for b, _ in train] for a, _ in train])
    c = np.linalg.solve(K + alpha * np.eye(len(K)), np.array([y for _, y in train]))
    return np.array([sum(v * k(a, b, sp, sc, n) for v, (b, _) in zip(c, train)) for a, _ in test])


@pytest.mark.parametrize("most", [1000, 0])
def test_nested_search_equals_dense_fits(spark, desc, monkeypatch, most):
    """Each fold's best set, its score and the predictions out of fold, by dense ridge alone."""
    monkeypatch.setattr(learn, "MOST_DENSE", most)
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ABC"), rng.integers(2, 5))), float(rng.standard_normal())) for i in range(13)]
    rows = [(i, x, y + x.count("A")) for i, x, y in rows]
    values = {"sigma_p": [0.5, 2.0], "sigma_c": [0.9], "n": [2], "alpha": [0.3, 3.0]}
    sets = list(itertools.product(*values.values()))
    parts = lambda t, k: [list(x) for x in np.array_split(np.array(t, object), k)]
    got, chosen = learn.nested_cv(spark.createDataFrame(rows, "id long, seq string, y double").repartition(2), desc, values, 3, 2, normalized=False)
    got, chosen = {r.id: (r.fold, r.prediction) for r in got.collect()}, {r.fold: (r.param_id, r.score) for r in chosen.collect()}
    pair = lambda t: [(r[1], r[2]) for r in t]
    for fold, test in enumerate(parts(rows, 3)):
        train = [r for r in rows if r[0] not in {x[0] for x in test}]
        scores = []
        for sp, sc, n, alpha in sets:
            r2 = []
            for own in parts(train, 2):
                rest = [r for r in train if r[0] not in {x[0] for x in own}]
                y, f = np.array([r[2] for r in own]), dense_ridge(pair(rest), pair(own), sp, sc, n, alpha)
                r2.append(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())
            scores.append(np.mean(r2))
        best = int(np.argmax(scores))
        assert chosen[fold] == (best, pytest.approx(scores[best]))
        sp, sc, n, alpha = sets[best]
        assert [got[r[0]][1] for r in test] == pytest.approx(dense_ridge(pair(train), pair(test), sp, sc, n, alpha).tolist())
        assert {got[r[0]][0] for r in test} == {fold}


def test_sparse_roll_up(spark):
    """Asked grams over twenty letters with n = 6 (64 million in all), and all grams of a small alphabet, against sums over prefixes."""
    rng = np.random.default_rng(6)
    for letters, n, length, grams in (("ACDEFGHIKLMNPQRSTVWY", 6, 9, 60), ("ABC", 3, 5, 20)):
        word = lambda m: "".join(rng.choice(list(letters), m))
        base = [word(n) for _ in range(grams)]
        own = {(k, p, b[:k]): float(rng.standard_normal()) for b in base for k in range(1, n + 1) for p in range(length - k + 1) if rng.random() < 0.4}
        w = spark.createDataFrame([(0, k, p, g, v) for (k, p, g), v in own.items()], "model_id int, n int, pos int, gram string, w double")
        asked = base + [b[: n - 2] + word(2) for b in base] + [word(n) for _ in range(20)] if n == 6 else ["".join(x) for x in itertools.product(letters, repeat=n)]
        table = spark.createDataFrame([(g,) for g in asked], "gram string") if n == 6 else None
        alphabet = spark.createDataFrame([(c, i) for i, c in enumerate(letters)], "letter string, letter_idx int")
        got = {(r.pos, r.gram): r.w for r in W.rollup_weights(w, 1, n, length, alphabet, table).collect()}
        want = {(p, g): sum(own.get((k, p, g[:k]), 0.0) for k in range(1, n + 1)) for g in set(asked) for p in range(length - n + 1)}
        assert got == pytest.approx(want)
        ends = {r.gram: r.w for r in W.end_weights(w, 1, n, length, alphabet, table).collect()}
        assert ends == pytest.approx({g: sum(own.get((k, length - n + 1 + i, g[i + 1 : i + 1 + k]), 0.0) for k in range(1, n + 1) for i in range(n - k)) for g in set(asked)})
    with pytest.raises(ValueError, match="at most"):
        W.end_weights(w, 1, 14, 20, alphabet)


def test_letters_outside_the_alphabet(spark, desc):
    s = spark.createDataFrame([(0, "AB"), (1, "AX"), (2, None), (3, "")], "id long, seq string")
    good, bad = G.split_valid(s, desc)
    assert {r.id for r in good.collect()} == {0, 3} and {r.id for r in bad.collect()} == {1, 2}
    assert G.encode(s, desc, "drop").count() == 2
    with pytest.raises(Exception, match="letter outside"):
        G.encode(s, desc).collect()


def test_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("A  1.0 2.0\t\nC\t3 4\n\nB 0 -1  \n")
    got = read_descriptors(spark, str(tmp_path / "d.txt")).orderBy("letter_idx").collect()
    assert [(r.letter, r.descriptors) for r in got] == [("A", [1.0, 2.0]), ("C", [3.0, 4.0]), ("B", [0.0, -1.0])]
    (tmp_path / "x.tsv").write_text("ABC\t1.5\nCA\t-2\n")
    rows = read_labelled(spark, str(tmp_path / "x.tsv"))
    assert [(r.seq, r.y) for r in rows.orderBy("id").collect()] == [("ABC", 1.5), ("CA", -2.0)]
    write_table(rows, str(tmp_path / "out"), ["seq"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
