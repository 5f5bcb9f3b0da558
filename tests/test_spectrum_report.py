"""Spectra, Euler strings and reports."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kernelmill.operators import report, spectrum
from kernelmill.operators.spectrum import _euler_string


@settings(max_examples=200, suppress_health_check=[HealthCheck.too_slow])
@given(st.text("ABC", min_size=3, max_size=30), st.integers(2, 3))
def test_a_string_with_the_spectrum_of_a_string(text, n):
    want = Counter(text[i : i + n] for i in range(len(text) - n + 1))
    seq = _euler_string(list(want), list(want.values()), True)
    assert Counter(seq[i : i + n] for i in range(len(seq) - n + 1)) == want


def test_spectra_without_a_path(spark):
    rows = spark.createDataFrame([(1, "AB", 2), (1, "CA", 1), (2, "AB", 0), (3, "AA", 3)], "target int, gram string, count long")
    got = {r.target: r.seq for r in spectrum.euler_strings(rows, merge=False).collect()}
    assert got == {1: "CAB", 2: "", 3: "AAAA"}
    merged = {r.target: r.seq for r in spectrum.euler_strings(rows, merge=True).collect()}
    assert merged[1] == "CABAB"


def test_rounding(spark):
    rows = [(1, "AB", 0.5), (1, "BA", 2.5), (1, "BB", -1.0), (2, "AB", 0.2), (2, "BA", 0.1), (3, "AA", 0.3), (3, "AB", 0.3), (3, "BB", None)]
    df = spark.createDataFrame(rows, "target int, gram string, w double")
    got = {(r.target, r.gram): r["count"] for r in spectrum.round_to_count(df, 3).collect()}
    # 1 needs two and has 0 + 2; 2 passes 0.51 and 1.51 with AB, 0.755 with BA; both weights of 3 pass their half at once
    assert got == {(1, "AB"): 0, (1, "BA"): 2, (1, "BB"): 0, (2, "AB"): 1, (2, "BA"): 1, (3, "AA"): 1, (3, "AB"): 1, (3, "BB"): 0}
    assert {(r.gram, r["count"]) for r in spectrum.round_to_count(df.where("target = 2"), 4).collect()} == {("AB", 2), ("BA", 1)}
    with pytest.raises(Exception, match="no positive weight"):
        spectrum.round_to_count(spark.createDataFrame([(1, "AB", -1.0)], "target int, gram string, w double"), 4).collect()


def test_thresholds_top_up(spark):
    rows = spark.createDataFrame([(1, "AA", 0.9), (1, "AB", 0.5), (1, "BA", 0.4), (1, "BB", 0.3)], "target int, gram string, w double")
    limits = spark.createDataFrame([("AA", 0.8), ("AB", 0.8), ("BA", 0.8), ("BB", 0.2)], "gram string, threshold double")
    got = {r.gram: r["count"] for r in spectrum.round_by_threshold(rows, limits, 3).collect()}
    assert got == {"AA": 1, "AB": 1, "BA": 0, "BB": 1}


def test_histogram_and_density_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=300)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("one", 1.0)], "g string, v double")
    rows = report.histogram(df, "g", "v", 10).where("g = 'g'").orderBy("bin").collect()
    want, edges = np.histogram(x, 10, density=True)
    assert [r.density for r in rows] == pytest.approx(list(want)) and [r.low for r in rows] == pytest.approx(list(edges[:-1]))
    assert report.histogram(df, "g", "v", 10).where("g = 'one'").count() == 10
    h = x.std(ddof=1) * 300 ** -0.2
    at = np.array([r.x for r in report.kde(df, "g", "v", 20).orderBy("point").collect()])
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (300 * h * math.sqrt(2 * math.pi))
    assert at[0] == pytest.approx(x.min() - np.ptp(x) / 2) and at[-1] == pytest.approx(x.max() + np.ptp(x) / 2)
    for error in (1e-9, 0.01, 0.2):  # each value for itself; binned to nodes, by linear shares
        got = [r.density for r in report.kde(df, "g", "v", 20, error).orderBy("point").collect()]
        assert np.abs(np.array(got) - want).max() <= (error if error > 1e-9 else 1e-12) / h
    assert report.kde(df, "g", "v", 20).where("g = 'one'").count() == 0


@pytest.mark.parametrize("few,buckets", [(10, 4), (1, 2), (10_000, 1024)])
def test_quantiles_by_selection(spark, monkeypatch, few, buckets):
    """Ranks narrowed down by ranges give what sorting gives: with copies, skewed values, few values and none."""
    for name, value in (("MOST_VALUES", 0), ("FEW", few), ("BUCKETS", buckets)):
        monkeypatch.setattr(report, name, value)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=200), "b": np.exp(rng.normal(size=150) * 4), "c": np.r_[np.full(120, 3.5), rng.normal(size=40)], "d": np.array([2.0]), "e": np.array([1.0, -4.0])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("a", None), (None, 1.0), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r.g, r.share): r.q for r in report.quantiles(df, "g", "v", shares).collect()}
    assert set(got) == {(g, p) for g in groups for p in shares}
    assert all(got[g, p] == pytest.approx(np.quantile(own, p)) for g, own in groups.items() for p in shares)
    boxes = {r.g: r for r in report.box_summary(df, "g", "v").collect()}
    monkeypatch.setattr(report, "MOST_VALUES", 10**6)
    assert boxes["b"] == {r.g: r for r in report.box_summary(df, "g", "v").collect()}["b"]


def test_profile(spark):
    rows = spark.createDataFrame([(0, "AB"), (1, "AC"), (2, "AB"), (3, "A")], "id long, seq string")
    got = {(r.pos, r.letter): r for r in report.motif_profile(rows, letters=4).collect()}
    assert got[0, "A"].bits == pytest.approx(2.0) and got[1, "B"].frequency == pytest.approx(2 / 3)
