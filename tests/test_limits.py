"""Tables that outgrow what the driver may hold are an error, never cut."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kernelmill import shared
from kernelmill.functions import grams
from kernelmill.operators import design, kernels, learn, report
from kernelmill.operators import weights as W


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([("A", 0, [1.0]), ("B", 1, [2.0]), ("C", 2, [3.0])], "letter string, letter_idx int, descriptors array<double>")


def test_at_most(spark):
    assert len(shared.at_most(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        shared.at_most(spark.range(3), 2, "rows")


def test_alphabets(letters, monkeypatch):
    for m in (grams, kernels):
        monkeypatch.setattr(m, "MOST_LETTERS", 2)
    with pytest.raises(ValueError, match="letters"):
        grams.letters_of(letters)
    with pytest.raises(ValueError, match="letters"):
        kernels.descriptor_matrix(letters)


def test_pivoted_columns(spark, monkeypatch):
    cv = spark.createDataFrame([(1, 1, "test", 1.0), (1, 2, "test", 3.0), (2, None, "test", 5.0)], "a int, b int, phase string, score double")
    assert {r.a: (r["1"], r["2"], r["null"]) for r in report.score_heatmap(cv, "a", "b", "test").collect()} == {1: (1.0, 3.0, None), 2: (None, None, 5.0)}
    monkeypatch.setattr(report, "MOST_COLUMNS", 2)
    with pytest.raises(ValueError, match="values of b"):
        report.score_heatmap(cv, "a", "b", "test")


def test_features_of_a_model(spark, letters, monkeypatch):
    monkeypatch.setattr(learn, "MOST_FEATURES", 2)
    with pytest.raises(ValueError, match="features"):
        learn.observed_features(spark.createDataFrame([(0, "ABC")], "id long, seq string"), letters, 1)


def test_grams_of_over_a_hundred_lengths(spark):
    seq = "AB" * 60
    rows = [(0, n, 0, seq[:n], 1.0) for n in range(1, 121)]
    weights = spark.createDataFrame(rows, "model_id int, n int, pos int, gram string, w double")
    got = W.score_strings(weights, spark.createDataFrame([(7, seq)], "id long, seq string")).first()
    assert got.score == 120.0


def test_prefixes_of_many_lengths(spark):
    every = [a + b for a in "AB" for b in "AB"]
    weights = spark.createDataFrame([(0, p, g, float(g == "AB")) for p in range(7) for g in every], "model_id int, pos int, gram string, w double")
    prefixes = spark.createDataFrame([("AB" * 4)[:n] for n in range(2, 9)], "string").select(F.col("value").alias("prefix")).withColumn("prefix_id", F.length("prefix"))
    got = {r.prefix_id: r.score for r in design.complete_prefix(weights, prefixes, 8, 1).collect()}
    assert got == {n: 4.0 for n in range(2, 9)}


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)
