"""Ridge fits by tables of strings with many copies: a step writes each different string once, and the fit is that of all rows."""

import pytest
from pyspark.sql import functions as F

from kernelmill.operators import learn, tabled
from kernelmill.params import KernelParams
from tests.test_tabled import LETTERS, strings


@pytest.mark.parametrize("normalized,center,weight", [(False, False, "s"), (True, True, "s"), (False, True, None)])
def test_copies_are_one_row(spark, monkeypatch, normalized, center, weight):
    desc = spark.createDataFrame(LETTERS, "letter string, letter_idx int, descriptors array<double>")
    df = strings(spark, "ABC", 120, 0, 2).withColumn("s", F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("s"))).cache()
    p, written, write = KernelParams(1.3, 0.9, 2, normalized), {}, tabled.materialized
    monkeypatch.setattr(tabled, "materialized", lambda rows, name: (out := write(rows, name), written.update({name: out.count()}))[0])
    model = tabled.fit_tabled(df, desc, p, [0.5, 2.0], center, weight, ["y", "z"])
    assert written["tabled-rows"] == written["tabled-step"] == df.select("seq").distinct().count() < 20
    monkeypatch.setattr(tabled, "materialized", write)
    wanted = learn.fit_ridge(df, desc, p, [0.5, 2.0], center, weight, ["y", "z"])
    want = {(r.id, r.target): r.prediction for r in learn.predict_ridge(wanted, df).collect()}
    assert {(r.id, r.target): r.prediction for r in learn.predict_ridge(model, df).collect()} == pytest.approx(want, abs=1e-6)
