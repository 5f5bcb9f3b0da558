"""The scores of a grid against those of fits of their own."""

import __spark_entry__


def test_fits_are_not_one_plan(spark):
    """Each fit's scores are two rows, taken before the next fit: the driver doesn't hold the plans of all of them."""
    df = __spark_entry__.queries()["grid_scores_of_fits"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("Join") == 1
    assert sorted((r.r2_gap, r.mse_gap) for r in df.collect()) == [(0.0, 0.0)] * 24
