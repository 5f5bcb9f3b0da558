"""The driver's contract: the registered queries agree with their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from kernelmill.plans import queries as own

DATA = "/root/testdata/sf0.001"
FEW = ["screen_top20", "counted_grams", "exact_kernel", "normalized_kernel", "weights_with_last_folded", "fifty_best_strings", "contiguous_folds", "spectra_by_threshold", "boxes_of_groups", "heatmaps_of_scores"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "part", "lineitem", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = own.QUERIES[name](spark, DATA).toPandas(), con.sql(own.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_streamed_scores(spark, tmp_path):
    from kernelmill.operators.weights import score_strings
    from kernelmill.streaming.scoring import score_stream

    rows = [(1, "ABA", "2024-01-01 00:00:00"), (2, "BB", "2024-01-01 01:00:00"), (3, "AB", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id long, seq string, ts string").selectExpr("id", "seq", "cast(ts as timestamp) ts")
    df.write.parquet(str(tmp_path / "in"))
    w = spark.createDataFrame([(0, p, g, float(p + len(g) * ord(g[0]))) for p in range(3) for g in ("AB", "BA", "BB")], "model_id int, pos int, gram string, w double")
    stream = score_stream(w, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2)
    q = stream.writeStream.outputMode("append").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.id: r.score for r in spark.table("scores").collect()}
    want = {r.id: r.score for r in score_strings(w, df).collect()}
    assert got and all(want[i] == v for i, v in got.items())
