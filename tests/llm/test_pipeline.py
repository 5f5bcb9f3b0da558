"""Queries and pipeline of the corpus operators on the given small tables."""

import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from kernelmill.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in df[cols].values.tolist())
    assert text(got) == text(want)


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language(spark, DATA).where("held_out").join(truth, "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows = docs.toPandas()
    assert 0 < len(rows) < first.count() and rows["doc_id"].is_unique
    n = rows["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert (rows["taken"] <= 2 * n).all() and (rows["size"] == n).all()
    by = rows.groupby("source", dropna=False)
    assert ((by["taken"].sum() - by["target"].first()).abs() <= 1).all()


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"
    say = "one two three four five six seven eight nine ten"
    rows = [(1, say, "en", None, 1, "x", 5), (1, say, "en", None, 1, "x", 5), (None, "other words stand here, " + say, None, "s", None, None, None), (3, None, "en", "s", 0, None, None), (4, "", None, None, None, None, None)]
    for k, table in enumerate(([], rows)):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            if name == "near_dedup":
                assert sorted((r.doc_id for r in docs.collect()), key=repr) == ([1, None] if table else [])
