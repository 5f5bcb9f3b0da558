"""A corpus pipeline of five stages over the table documents; each stage's rows are written as Parquet and read again.

Nulls: a null text has no letter and is rejected by the first stage; null ids, sources and languages are kept, null sources as one
site and one source. Repeated rows (equal id and text) are copies of each other, of which near-dedup keeps one. An empty table
gives an empty result in every stage. Of ties, the smallest id stays. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelmill.llm import decontam, langid, lines, mixing, nearsets, queries, util


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is rejected go."""
    model = langid.fit(docs, "text", "lang", F.col("doc_id"))
    return langid.identify(docs, model).where("not rejected").select("row.*")


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines on over a twentieth of a source's documents, five at least, go from the texts; null texts stay null."""
    found = lines.drop_boilerplate(docs, **queries.SITE_LINES)
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, that of the smallest id stays.

    Candidates are operator 2's links (SimHash, vantage-point trees) and those of MinHash bands; each is verified on the shingles.
    """
    return nearsets.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which a twentieth or more is benchmark text go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_benchmark(docs, bench).where(~decontam.is_contaminated()).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: the documents that the mix takes, with how many words and to which output shards. Its columns replace documents' of the same name."""
    mixed = mixing.mix(docs).where("taken > 0")
    new = ["size", "source_size", "target", "taken", "places"]
    own = [F.col("row").getField(x).alias(x) for x in docs.columns if x not in new]
    return mixed.select(*own, *new[:-1], F.to_json("places").alias("places"))


STAGES = [
    ("language", language),
    ("site_lines", site_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: Fingerprints of XXH64 and the language model are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = util.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
