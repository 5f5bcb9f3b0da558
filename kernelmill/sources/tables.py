"""Readers and writers: labelled strings, letter descriptors, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, y) of a tab-separated file without header; id orders rows as read, and is stable for the same files."""
    rows = spark.read.schema("seq string, y double").csv(path, sep="\t", quote="")
    return rows.select(F.monotonically_increasing_id().alias("id"), "seq", "y")


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(letter, letter_idx, descriptors) of a file of blank-separated columns; letters are numbered in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parts = lines.where(F.trim("value") != "").select("line", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("p"))
    found = parts.select(
        F.element_at("p", 1).alias("letter"),
        "line",
        F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("descriptors"),
    ).collect()  # an alphabet: a few dozen rows
    rows = [(r["letter"], i, r["descriptors"]) for i, r in enumerate(sorted(found, key=lambda r: r["line"]))]
    return spark.createDataFrame(rows, "letter string, letter_idx int, descriptors array<double>")


def normalize_descriptors(descriptors: DataFrame, normalize: bool = True) -> DataFrame:
    """Each letter's descriptors divided by their Euclidean norm; a single descriptor is left as it is, else all would become 1 or -1."""
    if not normalize:
        return descriptors
    norm = F.sqrt(F.aggregate("descriptors", F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.transform("descriptors", lambda x: x / norm)
    return descriptors.withColumn("descriptors", F.when(F.size("descriptors") > 1, scaled).otherwise(F.col("descriptors")))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """df as Parquet, in folders by the given columns."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
