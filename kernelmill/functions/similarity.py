"""Similarities of letters and of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def letter_distance(descriptors: DataFrame) -> DataFrame:
    """(a, b, distance): squared Euclidean distance of all pairs of letters. An alphabet is a few dozen rows."""
    a = descriptors.select(F.col("letter").alias("a"), F.col("descriptors").alias("x"))
    b = descriptors.select(F.col("letter").alias("b"), F.col("descriptors").alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.crossJoin(b).select("a", "b", square.alias("distance"))


def letter_similarity(descriptors: DataFrame, sigma_c: float) -> DataFrame:
    """(a, b, sim) with sim = exp(-distance / (2 sigma_c^2))."""
    return letter_distance(descriptors).select("a", "b", F.exp(-F.col("distance") / (2 * sigma_c**2)).alias("sim"))


def position_weights(spark: SparkSession, index: int, max_len: int, sigma_p: float) -> DataFrame:
    """(j, weight): how much each of max_len positions counts for position index."""
    j = F.col("id")
    return spark.range(max_len).select(j.cast("int").alias("j"), F.exp(-F.pow(j - index, F.lit(2)) / (2 * sigma_p**2)).alias("weight"))


def position_similarity(spark: SparkSession, max_len: int, sigma_p: float) -> DataFrame:
    """(i, j, weight) with weight = exp(-(i-j)^2 / (2 sigma_p^2)) for all pairs of max_len positions."""
    i = spark.range(max_len).select(F.col("id").cast("int").alias("i"))
    j = spark.range(max_len).select(F.col("id").cast("int").alias("j"))
    return i.crossJoin(j).select("i", "j", F.exp(-F.pow(F.col("i") - F.col("j"), F.lit(2)) / (2 * sigma_p**2)).alias("weight"))
