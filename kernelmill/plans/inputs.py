"""Strings, letters and models that the registered queries make from the given tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import normalize_descriptors

EVENT_LETTERS = [("C", 0, [0.2, -1.1, 0.7]), ("E", 1, [1.3, 0.4, -0.6]), ("P", 2, [-0.8, 0.9, 0.3]), ("S", 3, [0.5, 0.6, 1.4]), ("V", 4, [-1.2, -0.3, -0.9])]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_letters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_LETTERS, "letter string, letter_idx int, descriptors array<double>")


def event_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, y): each user's events of a day as a string of their first letters in time order; y sums their values."""
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    rows = e.groupBy("user_id", day.alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", F.upper(F.substring("event_type", 1, 1)).alias("c")))).alias("e"),
        F.sum("value").alias("y"),
    )
    return rows.select(
        (F.col("user_id") * 1000 + F.datediff("day", F.lit("2024-01-01"))).alias("id"),
        F.array_join(F.transform("e", lambda x: x["c"]), "").alias("seq"),
        "y",
    )


def part_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(letter, letter_idx, descriptors): letters of the part names, described by mean size, price and place of the parts that hold them."""
    p = read(spark, sf_dir, "part").select("p_size", "p_retailprice", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("seq"))
    rows = p.select("p_size", "p_retailprice", F.posexplode(F.split("seq", "")).alias("pos", "letter")).where("letter <> ''")
    means = rows.groupBy("letter").agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"), F.avg("pos").alias("c"))
    ranked = means.collect()  # an alphabet: 26 rows at most
    out = [(r["letter"], i, [r["a"] / 10, r["b"] / 500, r["c"]]) for i, r in enumerate(sorted(ranked, key=lambda r: r["letter"]))]
    return normalize_descriptors(spark.createDataFrame(out, "letter string, letter_idx int, descriptors array<double>"))


def label_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(letter, letter_idx, descriptors): each embedding label's mean vector."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("descriptors"))
    return rows.select(F.col("label").cast("string").alias("letter"), F.col("label").alias("letter_idx"), "descriptors")


_VALUES = ", ".join(f"('{c}', {i}, {v})" for c, i, v in EVENT_LETTERS)
EV = """ev AS (SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS id,
  string_agg(upper(event_type[1]), '' ORDER BY ts, event_id) AS seq, sum(value) AS y FROM events GROUP BY user_id, CAST(ts AS DATE))"""
LETTERS = f"letters(letter, letter_idx, d) AS (VALUES {_VALUES})"
PL = """pl0 AS (SELECT seq[i] AS letter, avg(p_size) / 10 AS a, avg(p_retailprice) / 500 AS b, avg(i - 1) AS c
  FROM (SELECT p_size, p_retailprice, seq, unnest(range(1, length(seq) + 1)) AS i FROM (SELECT p_size, p_retailprice, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS seq FROM part)) GROUP BY 1),
pl AS (SELECT letter, a / sqrt(a*a + b*b + c*c) AS a, b / sqrt(a*a + b*b + c*c) AS b, c / sqrt(a*a + b*b + c*c) AS c FROM pl0)"""


def grams(source: str, n: int, columns: str = "id") -> str:
    """The (columns, pos, gram) of all places of a table of strings."""
    return f"(SELECT {columns}, i - 1 AS pos, substr(seq, i, {n}) AS gram FROM (SELECT *, unnest(range(1, length(seq) - {n} + 2)) AS i FROM {source}))"
