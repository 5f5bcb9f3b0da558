"""Scores of strings that arrive as a stream, against a static table of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import places


def score_stream(weights: DataFrame, strings: DataFrame, n: int, event_time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(id, event_time, score) of a stream of strings (id, seq, event_time), by weights (pos, gram, w) of grams of n letters.

    A stream-static join on (pos, gram), summed by string; a score is final once the watermark has passed it.
    """
    rows = strings.withWatermark(event_time, late).select("id", event_time, F.explode(places(n)).alias("g"))
    rows = rows.select("id", event_time, "g.pos", "g.gram")
    return rows.join(weights.select("pos", "gram", "w"), ["pos", "gram"]).groupBy("id", event_time).agg(F.sum("w").alias("score"))
