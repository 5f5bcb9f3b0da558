"""Summary tables behind the usual reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import positional_grams
from ..shared import at_most, materialized

#: Columns of a pivoted report.
MOST_COLUMNS = 5000
#: Values of a group that a task holds for its percentiles; beyond, ranks are narrowed down by BUCKETS parts of a range until FEW values are left.
MOST_VALUES, BUCKETS, FEW, ROUNDS = 1_000_000, 1024, 10_000, 80
#: Bandwidths within which a value counts for a density.
REACH = 8.5


def search_summary(log: DataFrame) -> DataFrame:
    """One row: means of a search log's counters and times, the share of approximate searches, and their number."""
    mean = {"search_mean_time": "total_time", "search_mean_solution_time": "solution_time", "search_mean_start_nodes_time": "start_nodes_time", "search_mean_n_iterations": "n_iterations", "search_mean_solution_n_iterations": "solution_n_iterations"}
    cols = [F.avg(c).alias(k) for k, c in mean.items()]
    share = F.avg(F.col("is_approximate").cast("int")).alias("search_percentage_of_approximates")
    return log.agg(*cols, share, F.count("*").alias("search_n_examples"))


def score_heatmap(cv: DataFrame, a: str, b: str, phase: str, score: str = "score") -> DataFrame:
    """Mean score by a (rows) and b (a column for each value; an error beyond MOST_COLUMNS, for which `score_heatmaps` has the long form)."""
    values = sorted((r[0] for r in at_most(cv.select(b).distinct(), MOST_COLUMNS, f"values of {b}")), key=lambda v: (v is None, v))
    return cv.where(F.col("phase") == phase).groupBy(a).pivot(b, values).agg(F.avg(score))


def score_heatmaps(cv: DataFrame, params: list[str], score: str = "score") -> DataFrame:
    """(phase, x, y, x_value, y_value, score) for all pairs of parameters: one scan, each row expanded to its pairs before one aggregation."""
    pairs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("x_value"), F.col(y).cast("double").alias("y_value")) for x, y in combinations(sorted(params), 2)]
    rows = cv.select("phase", F.col(score).alias("score"), F.explode(F.array(*pairs)).alias("p")).select("phase", "score", "p.*")
    return rows.groupBy("phase", "x", "y", "x_value", "y_value").agg(F.avg("score").alias("score"))


def series_by_group(df: DataFrame) -> DataFrame:
    """(label, points): the (x, y) of each label in order."""
    return df.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points"))


def ordered_series(df: DataFrame) -> DataFrame:
    """(label, x, y) sorted, for labels with too many points for one row."""
    return df.select("label", "x", "y").orderBy("label", "x", "y")


def quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(by, share, q): exact quantiles of each group, with linear interpolation between neighbouring ranks, by distributed selection.

    The ranks asked for are narrowed down by histograms of the ranges that hold them: each round counts values in BUCKETS parts of such a range and goes on
    with the parts that hold a rank, until they have FEW values or one. Only those values are ever sorted, so no group's values meet in a task.
    Null values don't count; groups of null have no row.
    """
    spark = df.sparkSession
    rows = df.select(by, F.col(value).cast("double").alias("v")).where(F.col(by).isNotNull() & F.col("v").isNotNull())
    span = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    place = F.col("share") * (F.col("n") - 1)
    ranks = span.select(by, "n", "lo", "hi", at).withColumn("k", F.explode(F.array(F.floor(place), F.ceil(place))))
    targets = materialized(ranks.select(by, "share", place.alias("place"), "k", "lo", "hi", F.lit(0).cast("long").alias("before"), "n").distinct(), "quantiles")
    for _ in range(ROUNDS):
        wide = targets.where((F.col("n") > FEW) & (F.col("lo") < F.col("hi")))
        if not wide.limit(1).count():
            break
        ranges = wide.select(F.col(by).alias("of"), "lo", "hi").distinct()
        within = rows.join(ranges, (F.col(by) == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS)).alias("bucket")
        counts = within.groupBy("of", "lo", "hi", bucket).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        earlier = Window.partitionBy("of", "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        t, c = wide.alias("t"), counts.alias("c")
        first = F.col("t.before") + F.col("c.earlier")
        same = (F.col(f"t.{by}") == F.col("c.of")) & (F.col("t.lo") == F.col("c.lo")) & (F.col("t.hi") == F.col("c.hi"))
        narrowed = t.join(c, same & (F.col("t.k") >= first) & (F.col("t.k") < first + F.col("c.m")))
        narrowed = narrowed.select(F.col(f"t.{by}").alias(by), "t.share", "t.place", "t.k", F.col("c.low").alias("lo"), F.col("c.high").alias("hi"), first.alias("before"), F.col("c.m").alias("n"))
        targets = materialized(targets.where((F.col("n") <= FEW) | (F.col("lo") == F.col("hi"))).unionByName(narrowed), "quantiles")
    else:
        raise RuntimeError("ranges did not become small")
    equal = targets.where("lo = hi").select(by, "share", "place", "k", F.col("lo").alias("v"))
    few = targets.where("lo < hi")
    ranges = few.select(F.col(by).alias("of"), "lo", "hi", "before").distinct()
    within = rows.join(ranges, (F.col(by) == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
    rank = F.row_number().over(Window.partitionBy("of", "lo", "hi").orderBy("v")) - 1 + F.col("before")
    ranked = within.select("of", rank.alias("rank"), "v")
    found = few.join(ranked, (F.col(by) == F.col("of")) & (F.col("k") == F.col("rank"))).select(by, "share", "place", "k", "v")
    both = equal.unionByName(found).groupBy(by, "share", "place").agg(F.min_by("v", "k").alias("low"), F.max_by("v", "k").alias("high"))
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high")
    return both.select(by, "share", F.when(F.floor("place") == F.ceil("place"), F.col("low")).otherwise(between).alias("q"))


def box_summary(df: DataFrame, by: str, value: str, approximate: bool = False) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of outliers of each group.

    Exact unless approximate. Groups of up to MOST_VALUES values, as counted, are left to percentile, which holds a group's values in a task; larger ones to
    `quantiles`, which doesn't.
    """
    if approximate or (df.groupBy(by).count().agg(F.max("count")).first()[0] or 0) <= MOST_VALUES:
        q = (lambda p: F.percentile_approx(value, p)) if approximate else (lambda p: F.percentile(value, F.lit(p)))
        boxes = df.groupBy(by).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    else:
        own = lambda p: F.max(F.when(F.col("share") == p, F.col("q")))
        boxes = quantiles(df, by, value, (0.25, 0.5, 0.75)).groupBy(by).agg(own(0.25).alias("q1"), own(0.5).alias("median"), own(0.75).alias("q3"))
    span = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = v.between(F.col("q1") - span, F.col("q3") + span)
    return df.join(F.broadcast(boxes) if approximate else boxes, by).groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"),
        F.count(F.when(~inside, v)).alias("n_outliers"),
    )


def histogram(df: DataFrame, by: str, value: str, bins: int = 50) -> DataFrame:
    """(by, bin, low, density): equal bins over each group's own range, empty ones included; the top value belongs to the last bin."""
    if bins < 1:
        raise ValueError("bins must be positive")
    rows = df.where(F.col(value).isNotNull())
    span = rows.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    span = span.select(by, "total", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), ((F.col("hi") - F.col("lo")) / bins).alias("w"))
    span = span.withColumn("w", F.when(F.col("w") == 0, 1.0 / bins).otherwise(F.col("w")))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.col("w"))).cast("int")
    counts = rows.join(span, by).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    density = F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("w"))
    return grid.join(counts, [by, "bin"], "left").select(by, "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), density.alias("density"))


def kde(df: DataFrame, by: str, value: str, points: int = 50, error: float = 1e-9) -> DataFrame:
    """(by, point, x, density): Gaussian kernel density on a grid that goes half the range beyond each group's values; bandwidth h by Scott's rule.

    Values count at the points within REACH bandwidths of them; beyond, a kernel is below 1e-16 of its height. A group with more values than nodes
    is binned linearly: each value is shared by the nodes at its sides in proportion to their nearness. Nodes lie so close that the density is
    off by at most error / h: linear interpolation of a kernel is off by at most (d/h)^2 / 8 of its largest second derivative, 0.4 / h. So the work of a
    large group is nodes times points in reach, whatever its number of values, and both sums are made in tasks first.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    stats = rows.groupBy(by).agg(F.count("*").alias("total"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = stats.where(F.col("sd") > 0).withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
    stats = stats.withColumn("d", F.col("h") * (8 * error / 0.4) ** 0.5)
    stats = materialized(stats.withColumn("binned", F.col("total") > (F.col("hi") - F.col("lo")) / F.col("d")), "kde-stats")
    of = rows.join(stats.select(by, "lo", "d", "binned"), by)
    place = (F.col("v") - F.col("lo")) / F.col("d")
    node, part = F.floor(place), place - F.floor(place)
    sides = F.array(F.struct(node.alias("node"), (1 - part).alias("n")), F.struct((node + 1).alias("node"), part.alias("n")))
    nodes = of.where("binned").select(by, "lo", "d", F.explode(sides).alias("s")).groupBy(by, "s.node").agg(F.sum("s.n").alias("n"), F.first("lo").alias("lo"), F.first("d").alias("d"))
    nodes = nodes.select(by, (F.col("lo") + F.col("node") * F.col("d")).alias("v"), "n")
    counted = of.where("not binned").groupBy(by, "v").agg(F.count("*").cast("double").alias("n")).unionByName(nodes)
    reach = F.col("hi") - F.col("lo")
    step, first = 2 * reach / max(1, points - 1), F.col("lo") - 0.5 * reach
    near = lambda side, f: f((F.col("v") + side * REACH * F.col("h") - first) / step)
    a, z = F.greatest(F.lit(0), near(-1, F.ceil)), F.least(F.lit(points - 1), near(1, F.floor))
    spread = counted.join(stats, by).select(by, "v", "n", "h", first.alias("first"), step.alias("step"), F.when(a <= z, F.sequence(a, z)).alias("p"))
    spread = spread.select(by, "v", "n", "h", "first", "step", F.explode("p").alias("point"))
    away = (F.col("first") + F.col("point") * F.col("step") - F.col("v")) / F.col("h")
    sums = spread.groupBy(by, F.col("point").cast("int").alias("point")).agg(F.sum(F.col("n") * F.exp(-0.5 * away * away)).alias("s"))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", first + F.col("point") * step)
    height = F.col("total") * F.col("h") * (2 * 3.141592653589793) ** 0.5
    return grid.join(sums, [by, "point"], "left").select(by, "point", "x", (F.coalesce("s", F.lit(0.0)) / height).alias("density"))


def motif_profile(strings: DataFrame, small_sample_correction: bool = False, letters: int = 20) -> DataFrame:
    """(pos, letter, n, frequency, bits): letter frequencies by position, and what each letter adds to the information of its position.

    letters: size of the alphabet; the correction takes (letters - 1) / (2 ln 2 · strings at the position) off the information.
    """
    counts = positional_grams(strings, 1).groupBy("pos", F.col("gram").alias("letter")).agg(F.count("*").alias("n"))
    at = Window.partitionBy("pos")
    total = F.sum("n").over(at)
    rows = counts.withColumn("total", total).withColumn("frequency", F.col("n") / F.col("total"))
    entropy = -F.sum(F.col("frequency") * F.log2("frequency")).over(at)
    less = F.lit(letters - 1.0) / (2 * F.log(F.lit(2.0)) * F.col("total")) if small_sample_correction else F.lit(0.0)
    information = F.log2(F.lit(float(letters))) - entropy - less
    return rows.withColumn("bits", F.col("frequency") * information).select("pos", "letter", "n", "frequency", "bits")


def axis_limits(df: DataFrame, x: str = "y", y: str = "prediction") -> DataFrame:
    """One row: the common least and greatest value of two columns."""
    return df.agg(F.least(F.min(x), F.min(y)).alias("low"), F.greatest(F.max(x), F.max(y)).alias("high"))
