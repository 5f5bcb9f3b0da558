"""From a model's coefficients to a table of weights by (model_id, pos, gram), and scores of strings from it.

Weight tables of single gram lengths have the columns (model_id, n, pos, gram, w); rolled-up ones, whose grams
all have max_n letters, (model_id, pos, gram, w). All joins but the one with the scored strings are
between tables bounded by letters, lengths and positions, and Spark picks their kind by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import gram_dictionary, gram_features
from ..functions.similarity import letter_similarity, position_similarity
from ..params import KernelParams
from .kernels import gs_self


def normalized_coef(train: DataFrame, descriptors: DataFrame, params: KernelParams) -> DataFrame:
    """train (id, seq, coef, ...) with coef divided by sqrt(k(x, x))."""
    k = gs_self(train, descriptors, params)
    return train.join(k, "id").withColumn("coef", F.col("coef") / F.sqrt("k")).drop("k")


def _with_model(df: DataFrame) -> DataFrame:
    return df if "model_id" in df.columns else df.withColumn("model_id", F.lit(0))


def feature_coefs(train: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """(model_id, n, pos, gram, c): coefficients summed by feature; from here on the number of strings no longer matters."""
    train = _with_model(train)
    grams = gram_features(train.select(F.struct("model_id", "coef").alias("id"), "seq"), min_n, max_n)
    return grams.groupBy(F.col("id.model_id").alias("model_id"), "n", "pos", "gram").agg(F.sum("id.coef").alias("c"))


def length_weights(train: DataFrame, descriptors: DataFrame, params: KernelParams, length: int) -> DataFrame:
    """(model_id, n, pos, gram, w) for every gram of 1 to params.n letters at every position of a string of `length`.

    Sums over features are smoothed over positions, then over one letter after another, each step
    an aggregation with partial sums.
    """
    if length < 1:
        raise ValueError("length must be positive")
    train = _with_model(train)
    spark = train.sparkSession
    sim = letter_similarity(descriptors, params.sigma_c)
    coefs = feature_coefs(train, 1, params.n)
    longest = int(train.agg(F.max(F.length("seq"))).first()[0] or 0)
    places = position_similarity(spark, max(length, longest), params.sigma_p).select(F.col("i").alias("to"), F.col("j").alias("pos"), "weight")
    w = (
        coefs.join(places, "pos")
        .where(F.col("to") <= length - F.col("n"))
        .groupBy("model_id", "n", F.col("to").alias("pos"), "gram")
        .agg(F.sum(F.col("c") * F.col("weight")).alias("w"))
    )
    parts = []
    for n in range(1, min(params.n, length) + 1):
        part = w.where(F.col("n") == n)
        for t in range(n):
            joined = part.join(sim, F.substring("gram", t + 1, 1) == F.col("b"))
            gram = F.concat(F.substring("gram", 1, t), F.col("a"), F.substring("gram", t + 2, n))
            part = joined.groupBy("model_id", "n", "pos", gram.alias("gram")).agg(F.sum(F.col("w") * F.col("sim")).alias("w"))
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def gram_weights(
    train: DataFrame, descriptors: DataFrame, params: KernelParams, length: int, fold_last: bool = False
) -> DataFrame:
    """(model_id, pos, gram, w): weight of each gram of params.n letters, its own prefixes included.

    fold_last: the last position also carries the grams that start inside its gram.
    """
    if length < params.n:
        raise ValueError("length must be at least n")
    single = length_weights(train, descriptors, params, length)
    rolled = rollup_weights(single, 1, params.n, length, descriptors)
    if not fold_last:
        return rolled
    ends = end_weights(single, 1, params.n, length, descriptors)
    last = ends.select("model_id", F.lit(length - params.n).alias("pos"), "gram", "w")
    return rolled.unionByName(last).groupBy("model_id", "pos", "gram").agg(F.sum("w").alias("w"))


def exact_gram_weights(train: DataFrame, sigma_p: float, n: int, length: int) -> DataFrame:
    """(model_id, n, pos, gram, w) of one gram length without letter similarity: sums smoothed over positions."""
    train = _with_model(train)
    longest = int(train.agg(F.max(F.length("seq"))).first()[0] or 0)
    places = position_similarity(train.sparkSession, max(length, longest), sigma_p)
    return (
        feature_coefs(train, n, n)
        .join(places.select(F.col("i").alias("to"), F.col("j").alias("pos"), "weight"), "pos")
        .where(F.col("to") <= length - n)
        .groupBy("model_id", "n", F.col("to").alias("pos"), "gram")
        .agg(F.sum(F.col("c") * F.col("weight")).alias("w"))
    )


def _all_grams(weights: DataFrame, letters: DataFrame, max_n: int) -> DataFrame:
    """(model_id, gram) of all grams of max_n letters for each model of the table; an error for more than MOST_GRAMS."""
    grams = gram_dictionary(letters.select("letter").distinct().withColumn("letter_idx", F.lit(0)), max_n).select("gram")
    return weights.select("model_id").distinct().crossJoin(grams)


def weight_trie(weights: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """(model_id, pos, prefix, w): for each (pos, gram) with a weight of its own, and each prefix of one, the weights of all grams of min_n letters or more
    that it starts with.

    A gram's rolled-up weight is that of its longest prefix in the table, so all grams that go on from there without weights of their own share one
    row: the table is as large as the weights times max_n, whatever the number of possible grams.
    """
    own = weights.where(F.col("n").between(min_n, max_n)).select("model_id", "n", "pos", "gram", "w")
    below = own.select("model_id", "pos", "gram", "w", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("size"))
    prefix = F.expr("substring(gram, 1, size)").alias("prefix")
    nodes = below.groupBy("model_id", "pos", prefix).agg(F.sum(F.when(F.length("gram") == F.col("size"), F.col("w")).otherwise(0.0)).alias("w"))
    # each node gives its weight to itself and takes those of its prefixes
    up = nodes.select("model_id", "pos", F.col("prefix").alias("node"), F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("size"))
    up = up.select("model_id", "pos", "node", F.expr("substring(node, 1, size)").alias("prefix"))
    return up.join(nodes, ["model_id", "pos", "prefix"]).groupBy("model_id", "pos", F.col("node").alias("prefix")).agg(F.sum("w").alias("w"))


def rolled_up(trie: DataFrame, asked: DataFrame) -> DataFrame:
    """(model_id, pos, gram, w) for the grams asked for (pos, gram), under each model of a weight trie; 0 where no prefix has a weight."""
    models = trie.select("model_id").distinct()
    every = models.crossJoin(asked.select("pos", "gram").distinct())
    steps = every.withColumn("size", F.explode(F.sequence(F.lit(1), F.length("gram")))).withColumn("prefix", F.expr("substring(gram, 1, size)"))
    found = steps.join(trie, ["model_id", "pos", "prefix"], "left")
    return found.groupBy("model_id", "pos", "gram").agg(F.coalesce(F.max_by("w", F.when(F.col("w").isNotNull(), F.col("size"))), F.lit(0.0)).alias("w"))


def rollup_weights(weights: DataFrame, min_n: int, max_n: int, length: int, letters: DataFrame | None, asked: DataFrame | None = None) -> DataFrame:
    """(model_id, pos, gram, w): at positions 0 to max(length - max_n, 0), the weights of all grams of min_n to max_n letters that a gram starts with.

    Of all grams of max_n letters over the alphabet, or of those asked for (gram) alone, which takes no table of all.
    """
    last = max(length - max_n, 0)
    every = weights.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("pos"))
    trie = weight_trie(weights.where(F.col("pos") <= last), min_n, max_n)
    if asked is None:
        asked = _all_grams(weights, letters, max_n).select("gram").distinct()
    return rolled_up(trie, asked.select("gram").distinct().crossJoin(F.broadcast(every)))


def end_weights(weights: DataFrame, min_n: int, max_n: int, length: int, letters: DataFrame | None, asked: DataFrame | None = None) -> DataFrame:
    """(model_id, gram, w): for each final gram, the weights of the shorter grams that start after its first letter; of all grams, or of those asked for (gram)."""
    last = max(length - max_n, 0)
    steps = [
        F.struct(F.lit(n).alias("n"), F.lit(last + 1 + i).alias("pos"), F.substring("gram", i + 2, n).alias("part"))
        for n in range(min_n, max_n + 1)
        for i in range(min(max_n, length) - n)
    ]
    models = weights.select("model_id").distinct()
    full = _all_grams(weights, letters, max_n) if asked is None else models.crossJoin(asked.select("gram").distinct())
    if not steps:
        return full.withColumn("w", F.lit(0.0))
    parts = full.withColumn("s", F.explode(F.array(*steps))).select("model_id", "gram", "s.n", "s.pos", "s.part")
    small = weights.select("model_id", "n", "pos", F.col("gram").alias("part"), "w")
    return parts.join(small, ["model_id", "n", "pos", "part"], "left").groupBy("model_id", "gram").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def weights_in_range(weights: DataFrame, min_n: int, max_n: int, shortest: int, longest: int, letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one rolled-up table for the longest strings, end weights (model_id, length, gram, w) of each length of the range)."""
    if not min_n <= shortest <= longest:
        raise ValueError("min_n <= shortest <= longest is needed")
    rolled = rollup_weights(weights, min_n, max_n, longest, letters)
    ends = [
        end_weights(weights, min_n, max_n, size, letters).select("model_id", F.lit(size).alias("length"), "gram", "w")
        for size in range(shortest, longest + 1)
    ]
    return rolled, reduce(DataFrame.unionByName, ends)


def score_strings(weights: DataFrame, strings: DataFrame) -> DataFrame:
    """(model_id, id, score): sum of the weights of each string's (pos, gram); strings or prefixes without a known gram have no row.

    weights: grams of one length (model_id, pos, gram, w), or of several (model_id, n, pos, gram, w).
    """
    shortest, longest = weights.agg(F.min(F.length("gram")), F.max(F.length("gram"))).first()
    if shortest is None:
        return strings.select(F.lit(0).alias("model_id"), "id", F.lit(0.0).alias("score")).limit(0)
    grams = gram_features(strings, shortest, longest).select("id", "pos", "gram")
    return grams.join(weights, ["pos", "gram"]).groupBy("model_id", "id").agg(F.sum("w").alias("score"))
