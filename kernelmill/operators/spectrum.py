"""n-gram spectra to strings: rounding, de Bruijn graphs, Euler paths. Spectra are (target, gram, w)."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_to_count(spectra: DataFrame, length: int) -> DataFrame:
    """(target, gram, count): weights, clipped at 0, times one factor, rounded half to even. The factor is 1 if the counts then reach
    the number of grams of a string of `length`; else it grows from step to step until they do, each step taking the
    weight that is nearest to its next half 0.01 beyond it. An error where no weight is positive.

    All steps that a spectrum can take are listed and folded in DataFrame functions; one group is one spectrum, bounded by |A|^n,
    with at most `length` steps a gram.
    """
    if length < 1:
        raise ValueError("length must be positive")
    weight = F.greatest(F.coalesce(F.col("w"), F.lit(0.0)), F.lit(0.0))
    whole = spectra.groupBy("target").agg(F.collect_list(F.struct("gram", weight.alias("w"))).alias("g"), (length + 1 - F.first(F.length("gram"))).alias("need"))
    rounded = lambda factor: F.aggregate("g", F.lit(0).cast("long"), lambda n, x: n + F.bround(x["w"] * factor).cast("long"))
    positive = F.filter("g", lambda x: x["w"] > 0)
    # a weight passes its half at `half`; the step that takes it there ends at `to`
    steps = F.transform(positive, lambda x: F.transform(F.sequence(F.lit(0), F.greatest("need", F.lit(0))), lambda k: F.named_struct(F.lit("to"), (k + 0.51) / x["w"], F.lit("half"), (k + 0.5) / x["w"])))
    state = lambda factor: F.named_struct(F.lit("factor"), factor, F.lit("n"), rounded(factor))

    def step(at, e):
        taken = (at["n"] < F.col("need")) & (e["half"] >= at["factor"])
        return F.when(taken, state(e["to"])).otherwise(at)

    end = F.aggregate(F.array_sort(F.flatten(steps)), state(F.lit(1.0)), step)
    stuck = F.raise_error(F.concat(F.lit("no positive weight for target "), F.coalesce(F.col("target").cast("string"), F.lit("null"))))
    factor = F.when((F.size(positive) == 0) & (F.col("need") > 0), stuck.cast("double")).otherwise(end["factor"])
    # the factor is the field of one struct, so that it is worked out once for a spectrum and not for each gram
    once = F.array(F.struct(factor.alias("factor"), F.col("g")))
    counted = F.transform(once, lambda s: F.transform(s["g"], lambda x: F.struct(x["gram"].alias("gram"), F.bround(x["w"] * s["factor"]).cast("long").alias("count"))))
    return whole.select("target", F.explode(F.flatten(counted)).alias("x")).select("target", "x.gram", "x.count")


def round_by_threshold(spectra: DataFrame, thresholds: DataFrame, min_count: int) -> DataFrame:
    """(target, gram, count): 1 where a weight is over its gram's threshold (gram, threshold), topped up to min_count with the largest weights; ties by gram."""
    joined = spectra.join(thresholds, "gram")
    over = (F.col("w") > F.col("threshold")).cast("int")
    ranked = joined.withColumn("over", over).withColumn("n_over", F.sum("over").over(Window.partitionBy("target")))
    ranked = ranked.withColumn("rest", F.row_number().over(Window.partitionBy("target", "over").orderBy(F.desc("w"), "gram")))
    # the largest weights overall fill the gap, those over their threshold not counted again
    best = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("w"), "gram"))
    ranked = ranked.withColumn("best", best)
    top = ranked.withColumn("free", F.when((F.col("over") == 0) & (F.col("best") <= min_count), 1).otherwise(0))
    nth = F.sum("free").over(Window.partitionBy("target").orderBy("best").rowsBetween(Window.unboundedPreceding, 0))
    add = (F.col("free") == 1) & (nth <= min_count - F.col("n_over"))
    return top.select("target", "gram", F.when((F.col("over") == 1) | add, 1).otherwise(0).cast("long").alias("count"))


def expand_counts(counts: DataFrame) -> DataFrame:
    """(target, gram): one row for each repetition."""
    rows = counts.where("count > 0")
    return rows.select("target", "gram", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("i")).drop("i")


def debruijn_edges(counts: DataFrame) -> DataFrame:
    """(target, source, sink, multiplicity): grams as edges from their first n-1 letters to their last."""
    n = F.length("gram")
    edges = counts.where("count > 0").select("target", F.expr("substring(gram, 1, length(gram) - 1)").alias("source"), F.substring("gram", F.lit(2), n).alias("sink"), "count")
    return edges.groupBy("target", "source", "sink").agg(F.sum("count").alias("multiplicity"))


def debruijn_nodes(counts: DataFrame) -> DataFrame:
    """(target, node, out_degree, in_degree) over all nodes of the edges."""
    edges = debruijn_edges(counts)
    ends = edges.select("target", F.col("source").alias("node"), F.col("multiplicity").alias("o"), F.lit(0).cast("long").alias("i")).unionAll(
        edges.select("target", F.col("sink").alias("node"), F.lit(0).cast("long"), "multiplicity")
    )
    return ends.groupBy("target", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _trail(edges: dict[str, list[str]], start: str) -> list[tuple[str | None, str]]:
    """(from, to) of the edges of a walk from start that can't be made longer, with all closed walks on its way spliced in;
    the first has no from. Uses up edges. Where no Euler path begins at start, some edges don't follow the one before."""
    stack, out = [(None, start)], []
    while stack:
        left = edges.get(stack[-1][1])
        if left:
            stack.append((stack[-1][1], left.pop()))
        else:
            out.append(stack.pop())
    return out[::-1]


def _euler_string(grams: list[str], counts: list[int], merge: bool) -> str:
    edges: dict[str, list[str]] = {}
    inward: dict[str, int] = {}
    for g, c in zip(grams, counts):
        edges.setdefault(g[:-1], []).extend([g[1:]] * c)
        inward[g[1:]] = inward.get(g[1:], 0) + c
    for to in edges.values():
        to.sort(reverse=True)
    # connected parts, so that each is walked from a node that can start a path through all of its edges if there is one
    parts: dict[str, str] = {}

    def root(x: str) -> str:
        while parts.setdefault(x, x) != x:
            x = parts[x]
        return x

    for a, to in edges.items():
        for b in to:
            parts[root(a)] = root(b)
    by_part: dict[str, list[str]] = {}
    for a in sorted(edges):
        by_part.setdefault(root(a), []).append(a)
    walks = []
    for nodes in by_part.values():
        while any(edges[a] for a in nodes):
            live = [a for a in nodes if edges[a]]
            starts = [a for a in live if len(edges[a]) > inward.get(a, 0)] or live[:1]
            tries = []
            for a in starts:  # one at most where there is an Euler path
                left = {x: list(edges[x]) for x in live}
                tries.append((_valid(_trail(left, a), left), left))
            walk, left = max(tries, key=lambda t: len(t[0]))
            edges.update(left)
            for a in walk[1:]:
                inward[a] -= 1
            walks.append(walk)
    walks.sort(key=lambda w: (-len(w), w))
    word = lambda w: w[0] + "".join(x[-1] for x in w[1:])
    if not walks:
        return ""
    return "".join(map(word, walks)) if merge else word(walks[0])


def _valid(trail: list[tuple[str | None, str]], edges: dict[str, list[str]]) -> list[str]:
    """The nodes of the longest stretch of a trail whose edges follow each other; all other edges are put back."""
    cut = [0, *[i for i in range(1, len(trail)) if trail[i][0] != trail[i - 1][1]], len(trail)]
    pieces = [trail[a:b] for a, b in zip(cut, cut[1:])]
    best = max(pieces, key=len)
    for p in pieces:
        for a, b in p[:1] if p is best else p:
            if a is not None:
                edges.setdefault(a, []).append(b)
    if best[0][0] is not None and len(best) == 1:  # a lone edge
        a, b = best[0]
        edges[a].remove(b)
        return [a, b]
    return [b for _, b in best]


def euler_strings(counts: DataFrame, merge: bool = True, length: int | None = None) -> DataFrame:
    """(target, seq): a string that uses every gram of its spectrum (target, gram, count) once, where an Euler path exists; else the
    paths of greatest length one after another (merge), or only the longest. length cuts the string. Deterministic. One group is one spectrum."""

    def path(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["count"] > 0].sort_values("gram")
        seq = _euler_string(part["gram"].tolist(), part["count"].astype(int).tolist(), merge)
        return pd.DataFrame({"target": [key[0]], "seq": [seq[:length] if length else seq]})

    kind = dict(counts.dtypes)["target"]
    return counts.groupBy("target").applyInPandas(path, f"target {kind}, seq string")
