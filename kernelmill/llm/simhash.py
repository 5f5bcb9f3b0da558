"""SimHash near-dedup: fingerprints, and exact pairs within a few bits by vantage-point trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import PIECE_BYTES, mix64, per_text, release, word_pieces, written

#: A table of ids of up to so many rows, counted, is broadcast.
BROADCAST_ROWS = 400_000
#: Shingles whose bits are counted at once.
PIECE = 1 << 17
#: Fingerprints that a plan parts at least, that are routed in one task, and levels of plans (one parts some hundred times).
LEAF, ROUTED_ROWS, MOST_LEVELS = 64, 1_000_000, 40


def shingles(text: bytes | None, shingle: int) -> Iterator[list[bytes]]:
    """The shingles of a text, repeats included, piece by piece; a text of fewer words is one shingle, one without words has none."""
    kept: list[bytes] = []  # the last words of the piece before, which shingles go on from
    total = 0
    for w in word_pieces(text.lower() if text else b""):
        total += len(w)
        w = kept + w
        if total >= shingle:
            yield list(map(b" ".join, zip(*[w[k:] for k in range(shingle)])))
            w = w[len(w) - shingle + 1 :]
        kept = w
    if 0 < total < shingle:
        yield [b" ".join(kept)]


def _fingerprints(texts: list, shingle: int, seed: int) -> list[int]:
    """The signed 64-bit fingerprints of UTF-8 texts."""
    out: list[int] = []
    hashes: list[int] = []
    lens: list[int] = []

    def close() -> None:
        if lens:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            fp = np.packbits(2 * counts > np.array(lens)[:, None], axis=1)[:, ::-1]
            out.extend(np.ascontiguousarray(fp).view(np.int64).reshape(-1).tolist())
        hashes.clear()
        lens.clear()

    h = xxhash.xxh64_intdigest
    for t in texts:
        if t and len(t) > PIECE_BYTES:  # counted in pieces, as a bit's count adds up over them
            close()
            n, count = 0, np.zeros(64, np.int64)
            for grams in shingles(t, shingle):
                part = np.fromiter((h(g, seed) for g in grams), np.uint64)
                n += len(part)
                if len(part):
                    count += np.unpackbits(part.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * count > n)[::-1].copy().view(np.int64)[0]))
            continue
        grams = [g for piece in shingles(t, shingle) for g in piece]
        if not grams:
            close()
            out.append(0)
            continue
        hashes.extend(h(g, seed) for g in grams)
        lens.append(len(grams))
        if len(hashes) >= PIECE:
            close()
    close()
    return out


def fingerprint(
    docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 3, seed: int = 42
) -> DataFrame:
    """Struct `row` (the carried columns) and fp, the SimHash as a signed 64-bit number.

    A-Z are lower-cased; words are runs without ASCII white space; a shingle is `shingle` words joined
    by spaces, repeats counted; a text of fewer words is one shingle, one without words has fingerprint 0.
    A bit is set if it is set in over half of the shingles' XXH64. Null counts as empty.
    """
    return per_text(docs, text, carry, "fp long", lambda: lambda texts: {"fp": _fingerprints(texts, shingle, seed)})


def _distance(fps: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ v)


def _plan(sample: np.ndarray, leaf: int, radius: int) -> list[tuple]:
    """A vantage-point tree over a sample: (vantage, bound, inner, outer) a node, leaves are -1 - shard.

    The bound is a distance that parts the sample most evenly, counting what overlaps; a part
    that no distance makes smaller stays a leaf.
    """
    nodes: list[tuple] = []
    shards = 0

    def build(points: np.ndarray) -> int:
        nonlocal shards
        v, bound = _vantage(points, radius) if len(points) > leaf else (None, None)
        if v is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(())
        d = _distance(points, v)
        nodes[at] = (v, bound, build(points[d <= bound + radius]), build(points[d > bound]))
        return at

    build(sample)
    return nodes


def _vantage(points: np.ndarray, radius: int) -> tuple:
    """(vantage, bound) with the least points left in the larger part, or (None, None) if none helps."""
    best = (0.9 * len(points), None, None)
    for k in range(0, len(points), max(1, len(points) // 8)):
        have = np.cumsum(np.bincount(_distance(points, points[k]), minlength=65 + radius))
        inner, outer = have[radius:], have[-1] - have[: len(have) - radius]
        cost = np.maximum(inner, outer)
        b = int(cost.argmin())
        if cost[b] < best[0]:
            best = (cost[b], points[k], b)
    return best[1], best[2]


def _route(fps: np.ndarray, nodes: list[tuple], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, fingerprints). One that may have a partner across a bound goes to both sides:
    by the triangle inequality, a point farther than bound + radius from the vantage has none inside."""
    todo = [(0 if nodes else -1, fps)]
    while todo:
        at, points = todo.pop()
        if not len(points):
            continue
        if at < 0:
            yield -1 - at, points
            continue
        v, bound, inner, outer = nodes[at]
        d = _distance(points, v)
        todo.append((inner, points[d <= bound + radius]))
        todo.append((outer, points[d > bound]))


def _planner(shard: int, sample: int, radius: int):
    def run(table: pa.Table) -> pa.Table:
        """The tree of one large shard from its sample; none where no vantage point parts it."""
        n = table["n"][0].as_py()
        points = np.random.default_rng(0).permutation(np.sort(table["fp"].to_numpy().view(np.uint64)))
        nodes = _plan(points, max(LEAF, int(shard * min(1.0, sample / n))), radius)
        return pa.table({"shard": table["shard"][:1], "n": table["n"][:1], "plan": pa.array([pickle.dumps(nodes) if nodes else None], pa.binary())})

    return run


def _router(shard: int, radius: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a large shard in its parts, or with the number of blocks it is dealt into if there are none."""
        points, plan = left["fp"].to_numpy().view(np.uint64), right["plan"][0].as_py() if len(right) else None
        if plan is None:
            blocks = -(-left["n"][0].as_py() // shard) if len(left) else 1
            return pa.table({"shard": left["shard"], "fp": left["fp"], "blocks": pa.array(np.full(len(left), blocks, np.int64))})
        found = list(_route(points, pickle.loads(plan), radius)) if len(left) else []
        old = np.uint64(right["shard"][0].as_py() & (2**64 - 1))
        with np.errstate(over="ignore"):
            new = [np.full(len(p), mix64(np.array([old + np.uint64(k + 1)]))[0]) for k, p in found]
        to = np.concatenate([np.empty(0, np.uint64), *new]).view(np.int64)
        fp = np.concatenate([np.empty(0, np.uint64), *[p for _, p in found]]).view(np.int64)
        return pa.table({"shard": pa.array(to), "fp": pa.array(fp), "blocks": pa.array(np.zeros(len(fp), np.int64))})

    return run


class _Forest:
    """Union-find over positions of an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _link(fps: np.ndarray, radius: int, forest: _Forest, leaf: int = 256) -> None:
    """Joins all pairs within radius: a vantage-point tree down to leaves compared outright."""
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        points = fps[at]
        v, bound = _vantage(points, radius) if len(at) > leaf else (None, None)
        if v is not None:
            d = _distance(points, v)
            todo.extend((at[d <= bound + radius], at[d > bound]))
            continue
        for k in range(0, len(at), 256):  # rows against themselves and all later ones
            close = np.bitwise_count(points[k : k + 256, None] ^ points[None, k:]) <= radius
            for i, j in np.argwhere(close).tolist():
                if j > i:
                    forest.join(int(at[k + i]), int(at[k + j]))


def near_links(fps: DataFrame, radius: int = 2, shard: int = 8_000, sample: int = 50_000) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all pairs within radius bits.

    fps: distinct fingerprints in column fp. Shards of more than twice `shard` fingerprints are parted by a tree planned on a sample
    of their own, of about `sample` at most; those near a bound go to the shards on both sides; what is still too large is
    parted again, level by level, so plans grow with the input. Each shard finds its exact pairs by a tree of its own and gives
    back only a spanning forest, so near copies by the thousand give links by the thousand, not pairs by the million. A shard that no
    vantage point parts (a tight cluster) is dealt into blocks, and each pair of blocks is a group of its own: exact, with bounded memory.
    """
    cap, ready = 2 * shard, []
    one, level = F.lit(1).cast("long"), written(fps.select(F.lit(0).cast("long").alias("shard"), "fp"), "vp-level")
    for depth in range(MOST_LEVELS):
        sizes = written(level.groupBy("shard").agg(F.count("*").alias("n")), "vp-sizes")
        if not sizes.where(F.col("n") > cap).limit(1).count():
            ready.append(level.select("shard", "fp", one.alias("blocks")))
            break
        sized = level.join(sizes, "shard")
        ready.append(sized.where(F.col("n") <= cap).select("shard", "fp", one.alias("blocks")))
        large = sized.where(F.col("n") > cap)
        u = F.pmod(F.xxhash64("fp", F.lit(depth)), F.lit(1 << 30)) / float(1 << 30)
        plans = written(large.where(u < sample / F.col("n")).groupBy("shard").applyInArrow(_planner(shard, sample, radius), "shard long, n long, plan binary"), "vp-plans")
        parts = F.ceil(F.col("n") / ROUTED_ROWS)
        rows = large.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit("salt")), parts))
        plans = plans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        routed = rows.groupBy("shard", "salt").cogroup(plans.groupBy("shard", "salt")).applyInArrow(_router(shard, radius), "shard long, fp long, blocks long")
        routed = written(routed, "vp-routed")
        ready.append(routed.where("blocks > 0"))
        level = routed.where("blocks = 0").select("shard", "fp")
    else:
        raise RuntimeError("shards did not become small")
    dealt = reduce(DataFrame.unionByName, ready).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("shard", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "fp")

    def link(table: pa.Table) -> pa.Table:
        f = np.sort(table["fp"].to_numpy().view(np.uint64))
        forest = _Forest(len(f))
        _link(f, radius, forest)
        roots = np.fromiter((forest.root(k) for k in range(len(f))), np.int64, len(f))
        linked = np.flatnonzero(roots != np.arange(len(f)))
        out = pa.table({"a": f[roots[linked]].view(np.int64), "b": f[linked].view(np.int64)})
        del f, forest, roots
        release()
        return out

    return dealt.groupBy("shard", "i", "j").applyInArrow(link, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps until no link changes. Each step is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(),
            "cc",
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: list[str] | None = None,
    shingle: int = 3,
    radius: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Struct `row` (the carried columns), fp, n (a number of the row), root (the smallest
    fingerprint of its component) and component_id (the smallest id in it).

    Fingerprints link at `radius` or fewer differing bits; equal ones are one node, so copies cost one
    row however many. Null ids take part, but are no one's component id unless a component has no other.
    An empty table gives an empty result; repeated rows stay, each with its component.
    """
    kept = docs.columns if carry is None else [*carry, *([] if doc_id in carry else [doc_id])]
    rows = fingerprint(docs, text, kept, shingle, seed).withColumn("n", F.monotonically_increasing_id())
    rows = written(rows, "simhash").withColumn("id", F.col("row").getField(doc_id))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    comp = written(components(near_links(nodes.select("fp"), radius)), "simhash-cc")
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("row", "fp", "n", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the smallest id (null ids last), one of repeated rows.

    Components are found on (id, hash of the text) alone. What goes is a table of ids, broadcast
    if it is small when measured, else joined by id; only then are texts shuffled.
    """
    key = F.xxhash64(docs[text]).alias("key")
    slim = docs.select(docs[doc_id].alias("id"), key, docs[text].alias("text"))
    rows = written(near_duplicates(slim, "text", "id", ["id", "key"], shingle, radius, seed).select("row.id", "row.key", "root"), "simhash-rows")
    return keep_one(docs, rows, text, doc_id)


def keep_one(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with one row of each root of rows (id, key, root), a row for each of docs; key is the hash of its text."""
    own = [docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"))
    # (id, key) has few rows where a component may have very many
    first = first.select(F.col("first.id").alias("i"), F.col("first.key").alias("k"))
    each = rows.groupBy("id", "key").agg(F.count("*").alias("n"))
    each = each.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    found = written(each.select("id", "key", "n", F.col("k").isNotNull().alias("stays")), "simhash-keep")
    gone = found.where("not stays").select("id", "key")
    match = lambda t: F.col(at[doc_id]).eqNullSafe(t["id"]) & (F.xxhash64(F.col(at[text])) == t["key"])
    kept = docs.select(*own)
    kept = kept.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, match(gone), "left_anti")
    twice = found.where("stays and n > 1").select("id", "key")
    if twice.limit(1).count():  # repeated rows of a document that stays: all but one go
        several = kept.join(twice, match(twice), "left_semi")
        one = several.withColumn("rn", F.row_number().over(Window.partitionBy(at[doc_id], F.xxhash64(at[text])).orderBy(F.lit(0)))).where("rn = 1").drop("rn")
        kept = kept.join(twice, match(twice), "left_anti").unionByName(one)
    return kept.toDF(*docs.columns)
