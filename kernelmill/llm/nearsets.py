"""Near copies by the Jaccard similarity of word shingle sets: candidates by SimHash fingerprints in vantage-point trees, and by MinHash
bands for those whose fingerprints are farther apart; every link verified on the sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simhash import BROADCAST_ROWS, _fingerprints, components, keep_one, near_links, shingles
from .util import mix64, per_text, release, small_batches, written

#: Shingles of the fingerprints, and bits that they may differ in, as operator 2 takes them.
PRINT_SHINGLE, RADIUS = 3, 2
#: A pair of similarity 0.8 shares one of BANDS keys of BAND_ROWS minima with probability 1 - 5e-7.
BANDS, BAND_ROWS = 48, 6
#: One bit of each of 256 minima. A pair of similarity 0.8 differs in 26 of them on average; 50 is five standard deviations more.
SKETCH, SKETCH_BITS = 256, 50
#: Members of a group that are compared at once, and bytes of their sets; larger groups are dealt into blocks.
GROUP_ROWS, GROUP_BYTES = 2000, 32 << 20
#: Members that a large cluster is compared with in the first round, four times as many in each next one, and rounds.
REPS, ROUNDS = 32, 4

_rng = np.random.default_rng(42)
_ODD = _rng.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
_MIX = _rng.integers(0, 2**64, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 2**64, BANDS, np.uint64)
_WORDS = [f"s{k}" for k in range(SKETCH // 64)]
_MARKS = [*_WORDS, "fp"]


def shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The ascending XXH64 of a text's different shingles; words and short texts as in simhash.fingerprint."""
    h = xxhash.xxh64_intdigest
    parts = [np.fromiter((h(g, seed) for g in grams), np.uint64, len(grams)) for grams in shingles(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _minima(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(low, (_ODD[:, None] * s[None, k : k + 2048]).min(axis=1), out=low)
    return low


def _signatures(texts: list, shingle: int, seed: int) -> dict:
    out: dict[str, list] = {x: [] for x in ("h", "n", *_WORDS, "bands")}
    out["fp"] = _fingerprints(texts, PRINT_SHINGLE, seed)
    for t in texts:
        s = shingle_set(t, shingle, seed)
        low = _minima(s)
        sketch = np.packbits((mix64(low[:SKETCH]) & np.uint64(1)).astype(np.uint8)).view(np.int64)
        keys = mix64((low.reshape(BANDS, BAND_ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _SHIFT)
        out["h"].append(xxhash.xxh64_intdigest(s.tobytes(), seed) - (1 << 63))
        out["n"].append(len(s))
        for x, v in zip(_WORDS, sketch.tolist()):
            out[x].append(v)
        out["bands"].append(keys.view(np.int64).tolist() if len(s) else [])
    return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of marks are near by their sketches or by their fingerprints."""
    bits = np.bitwise_count(a ^ b)
    return (bits[..., :-1].sum(axis=-1, dtype=np.int64) <= SKETCH_BITS) | (bits[..., -1] <= RADIUS)


def _alike(n: np.ndarray, marks: np.ndarray, p, q, part: tuple[int, int]) -> np.ndarray:
    """Whether pairs of positions may reach the similarity, by their sizes and marks."""
    a, b = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
    return (part[1] * a >= part[0] * b) & _near(marks[p], marks[q])


def _alike_to(n: np.ndarray, marks: np.ndarray, size: int, of: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """The same of all positions with one other set."""
    a, b = np.minimum(n, size), np.maximum(n, size)
    return (part[1] * a >= part[0] * b) & _near(marks, of)


def _forest(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph in which near(p, later positions) says who is linked to p; pairs already connected are not asked."""
    comp, left = np.arange(m), m
    for p in range(m - 1):
        if left == 1:
            return
        q = np.flatnonzero(comp[p + 1 :] != comp[p]) + p + 1
        q = q[near(p, q)] if len(q) else q
        for c, k in zip(*(x.tolist() for x in np.unique(comp[q], return_index=True))):
            comp[comp == c] = comp[p]
            left -= 1
            yield p, int(q[k])


def _by_group(df: DataFrame, link: Callable[[dict, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Links (a, b) of groups of rows that share `g`: link gets columns of whole groups and where each begins."""
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {x: t[x].to_pylist() if pa.types.is_binary(t[x].type) else t[x].to_numpy() for x in names}
            starts = np.flatnonzero(np.r_[True, np.diff(cols["g"]) != 0])
            for a, b in link(cols, np.r_[starts, len(cols["g"])]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list = []  # batches of which the last group may go on
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(names.index("g")).to_numpy()
            last = int(np.searchsorted(g, g[-1]))
            if held and (last or held[-1].column(names.index("g"))[-1].as_py() != g[-1]):
                done = pa.Table.from_batches([*held, b.slice(0, last)])
                held = []
                yield from give(done)
                del done
            elif last:
                yield from give(pa.Table.from_batches([b.slice(0, last)]))
            held.append(b.slice(last))
        if held:
            yield from give(pa.Table.from_batches(held))
            held = []
        release()

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def _dealt(df: DataFrame, group: str, blocks: Column) -> DataFrame:
    """df with g in place of group: where a group has several blocks, each pair of blocks is one."""
    d = df.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("h", F.lit("block")), "blocks"))
    d = d.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64(group, F.least("own", "with"), F.greatest("own", "with"))
    return d.withColumn("g", F.when(F.col("blocks") > 1, pair).otherwise(F.col(group))).drop("blocks", "own", "with", *([] if group == "g" else [group]))


def _close(items: list[np.ndarray], n: np.ndarray, of: np.ndarray, size: int, q: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """Which of the sets at positions q have the similarity to the set `of` of `size` items."""
    ok = np.zeros(len(q), bool)
    for k in np.array_split(np.arange(len(q)), max(1, int(n[q].sum()) >> 20)):
        if len(k) and size:
            flat = np.concatenate([items[x] for x in q[k].tolist()])
            found = of[np.minimum(np.searchsorted(of, flat), size - 1)] == flat
            both = np.add.reduceat(found, np.r_[0, np.cumsum(n[q[k]])[:-1]], dtype=np.int64)
            ok[k] = part[1] * both >= part[0] * (size + n[q[k]] - both)
    return ok


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(h, n, marks, items) of rows of sets; a set that stands twice is taken once."""
    h, pick = np.unique(t["h"].to_numpy(), return_index=True)
    t = t.take(pa.array(pick))
    marks = np.stack([t[x].to_numpy() for x in _MARKS], axis=1).view(np.uint64) if len(t) else np.empty((0, len(_MARKS)), np.uint64)
    return h, t["n"].to_numpy().astype(np.int64), marks, [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]


def _labelled(t: pa.Table) -> pa.Table:
    """(root, label, main): a common name of the labels of a cluster that pairs (x, y) connect. A cluster has some hundred labels."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in zip(t["x"].to_pylist(), t["y"].to_pylist()):
        a, b = top(x), top(y)
        up[max(a, b)] = min(a, b)
    names = list(up)
    return pa.table({"root": pa.array([t["root"][0].as_py()] * len(names), pa.int64()), "label": pa.array(names, pa.int64()), "name": pa.array([top(x) for x in names], pa.int64())})


def _by_representatives(sets: DataFrame, part: tuple[int, int], group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), roots whose members must be compared outright) of large clusters. sets: (root, h, n, marks, items).

    A few members of each cluster are compared with all of it. Most of a tight cluster is then connected, and pairs within the largest
    connected part need no comparison. Members outside of it are compared with all in the next rounds, ever more at once, so the pairs are as many
    as members times those that stay outside. Clusters that are still not through after ROUNDS rounds are no tight ones.
    """
    spark = sets.sparkSession
    size = sets.groupBy("root").agg(F.count("*").alias("c"), F.sum(F.length("items")).alias("bytes"))
    size = written(size.withColumn("salts", F.greatest(F.ceil(F.col("c") / group_rows), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")), "reps-sizes")
    slim = sets.select("root", "h")
    state = slim.select("root", "h", F.lit(None).cast("long").alias("label"), F.lit(False).alias("done"))
    open_, links = slim, None

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        h, n, marks, items = _columns(left)
        rh, rn, rmarks, ritems = _columns(right)
        first, more = np.full(len(h), -1, np.int64), set()
        for p in range(len(rh)):
            near = np.flatnonzero(_alike_to(n, marks, rn[p], rmarks[p], part))
            near = near[_close(items, n, ritems[p], int(rn[p]), near, part)]
            new = first[near] < 0
            more.update((p, k) for k in np.unique(first[near[~new]]).tolist())
            first[near[new]] = p
        hit = np.flatnonzero(first >= 0)
        x, y = (np.array([q[j] for q in more], np.int64) for j in (0, 1))
        root = left["root"][0].as_py() if len(left) else 0
        out = pa.table({"root": pa.array(np.full(len(hit) + len(x), root)), "h": pa.array(np.concatenate([h[hit], rh[x]])), "rep": pa.array(np.concatenate([rh[first[hit]], rh[y]])), "member": pa.array(np.r_[np.ones(len(hit), bool), np.zeros(len(x), bool)])})
        release()
        return out

    for k in range(ROUNDS):
        # representatives of clusters that still have members outside
        order = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("h", F.lit(k)), "h"))
        reps = written(open_.withColumn("r", order).where(F.col("r") <= REPS * 4**k).drop("r"), "reps")
        if not reps.limit(1).count():
            break
        salted = size.join(reps.select("root").distinct(), "root", "left_semi")
        rows = sets.join(salted, "root").withColumn("salt", F.pmod(F.xxhash64("h", F.lit("salt")), "salts"))
        own = sets.join(reps, ["root", "h"], "left_semi").join(salted, "root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        cols = ["root", "salt", "h", "n", *_MARKS, "items"]
        found = rows.select(cols).groupBy("root", "salt").cogroup(own.select(*[F.col(c).alias(c) for c in cols]).groupBy("root", "salt")).applyInArrow(compare, "root long, h long, rep long, member boolean")
        found = written(found, "reps-found")
        got = found.select(F.col("rep").alias("a"), F.col("h").alias("b"))
        links = got if links is None else links.unionByName(got)
        # labels: a member has that of the first round that connected it; representatives connect the labels of what they are near to
        mine = found.where("member").select("root", "h", "rep")
        joined = written(state.join(mine, ["root", "h"], "left"), "reps-joined")
        pairs = joined.where("rep is not null and label is not null").select("root", F.col("rep").alias("x"), F.col("label").alias("y"))
        pairs = pairs.unionByName(found.where("not member").select("root", F.col("h").alias("x"), F.col("rep").alias("y")))
        pairs = pairs.unionByName(joined.where("rep is not null").select("root", F.col("rep").alias("x"), F.col("rep").alias("y")))
        if k:
            pairs = pairs.unionByName(joined.where("label is not null").select("root", F.col("label").alias("x"), F.col("label").alias("y")))
        names = written(pairs.distinct().groupBy("root").applyInArrow(_labelled, "root long, label long, name long"), "reps-names")
        named = joined.withColumn("label", F.coalesce("label", "rep")).join(names, ["root", "label"], "left").select("root", "h", F.col("name").alias("label"), "done")
        was = reps.withColumn("now", F.lit(True))
        state = written(named.join(was, ["root", "h"], "left").select("root", "h", "label", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "reps-state")
        main = state.where("label is not null").groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        outside = state.join(main, "root", "left").where("not done and (label is null or label != main)")
        open_ = written(outside.select("root", "h"), "reps-open")
    none = spark.createDataFrame([], "a long, b long")
    return none if links is None else links, open_.select("root").distinct()


def _fingerprint_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all nodes h with fingerprints (rows: h, fp) within RADIUS bits, by vantage-point trees."""
    pairs = written(rows.select("h", "fp").distinct(), "sets-prints")
    least = written(pairs.groupBy("fp").agg(F.min("h").alias("least")), "sets-fps")
    trees = near_links(least.select("fp"), RADIUS)
    trees = trees.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pairs.join(least, "fp").where("h != least").select(F.col("least").alias("a"), F.col("h").alias("b")).unionByName(trees)


def near_sets(
    docs: DataFrame, text: str, carry: list[str], shingle: int = 5, part: tuple[int, int] = (4, 5), seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The carried columns, h (hash of the shingle set) and root, equal for rows whose sets are linked, over any number of links,
    by a Jaccard similarity of part[0] / part[1] or more. carry must tell texts apart, or name equal ones.

    Equal sets are one node (rows of one set may have several fingerprints: all link, pairs are compared by the least). Nodes whose SimHash fingerprints (as simhash.fingerprint makes them) differ in RADIUS bits or fewer, and nodes that share
    a MinHash band, are of like size and have near sketches, form clusters; in a cluster all pairs of like size, near by sketch or fingerprint and not yet connected are compared by their sets, and only verified pairs link. A cluster beyond group_rows is compared
    with a few of its members first, which connects most of a tight one; what stays outside is compared with all. Groups of candidates, and clusters
    that this doesn't connect, are dealt into blocks, and each pair of blocks is compared: bounded in memory, quadratic in such a group. Texts without
    words are one node.
    """
    fields = f"h long, n int, {', '.join(f'{x} long' for x in _MARKS)}, bands array<long>"
    rows = per_text(docs, text, carry, fields, lambda: lambda texts: _signatures(texts, shingle, seed))
    rows = written(rows, "sets-rows")
    first = [F.first(x).alias(x) for x in ("n", *_WORDS, "bands")] + [F.min("fp").alias("fp")]
    nodes = written(rows.groupBy("h").agg(F.min("row").alias("row"), *first), "sets-nodes")

    banded = nodes.select("h", "n", *_MARKS, F.explode("bands").alias("g"))
    shared = written(banded.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "sets-bands")
    cut = lambda c, size: F.when(F.col(c) > 2 * size, F.ceil(F.col(c) / size)).otherwise(1)
    banded = _dealt(banded.join(shared, "g"), "g", cut("c", group_rows)).drop("c")

    def candidates(c: dict, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, h, marks = c["n"].astype(np.int64), c["h"], np.stack([c[x] for x in _MARKS], axis=1).view(np.uint64)
        lead = np.repeat(at[:-1], np.diff(at))
        hit = _alike(n, marks, lead, np.arange(len(h)), part)
        yield h[lead[hit]], h[hit]
        missed = np.add.reduceat(~hit, at[:-1])
        for k in np.flatnonzero((missed > 0) & (np.diff(at) > 2)).tolist():  # some are not like the first
            i, j = at[k], at[k + 1]
            found = list(_forest(j - i, lambda p, q: _alike(n, marks, i + p, i + q, part)))
            if found:
                p, q = np.array(found).T + i
                yield h[p], h[q]

    found = _fingerprint_links(rows.where("n > 0")).unionByName(_by_group(banded, candidates))
    cluster = written(components(found), "sets-clusters")
    cluster = cluster.union(cluster.select("root", "root")).distinct()  # components leaves out the roots themselves
    members = cluster.join(nodes, F.col("node") == F.col("h")).select("root", "h", "n", *_MARKS, "row")
    total = members.groupBy("root").agg(F.count("*").alias("c"), F.sum(F.col("n") * F.lit(8)).alias("bytes"))
    blocks = F.greatest(cut("c", group_rows), cut("bytes", GROUP_BYTES))
    members = written(members.join(total, "root").withColumn("blocks", blocks).drop("c", "bytes"), "sets-members")

    slim = docs.select(F.struct(*carry).alias("own"), docs[text].alias("text"))
    few = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = slim.join(few, F.col("own").eqNullSafe(F.col("row"))).drop("own", "row")
    sets = per_text(texts, "text", ["root", "h", "n", *_MARKS, "blocks"], "items binary", lambda: lambda t: {"items": [shingle_set(x, shingle, seed).tobytes() for x in t]})
    sets = sets.select("row.*", "items")
    extra = None
    if members.where("blocks > 1").limit(1).count():
        sets = written(sets, "sets-texts")
        extra, loose = _by_representatives(sets.where("blocks > 1").drop("blocks").dropDuplicates(["root", "h"]), part, group_rows)
        sets = sets.where("blocks = 1").unionByName(sets.where("blocks > 1").join(loose, "root", "left_semi").select(*sets.columns))
    sets = _dealt(sets, "root", F.col("blocks"))

    def verify(c: dict, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in zip(at[:-1], at[1:]):
            h, pick = np.unique(c["h"][i:j], return_index=True)  # repeated rows bring a set twice
            pick = pick + i
            marks = np.stack([c[x][pick] for x in _MARKS], axis=1).view(np.uint64)
            n, items = c["n"][pick].astype(np.int64), [np.frombuffer(c["items"][k], np.uint64) for k in pick.tolist()]

            def near(p: int, q: np.ndarray) -> np.ndarray:
                ok = _alike(n, marks, p, q, part)
                ok[ok] = _close(items, n, items[p], int(n[p]), q[ok], part)
                return ok

            found = list(_forest(len(h), near))
            if found:
                p, q = np.array(found).T
                yield h[p], h[q]

    links = _by_group(sets, verify)
    linked = written(components(links if extra is None else links.unionByName(extra)), "sets-linked")
    root = F.coalesce("root", "h").alias("root")
    return rows.select("row.*", "h").join(linked, F.col("h") == F.col("node"), "left").select(*carry, "h", root)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, part: tuple[int, int] = (4, 5), seed: int = 42) -> DataFrame:
    """docs with one row of each component of near copies, chosen as simhash.one_of_each does."""
    slim = docs.select(docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("text"))
    rows = written(near_sets(slim, "text", ["id", "key"], shingle, part, seed).select("id", "key", "root"), "sets-found")
    return keep_one(docs, rows, text, doc_id)
