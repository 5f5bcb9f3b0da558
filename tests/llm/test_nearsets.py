"""Near copies by 5-word shingles against comparison of all pairs in plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kernelmill.llm import nearsets


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_roots(texts):
    sets = [plain_set(t) for t in texts]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (both and 5 * both >= 4 * (len(a) + len(sets[j]) - both)):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = [" ".join(say(rng.randrange(1, 80))) for _ in range(60)]
    for n in (40, 100, 300):
        base = say(n)
        for _ in range(60):  # between none and some tenths of the words changed
            w = list(base)
            for k in rng.sample(range(n), rng.randrange(0, n // 12)):
                w[k] = f"x{rng.randrange(3000)}"
            out.append(" ".join(w))
    passage = say(60)  # a common passage alone is no near copy
    out += [" ".join(passage + say(60)) for _ in range(40)]
    out += [None, "", " \n", "one two", "One  two", out[-1], out[-1] + " end"]
    return [(k, t) for k, t in enumerate(out)] + [(3, out[3]), (None, out[5])]


def test_stage_removes_near_copies(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    roots = plain_roots([t for _, t in rows])
    want = {}
    for (i, _), r in zip(rows, roots):
        want[r] = min([x for x in (want.get(r), i) if x is not None], default=None)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted(want.values(), key=repr)
    assert len(got) < len(rows) - 20


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_large_clusters_give_the_same_components(spark, rows, monkeypatch, rounds):
    """Clusters of more than twenty texts: by blocks alone, by one round of few representatives and then blocks, by rounds."""
    monkeypatch.setattr(nearsets, "ROUNDS", rounds)
    monkeypatch.setattr(nearsets, "REPS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slim = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    want = plain_roots([t for _, t in rows])
    part = lambda pairs: sorted(sorted(map(repr, v)) for v in pairs.values())
    a, b = {}, {}
    for r, x in zip(want, rows):
        a.setdefault(r, []).append(x[0])
    for r in nearsets.near_sets(slim, "text", ["doc_id", "key"], group_rows=10).collect():
        b.setdefault(r.root, []).append(r.doc_id)
    assert part(a) == part(b)


def plain_print(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_stage_verifies_what_fingerprints_link(spark, monkeypatch):
    """Without the bands the stage removes the near copies within two bits; texts within two bits whose sets are unlike stay."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [say(rng.randrange(1, 80)) for _ in range(30)]
    for _ in range(3):  # a line many times over: near in fingerprint whatever stands beside it
        line = say(11)
        texts += [" ".join([line] * 60 + [say(40)]) for _ in range(4)]
        texts.append(texts[-1] + " end")
    for _ in range(10):  # one word in eighty changed: many bits
        w = say(80).split()
        texts += [" ".join(w), " ".join(w[:40] + ["other"] + w[41:])]
    texts += [None, " \n", "one two", "One  two"]
    prints, sets = [plain_print(t) for t in texts], [plain_set(t) for t in texts]
    gone, seen = set(), set()
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 2
            alike = sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            seen.add((near, alike))
            if near and alike:
                gone.add(i)
    assert len(seen) == 4
    dealt = nearsets._dealt
    monkeypatch.setattr(nearsets, "_dealt", lambda df, group, blocks: dealt(df.where(F.lit(group != "g")), group, blocks))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(range(len(texts))) - gone)


def test_fingerprint_links_are_all_pairs(spark):
    """A tight cluster, nodes of one fingerprint and a node of several, against comparison of all pairs."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = [base ^ sum(1 << b for b in range(64) if rng.random() < 0.05) for _ in range(300)] + [rng.getrandbits(64) for _ in range(300)]
    pairs = [(k, f - (f >> 63 << 64)) for k, f in enumerate(fps)]
    pairs += [(1000 + k, pairs[300 + k][1]) for k in range(20)] + [(k, pairs[280 + k][1]) for k in range(300, 310)] + pairs[:5]
    want = {h: h for h, _ in pairs}
    for h, f in pairs:
        for g, e in pairs:
            if ((f ^ e) & (2**64 - 1)).bit_count() <= 2 and want[h] != want[g]:
                a, b = sorted((want[h], want[g]))
                want = {k: a if x == b else x for k, x in want.items()}
    df = spark.createDataFrame(pairs, "h long, fp long")
    found = {r.node: r.root for r in nearsets.components(nearsets._fingerprint_links(df)).collect()}
    assert {h: found.get(h, h) for h in want} == want
    assert 50 < sum(h != r for h, r in want.items()) < 500
