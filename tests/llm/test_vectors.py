"""Top-k search, ranked lexical search and whitening against plain Python, with nulls, ties, repeated rows, empty tables and clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kernelmill.llm import lexical, queries, topk, toplists, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, label int, id string, score long, row int"
DATA = "/root/testdata/sf0.001"


def make(spark, rows, parts=5):
    df = spark.createDataFrame([(i, v, None, "x", 1, 2) for i, v in rows], VECTORS)
    return df.repartition(parts) if rows else df


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(rows, asked, k, scale=1024):
    """Sorted (query_id, rank, id, score) by comparing each query row with each row."""
    quant = lambda v: [math.floor(scale * float(np.float32(x))) for x in v]
    rows, asked = ([(i, quant(v)) for i, v in t if good(v)] for t in (rows, asked))
    out = []
    for q, a in asked:
        scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in rows if len(a) == len(b) and (q is None or i != q)]
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.3, 0.9]) for _ in range(6)]) for i in range(160)]  # few values: many ties
    rows += [(i, [0.5, -0.5, 0.1, 0.2, 0.3, 0.4]) for i in range(300, 420)]  # copies
    rows += [(500, None), (600, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (700, [float("nan")] * 6), (800, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, [0.9] * 6), (None, [0.9] * 6), (900, [1.0, 2.0]), (901, [1.0, -2.0]), (1000, []), (1001, []), (100, [0.3] * 6), (100, [0.3] * 6)]
    return rows


def test_top_k(spark, vectors, monkeypatch):
    asked = [(i, v) for i, v in vectors if i is not None and i % 100 == 0]
    every = make(spark, vectors)
    want = nearest(vectors, asked, 10)
    assert found(topk.top_k(every, every.where("vec_id % 100 = 0"), 10)) == want
    # small tiles, several waves and levels of merging
    for name, value in (("TILE_ROWS", 7), ("QUERY_ROWS", 3), ("WAVE_BYTES", 200)):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(toplists, "FAN", 2)
    assert found(topk.top_k(every, every.where("vec_id % 100 = 0"), 10)) == want
    strange = [(None, [0.3] * 6), (300, [0.3] * 6)]  # a query without an id, and more places than rows
    assert found(topk.top_k(every, make(spark, strange), 1000)) == nearest(vectors, strange, 1000)


def test_top_k_of_large_numbers(spark):
    rng = random.Random(6)
    for size in (30.0, 3e5, 2e8):  # within 24, 53 and 63 bits
        rows = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(4)]) for i in range(60)]
        assert found(topk.top_k(make(spark, rows), make(spark, rows[:5]), 5, scale=1.0)) == nearest(rows, rows[:5], 5, 1)
    with pytest.raises(Exception, match="too large"):
        topk.top_k(make(spark, [(1, [3e38]), (2, [3e38])]), make(spark, [(1, [3e38])]), 5).collect()


def test_top_k_of_nothing(spark, vectors):
    none, some = make(spark, []), make(spark, vectors[:4])
    assert topk.top_k(none, some).count() == topk.top_k(some, none).count() == 0
    assert topk.top_k(none, none).columns == ["query_id", "rank", "id", "score"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def ranked(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(w for _, b in bags for w in b)
    terms = {}
    for item, t in items:
        terms.setdefault(item, set()).update(words(t))
    weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    out = []
    for item, own in terms.items():
        rows = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            s = sum(weight(t) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in own if t in b)
            rows += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["w%d" % rng.randrange(30), "W3!", "é", "東京", "the", "x-y"]) for _ in range(n))
    docs = [(i, say(rng.randrange(1, 40))) for i in range(80)]
    docs += [(i, "the w1 w2 é") for i in range(500, 540)] + [(900, None), (901, ""), (902, " .,- "), (None, "w1 w1 the"), (None, "w1 w1 the")]
    docs += [(3, docs[3][1]), (950, "w7 " * 70_000 + "w8 zebra"), (951, "zebra " * 300)]
    items = [(i, say(6)) for i in range(12)] + [(20, None), (21, "?!"), (22, "unheardof"), (23, "zebra W7"), (None, "w1"), (24, "the"), (24, "w2 the")]
    return docs, items


def of_docs(spark, docs):
    return spark.createDataFrame([(*d, 1, "x", None) for d in docs], "doc_id long, text string, n int, bag string, row long").repartition(4)


def test_lexical(spark, texts, monkeypatch):
    docs, items = texts
    d = of_docs(spark, docs)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, term int")
    want = ranked(docs, items, 10)
    assert found(lexical.rank(d, i, 10)) == want
    monkeypatch.setattr(lexical, "MOST_TERMS", 20)  # several passes
    assert found(lexical.rank(d, i, 10)) == want
    assert found(lexical.rank(d, i, 200)) == ranked(docs, items, 200)  # longer lists than classes have members
    monkeypatch.setattr(lexical, "EXACT", 0)  # the path of whole numbers
    assert found(lexical.rank(d, i, 3)) == ranked(docs, items, 3)


def test_lexical_of_nothing(spark, texts):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(texts[1], "item_id long, text string")
    docs = spark.createDataFrame(texts[0], "doc_id long, text string")
    assert lexical.rank(none, items).count() == lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs, items.limit(0)).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_classes_hold_equal_bags_only(spark, texts):
    """Copies become one class, of the smallest ids; every other bag or length is another."""
    docs, _ = texts
    vocab = spark.sparkContext.broadcast({b"the": 0, b"w1": 1, b"w2": 2})
    bags = lexical.per_text(of_docs(spark, docs), "text", ["doc_id"], "n long, bag binary", lexical._bags(vocab))
    rows = bags.selectExpr("row.doc_id as id", "n", "bag").where("n > 0")
    n, total = rows.count(), rows.agg({"n": "sum"}).first()[0]
    got = lexical._classes(rows, n, total, 3).collect()
    own = {}
    for i, t in docs:
        if b := Counter(w for w in words(t) if w in ("the", "w1", "w2")):
            own.setdefault((10 + 90 * len(words(t)) * n // total, tuple(sorted(b.items()))), []).append(i)
    assert sorted(((r["m"], r["ids"]) for r in got), key=repr) == sorted(((m, sorted(v, key=lambda x: (x is None, x or 0))[:3]) for (m, _), v in own.items()), key=repr)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 10)) @ rng.standard_normal((10, 10)) * 0.2
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(400, None), (401, [None] + [0.1] * 9), (402, [float("nan")] * 10), (403, [float("-inf")] * 10)]
    rows += [(404, [0.5] * 4), (None, [0.25] * 10), (5, rows[5][1])]
    df = make(spark, rows)
    w = whitening.fit(df, components=8)
    out, error = whitening.whiten(df, w, carry=["vec_id", "row"])
    kept = [(i, v) for i, v in rows if good(v) and len(v) == 10]
    q = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(int) + 100_000
    n, s = len(q), q.sum(axis=0)
    centred = q - s / n
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    assert w.n == n and np.allclose(w.values, e[:8], rtol=1e-12) and np.allclose(w.explained, e[:8] / e.sum(), rtol=1e-12)
    assert np.allclose(np.abs((w.vectors * vec[:, :8]).sum(axis=0)), 1, atol=1e-12) and error < 1e-10
    got = sorted((r["row"]["vec_id"] is None, r["row"]["vec_id"] or 0, r["deviation"], r["whitened"]) for r in out.collect())
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in q]
    want = sorted((i is None, i or 0, d, (c @ w.vectors / np.sqrt(w.values)).tolist()) for (i, _), d, c in zip(kept, exact, centred))
    assert [g[:3] for g in got] == [x[:3] for x in want]
    assert np.allclose([g[3] for g in got], [x[3] for x in want], atol=1e-9)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(20)]):
        w = whitening.fit(make(spark, rows))
        out, error = whitening.whiten(make(spark, rows), w)
        assert len(w.values) == 0 and error is None and out.count() == sum(good(v) for _, v in rows)
    flat = [(i, [0.1 * (i % 7), 0.2 * (i % 7) if i % 2 else 0.0, 0.5]) for i in range(50)]  # no variance in one dimension
    w = whitening.fit(make(spark, flat))
    assert len(w.values) == 2 and whitening.whiten(make(spark, flat), w)[1] < 1e-10


def test_deviation_beyond_64_bits():
    w = whitening.Whitening(10**9, np.array([5, 5]), np.array([1, 2]), np.zeros(0), np.zeros((2, 0)), 1.0, 1.0, 0)
    y = np.array([[1, -1], [40, 50]])
    assert whitening._deviations(y, w) == [(10**9 - 1) ** 2 + (10**9 + 2) ** 2, None]


def test_eigen():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    for values in (rng.uniform(0, 1e6, 24), np.repeat([7.0, 3.0, 0.0], 8), np.r_[1.0, np.full(23, 1e-9)], np.ones(24), np.zeros(24)):
        v = q * values @ q.T
        e, u = whitening.eigen((v + v.T) / 2)
        top = max(values.max(), 1e-300)
        assert np.allclose(e, np.sort(values)[::-1], atol=1e-13 * top) and np.allclose(u.T @ u, np.eye(24), atol=1e-13)
        assert np.abs(v @ u - u * e).max() <= 1e-13 * top


def test_queries_of_vectors(spark):
    got = queries.op13_whitening(spark, DATA).toPandas()
    assert set(got["component"]) == set(range(1, 9)) and (got.groupby("vec_id").size() == 8).all() and got["identity_error"].max() < 1e-4
    assert found(queries.op11_topk(spark, DATA)) == nearest([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()],
        [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 100 = 0").collect()], 10)
    docs, bench = ([(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(queries.op12_lexical(spark, DATA)) == ranked(docs, bench, 10)
