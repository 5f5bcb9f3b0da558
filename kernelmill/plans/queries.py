"""The registered queries of the string-kernel operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions import similarity as S
from ..operators import centering, design, kernels, learn, report, spectrum, svm, tabled
from ..operators import weights as W
from ..params import KernelParams
from ..shared import materialized, shared_dir
from ..sources.tables import normalize_descriptors, read_descriptors, read_labelled, write_table
from . import inputs as I
from .inputs import EV, LETTERS, PL
from .inputs import grams as sql_grams

_MEANS_SQL = "m AS (SELECT CAST(label AS VARCHAR) AS letter, i, avg(x::DOUBLE) AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2)"
QUERIES: dict = {}
SQL: dict[str, str] = {}
EVENT = KernelParams(1.5, 1.2, 2)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- the flagship: weights from labelled strings, scores of all strings, the best of them --------------------------------

_W2 = f"""g AS {sql_grams("ev", 2, "id, y")}, c AS (SELECT pos, gram, sum(y) AS c FROM g GROUP BY 1, 2),
w AS (SELECT p AS pos, gram, sum(c * exp(-((p - pos) ** 2) / 4.5)) AS w FROM c, (SELECT unnest(range(0, n)) AS p FROM (SELECT max(length(seq)) - 1 AS n FROM ev)) GROUP BY 1, 2)"""


def _event_weights(spark: SparkSession, d: str, n: int = 2) -> DataFrame:
    """Weights for strings as long as the longest."""
    s = I.event_strings(spark, d)
    longest = G.length_range(s).first()["max_len"]
    return W.exact_gram_weights(s.withColumnRenamed("y", "coef"), 1.5, n, max(n, longest))


@query(f"""WITH {EV}, {_W2} SELECT g.id, round(sum(w.w) / 1000, 6) AS score FROM g JOIN w ON g.pos = w.pos AND g.gram = w.gram
GROUP BY g.id ORDER BY round(sum(w.w) / 1000, 6) DESC, g.id LIMIT 20""")
def screen_top20(spark: SparkSession, d: str) -> DataFrame:
    scores = W.score_strings(_event_weights(spark, d), I.event_strings(spark, d))
    return design.rank_candidates(scores.select("id", r6(F.col("score") / 1000).alias("score")), 20)


@query(f"""WITH {EV}, {_W2} SELECT g.id, round(sum(w.w) / 1000, 6) AS score FROM g JOIN w ON g.pos = w.pos AND g.gram = w.gram GROUP BY g.id""")
def score_all_strings(spark: SparkSession, d: str) -> DataFrame:
    return W.score_strings(_event_weights(spark, d), I.event_strings(spark, d)).select("id", r6(F.col("score") / 1000).alias("score"))


@query(f"""WITH {EV}, {_W2}, s AS (SELECT g.id, round(sum(w.w) / 1000, 6) AS score FROM g JOIN w ON g.pos = w.pos AND g.gram = w.gram GROUP BY g.id)
SELECT id // 1000 AS user_id, id, score, CAST(row_number() OVER (PARTITION BY id // 1000 ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 2""")
def best_string_of_each_user(spark: SparkSession, d: str) -> DataFrame:
    scores = score_all_strings(spark, d).withColumn("user_id", F.floor(F.col("id") / 1000))
    return design.rank_candidates(scores, 2, by="user_id")


# -- sources and sinks -----------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT seq, count(*) AS n, round(sum(y), 4) AS y FROM ev GROUP BY 1")
def labelled_strings_read_back(spark: SparkSession, d: str) -> DataFrame:
    """All strings and their values, written as tab-separated text and read again."""
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    I.event_strings(spark, d).select("seq", "y").write.csv(path, sep="\t", quote="")
    return read_labelled(spark, path).groupBy("seq").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("y"))


@query(f"WITH {_MEANS_SQL} SELECT letter, CAST(dense_rank() OVER (ORDER BY letter) - 1 AS INTEGER) AS letter_idx, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM m")
def descriptors_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding label's mean vector, written as a text file of blank-separated columns and read again."""
    path = f"{shared_dir(spark)}/descriptors-{uuid.uuid4().hex}"
    line = F.concat_ws("  ", "letter", F.array_join(F.transform("descriptors", lambda x: x.cast("string")), " \t"))
    I.label_letters(spark, d).select(line.alias("value"), "letter").coalesce(1).sortWithinPartitions("letter").select("value").write.text(path)
    return read_descriptors(spark, path).select("letter", "letter_idx", F.posexplode("descriptors").alias("i", "x")).withColumn("x", r6("x"))


@query(f"WITH {EV} SELECT id, seq, round(y, 6) AS y, CAST(length(seq) AS INTEGER) AS len FROM ev")
def table_read_back(spark: SparkSession, d: str) -> DataFrame:
    """All strings, written as Parquet in folders by length and read again."""
    path = f"{shared_dir(spark)}/by-length-{uuid.uuid4().hex}"
    write_table(I.event_strings(spark, d).withColumn("len", F.length("seq")), path, ["len"])
    return spark.read.parquet(path).select("id", "seq", r6("y").alias("y"), "len")


# -- strings, letters, grams ---------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2)
SELECT CAST(label AS VARCHAR) AS letter, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def normalized_descriptors(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize_descriptors(I.label_letters(spark, d)).select("letter", F.posexplode("descriptors").alias("i", "x"))
    return rows.select("letter", "i", r6("x").alias("x"))


@query(f"WITH {EV} SELECT id, translate(seq, 'CEPSV', '01234') AS codes FROM ev")
def encoded_strings(spark: SparkSession, d: str) -> DataFrame:
    coded = G.encode(I.event_strings(spark, d), I.event_letters(spark))
    return coded.select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), "").alias("codes"))


@query(f"WITH {EV} SELECT id, seq FROM ev")
def decoded_strings(spark: SparkSession, d: str) -> DataFrame:
    coded = G.encode(I.event_strings(spark, d), I.event_letters(spark)).select("id", "codes")
    return G.decode(coded, I.event_letters(spark)).select("id", "seq")


@query(f"WITH {EV} SELECT id, CAST(length(seq) AS INTEGER) AS len FROM ev")
def string_lengths(spark: SparkSession, d: str) -> DataFrame:
    return G.seq_length(I.event_strings(spark, d)).select("id", "len")


@query(f"WITH {EV} SELECT CAST(min(length(seq)) AS INTEGER) AS min_len, CAST(max(length(seq)) AS INTEGER) AS max_len FROM ev")
def string_length_range(spark: SparkSession, d: str) -> DataFrame:
    return G.length_range(I.event_strings(spark, d))


@query("""SELECT p_partkey AS id, NOT regexp_matches(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]') AS valid FROM part""")
def strings_by_validity(spark: SparkSession, d: str) -> DataFrame:
    letters = spark.createDataFrame([(c, i) for i, c in enumerate("ACDEFGHIKLMNPQRSTVWY")], "letter string, letter_idx int")
    p = I.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("seq"))
    good, bad = G.split_valid(p, letters)
    return good.select("id", F.lit(True).alias("valid")).unionByName(bad.select("id", F.lit(False).alias("valid")))


@query(f"""WITH {PL}, l AS (SELECT letter, row_number() OVER (ORDER BY letter) - 1 AS i FROM pl), n AS (SELECT count(*) AS n FROM l)
SELECT x.letter || y.letter AS gram, CAST(x.i * n + y.i AS BIGINT) AS gram_idx FROM l x, l y, n""")
def dictionary_of_grams(spark: SparkSession, d: str) -> DataFrame:
    return G.gram_dictionary(I.part_letters(spark, d), 2)


@query(f"WITH {EV} SELECT id, gram, CAST(count(*) AS DOUBLE) AS value FROM {sql_grams('ev', 2)} GROUP BY 1, 2")
def counted_grams(spark: SparkSession, d: str) -> DataFrame:
    return G.gram_counts(I.event_strings(spark, d), 2)


@query(f"WITH {EV} SELECT id, CAST(pos AS INTEGER) AS pos, gram, 1.0::DOUBLE AS value FROM {sql_grams('ev', 3)}")
def grams_by_position(spark: SparkSession, d: str) -> DataFrame:
    return G.positional_grams(I.event_strings(spark, d), 3)


@query(f"WITH {EV} " + " UNION ALL ".join(f"SELECT id, {n} AS n, gram, CAST(count(*) AS DOUBLE) AS value FROM {sql_grams('ev', n)} GROUP BY 1, 3" for n in (1, 2, 3)))
def feature_range(spark: SparkSession, d: str) -> DataFrame:
    return G.gram_features(I.event_strings(spark, d), 1, 3, positional=False)


_SELF = f"""f AS ({" UNION ALL ".join(f"SELECT id, {n} AS n, pos, gram FROM {sql_grams('ev', n)}" for n in (1, 2))}),
k AS (SELECT x.id, sum(exp(-((x.pos - z.pos) ** 2) / 4.5)) AS k FROM f x JOIN f z ON x.id = z.id AND x.n = z.n AND x.gram = z.gram GROUP BY 1)"""


@query(f"WITH {EV}, {_SELF} SELECT id, round(k, 6) AS k FROM k")
def exact_self_kernel(spark: SparkSession, d: str) -> DataFrame:
    return kernels.exact_self(I.event_strings(spark, d), 1.5, 1, 2).select("id", r6("k").alias("k"))


@query(f"WITH {EV}, {_SELF} SELECT id, CAST(n AS INTEGER) AS n, CAST(pos AS INTEGER) AS pos, gram, round(1 / sqrt(k), 6) AS value FROM f JOIN k USING (id)")
def normalized_grams(spark: SparkSession, d: str) -> DataFrame:
    s = I.event_strings(spark, d)
    feats = G.normalize_features(G.gram_features(s, 1, 2), kernels.exact_self(s, 1.5, 1, 2))
    return feats.withColumn("value", r6("value"))


@query(f"""WITH {EV} SELECT id, CAST(pos AS INTEGER) AS pos, gram,
CAST(pos * 25 + 5 * (strpos('CEPSV', gram[1]) - 1) + strpos('CEPSV', gram[2]) - 1 AS BIGINT) AS col_idx FROM {sql_grams('ev', 2)}""")
def gram_columns(spark: SparkSession, d: str) -> DataFrame:
    feats = G.positional_grams(I.event_strings(spark, d), 2).drop("value")
    return G.gram_column_index(feats, I.event_letters(spark), 2)


# -- similarities and kernels ----------------------------------------------------------------------------------------

_MEANS = "m AS (SELECT CAST(label AS VARCHAR) AS l, i, avg(x::DOUBLE) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2), s AS (SELECT p.l AS a, q.l AS b, sum((p.x - q.x) ** 2) AS v FROM m p JOIN m q ON p.i = q.i GROUP BY 1, 2)"


@query(f"WITH {_MEANS} SELECT a, b, round(v, 6) AS distance FROM s")
def distances_of_letters(spark: SparkSession, d: str) -> DataFrame:
    return S.letter_distance(I.label_letters(spark, d)).select("a", "b", r6("distance").alias("distance"))


@query(f"WITH {_MEANS} SELECT a, b, round(exp(-v / 0.5), 6) AS sim FROM s")
def similarity_of_letters(spark: SparkSession, d: str) -> DataFrame:
    return S.letter_similarity(I.label_letters(spark, d), 0.5).select("a", "b", r6("sim").alias("sim"))


@query(f"""WITH {EV}, n AS (SELECT max(length(seq)) AS n FROM ev), p AS (SELECT unnest(range(0, n)) AS i FROM n)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(exp(-((a.i - b.i) ** 2) / 8.0), 6) AS weight FROM p a, p b""")
def similarity_of_positions(spark: SparkSession, d: str) -> DataFrame:
    n = G.length_range(I.event_strings(spark, d)).first()["max_len"]
    return S.position_similarity(spark, n, 2.0).withColumn("weight", r6("weight"))


@query(f"""WITH {EV}, n AS (SELECT max(length(seq)) AS n FROM ev), p AS (SELECT unnest(range(0, n)) AS i FROM n)
SELECT CAST(i AS INTEGER) AS j, round(exp(-((i - 2) ** 2) / 8.0), 6) AS weight FROM p""")
def weights_of_position(spark: SparkSession, d: str) -> DataFrame:
    n = G.length_range(I.event_strings(spark, d)).first()["max_len"]
    return S.position_weights(spark, 2, n, 2.0).withColumn("weight", r6("weight"))


# Kernels of the strings whose id is divisible by 100 with all strings; of a symmetric kernel these are rows.
_E_SIM = f"{LETTERS}, sim AS (SELECT x.letter AS a, z.letter AS b, exp(-((x.d[1]-z.d[1])**2 + (x.d[2]-z.d[2])**2 + (x.d[3]-z.d[3])**2) / 2.88) AS s FROM letters x, letters z)"
_CELLS = "sum(exp(-((x.pos - z.pos) ** 2) / 4.5) * s.s * (1 + coalesce(t.s, 0)))"
_SIMS = "JOIN sim s ON s.a = x.c AND s.b = z.c LEFT JOIN sim t ON t.a = x.c2 AND t.b = z.c2"
_OWN = f"""{EV}, {_E_SIM},
l AS (SELECT id, i - 1 AS pos, seq[i] AS c, CASE WHEN i < length(seq) THEN seq[i + 1] END AS c2 FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM ev)),
own AS (SELECT x.id, {_CELLS} AS k FROM l x JOIN l z ON x.id = z.id {_SIMS} GROUP BY 1)"""
_PAIR = f"{_OWN}, k AS (SELECT x.id AS id_a, z.id AS id_b, {_CELLS} AS k FROM l x CROSS JOIN l z {_SIMS} WHERE x.id % 100 = 0 GROUP BY 1, 2)"
_NORM = "nk AS (SELECT k.id_a, k.id_b, k.k / sqrt(a.k * b.k) AS k FROM k JOIN own a ON a.id = k.id_a JOIN own b ON b.id = k.id_b)"
# mean kernels of each string with all, from sums over their letters at each place
_SUMS = """ag AS (SELECT pos, c, c2, sum(1 / sqrt(own.k)) AS v FROM l JOIN own USING (id) GROUP BY ALL),
mn AS (SELECT x.id, sum(z.v * exp(-((x.pos - z.pos) ** 2) / 4.5) * s.s * (1 + coalesce(t.s, 0))) / any_value(sqrt(own.k)) / (SELECT count(*) FROM ev) AS m
  FROM l x JOIN own ON own.id = x.id CROSS JOIN ag z JOIN sim s ON s.a = x.c AND s.b = z.c LEFT JOIN sim t ON t.a = x.c2 AND t.b = z.c2 GROUP BY 1),
st AS (SELECT avg(m) AS mean_k, 1 - avg(m) AS variance FROM mn)"""
COSINE = KernelParams(1.5, 1.2, 2, True)


def _k6(df: DataFrame) -> DataFrame:
    return df.withColumn("k", r6("k"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The strings whose id is divisible by 100, all strings, and the letters."""
    s = materialized(I.event_strings(spark, d), "strings")
    return s.where("id % 100 = 0"), s, I.event_letters(spark)


@query(f"WITH {_PAIR} SELECT id_a, id_b, round(k, 6) AS k FROM k")
def kernel_of_two_tables(spark: SparkSession, d: str) -> DataFrame:
    few, every, letters = _sides(spark, d)
    return kernels.gs_gram(few, letters, EVENT, every, digits=6)


@query(f"WITH {_PAIR} SELECT id_a, id_b, round(k, 6) AS k FROM k")
def kernel_of_one_table(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the symmetric kernel of all strings whose id is divisible by 100."""
    _, every, letters = _sides(spark, d)
    return kernels.gs_gram(every, letters, EVENT, rows=F.expr("id % 100 = 0"), digits=6)


@query(f"WITH {_OWN} SELECT id, round(k, 6) AS k FROM own")
def self_kernel(spark: SparkSession, d: str) -> DataFrame:
    return _k6(kernels.gs_self(I.event_strings(spark, d), I.event_letters(spark), EVENT))


@query(f"WITH {_PAIR}, {_NORM} SELECT id_a, id_b, round(k, 6) AS k FROM nk")
def normalized_kernel(spark: SparkSession, d: str) -> DataFrame:
    few, every, letters = _sides(spark, d)
    return kernels.gs_gram(few, letters, COSINE, every, digits=6)


@query(f"""WITH {_PAIR}, {_NORM} SELECT id_a, id_b, round(k, 6) AS k, CAST(row_number() OVER (PARTITION BY id_a ORDER BY round(k, 9) DESC, id_b) AS INTEGER) AS rank FROM nk QUALIFY rank <= 3""")
def nearest_strings(spark: SparkSession, d: str) -> DataFrame:
    few, every, letters = _sides(spark, d)
    return _k6(kernels.neighbors(few, every, letters, COSINE, k=3))


@query(f"WITH {_PAIR}, {_NORM} SELECT id_a, id_b, round(k, 6) AS k FROM nk WHERE k >= 0.9")
def strings_within(spark: SparkSession, d: str) -> DataFrame:
    few, every, letters = _sides(spark, d)
    return _k6(kernels.neighbors(few, every, letters, COSINE, min_sim=0.9)).drop("rank")


@query(f"""WITH {EV}, f AS ({" UNION ALL ".join(f"SELECT id, {n} AS n, pos, gram FROM {sql_grams('ev', n)}" for n in (1, 2, 3))})
SELECT x.id AS id_a, z.id AS id_b, round(sum(exp(-((x.pos - z.pos) ** 2) / 8.0)), 6) AS k FROM f x JOIN f z ON x.n = z.n AND x.gram = z.gram WHERE x.id % 100 = 0 GROUP BY 1, 2""")
def exact_kernel(spark: SparkSession, d: str) -> DataFrame:
    few, every, _ = _sides(spark, d)
    return kernels.exact_gram(few, every, 2.0, 1, 3, digits=6)


@query(f"""WITH {_OWN}, {_SUMS} SELECT round(mean_k, 6) AS mean_k, round(variance, 6) AS variance, round(avg(y), 6) AS y_mean, round(stddev_pop(y), 6) AS y_std FROM st, ev GROUP BY 1, 2""")
def centering_statistics(spark: SparkSession, d: str) -> DataFrame:
    _, every, letters = _sides(spark, d)
    means = centering.kernel_means(every, letters, COSINE)
    return centering.centering_stats_of(every, means).select(*[r6(c).alias(c) for c in ("mean_k", "variance", "y_mean", "y_std")])


@query(f"""WITH {_PAIR}, {_NORM}, {_SUMS} SELECT id_a, id_b, round((nk.k - x.m - z.m + mean_k) / variance, 6) AS k FROM st, nk JOIN mn x ON x.id = id_a JOIN mn z ON z.id = id_b""")
def centered_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the centred kernel of all strings whose id is divisible by 100."""
    few, every, letters = _sides(spark, d)
    means = materialized(centering.kernel_means(every, letters, COSINE), "means")
    few, every, stats = few.join(means, "id"), every.join(means, "id"), centering.centering_stats_of(every, means).first()
    return kernels.gs_gram(few, letters, COSINE, every, centre=(stats["mean_k"], stats["variance"]), digits=6)


# -- weights ---------------------------------------------------------------------------------------------------------

_E_W = f"""{EV}, {_E_SIM}, p AS (SELECT unnest(range(0, 5)) AS p),
w1 AS (SELECT p AS pos, a AS gram, sum(y * exp(-((p - pos) ** 2) / 4.5) * s) AS w FROM {sql_grams("ev", 1, "y")} g JOIN sim ON b = gram, p GROUP BY 1, 2),
c2 AS (SELECT pos, gram, sum(y) AS y FROM {sql_grams("ev", 2, "y")} GROUP BY 1, 2),
w2 AS (SELECT p AS pos, s.a || t.a AS gram, sum(y * exp(-((p - pos) ** 2) / 4.5) * s.s * t.s) AS w FROM c2 JOIN sim s ON s.b = gram[1] JOIN sim t ON t.b = gram[2], p WHERE p < 4 GROUP BY 1, 2),
w AS (SELECT w2.pos, w2.gram, w1.w + w2.w AS w FROM w2 JOIN w1 ON w1.pos = w2.pos AND w1.gram = w2.gram[1]),
wl AS (SELECT w.pos, w.gram, w.w + CASE WHEN w.pos = 3 THEN w1.w ELSE 0 END AS w FROM w LEFT JOIN w1 ON w1.pos = 4 AND w1.gram = w.gram[2])"""


def _coef(spark, d):
    return I.event_strings(spark, d).withColumnRenamed("y", "coef")


def _weights(spark: SparkSession, d: str, fold: bool = True) -> DataFrame:
    """Weights of two-letter grams for strings of five, scaled to thousands."""
    w = W.gram_weights(_coef(spark, d), I.event_letters(spark), EVENT, 5, fold)
    return materialized(w.withColumn("w", F.col("w") / 1000), "weights")


@query(f"WITH {_E_W} SELECT CAST(pos AS INTEGER) AS pos, gram, round(w / 1000, 6) AS w FROM w")
def weights_of_grams(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, False).select("pos", "gram", r6("w").alias("w"))


@query(f"WITH {_E_W} SELECT CAST(pos AS INTEGER) AS pos, gram, round(w / 1000, 6) AS w FROM wl")
def weights_with_last_folded(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).select("pos", "gram", r6("w").alias("w"))


@query(f"WITH {_OWN} SELECT id, round(y / sqrt(k), 6) AS coef FROM ev JOIN own USING (id)")
def coefficients_normalized(spark: SparkSession, d: str) -> DataFrame:
    return W.normalized_coef(_coef(spark, d), I.event_letters(spark), EVENT).select("id", r6("coef").alias("coef"))


@query(f"WITH {EV}, {_W2} SELECT CAST(pos AS INTEGER) AS pos, gram, round(w / 1000, 6) AS w FROM w")
def exact_weights(spark: SparkSession, d: str) -> DataFrame:
    return _event_weights(spark, d).select("pos", "gram", r6(F.col("w") / 1000).alias("w"))


_X_W = f"""{EV}, {LETTERS}, p AS (SELECT unnest(range(0, 6)) AS p), g3 AS (SELECT x.letter || y.letter || z.letter AS gram FROM letters x, letters y, letters z),
w AS ({" UNION ALL ".join(f"SELECT {n} AS n, p AS pos, gram, sum(y * exp(-((p - pos) ** 2) / 4.5)) / 1000 AS w FROM {sql_grams('ev', n, 'y')}, p WHERE p <= {{L}} - {n} GROUP BY 2, 3" for n in (1, 2, 3))})"""


def _lengths(spark: SparkSession, d: str, length: int) -> DataFrame:
    parts = [W.exact_gram_weights(_coef(spark, d), 1.5, n, length) for n in (1, 2, 3)]
    w = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return materialized(w.withColumn("w", F.col("w") / 1000), "lengths")


@query(f"""WITH {_X_W.replace("{L}", "5")} SELECT CAST(q.p AS INTEGER) AS pos, g3.gram, round(coalesce(sum(w.w), 0), 6) AS w FROM g3, (SELECT p FROM p WHERE p < 3) q
LEFT JOIN w ON w.pos = q.p AND w.gram = g3.gram[1 : w.n] GROUP BY 1, 2""")
def weights_rolled_up(spark: SparkSession, d: str) -> DataFrame:
    return W.rollup_weights(_lengths(spark, d, 5), 1, 3, 5, I.event_letters(spark)).select("pos", "gram", r6("w").alias("w"))


@query(f"""WITH {_X_W.replace("{L}", "5")}, ask AS (SELECT DISTINCT gram FROM {sql_grams("ev", 3)})
SELECT CAST(q.p AS INTEGER) AS pos, ask.gram, round(coalesce(sum(w.w), 0), 6) AS w FROM ask, (SELECT p FROM p WHERE p < 3) q LEFT JOIN w ON w.pos = q.p AND w.gram = ask.gram[1 : w.n] GROUP BY 1, 2""")
def weights_of_asked_grams(spark: SparkSession, d: str) -> DataFrame:
    """Rolled-up weights of the grams that occur, without a table of all grams."""
    asked = G.positional_grams(I.event_strings(spark, d), 3).select("gram").distinct()
    return W.rollup_weights(_lengths(spark, d, 5), 1, 3, 5, None, asked).select("pos", "gram", r6("w").alias("w"))


def _ends_sql(size: int) -> str:
    steps = [(n, size - 3 + 1 + i, i) for n in (1, 2, 3) for i in range(3 - n)]
    rows = ", ".join(map(str, steps))
    return f"SELECT {size} AS length, g3.gram, round(sum(coalesce(w.w, 0)), 6) AS w FROM g3 CROSS JOIN (VALUES {rows}) t(n, pos, i) LEFT JOIN w ON w.n = t.n AND w.pos = t.pos AND w.gram = substr(g3.gram, t.i + 2, t.n) GROUP BY 1, 2"


@query(f"WITH {_X_W.replace('{L}', '5')} SELECT gram, w FROM ({_ends_sql(5)})")
def weights_past_the_end(spark: SparkSession, d: str) -> DataFrame:
    return W.end_weights(_lengths(spark, d, 5), 1, 3, 5, I.event_letters(spark)).select("gram", r6("w").alias("w"))


@query(f"WITH {_X_W.replace('{L}', '6')} " + " UNION ALL ".join(_ends_sql(n) for n in (4, 5, 6)))
def weights_over_lengths(spark: SparkSession, d: str) -> DataFrame:
    _, ends = W.weights_in_range(_lengths(spark, d, 6), 1, 3, 4, 6, I.event_letters(spark))
    return ends.select("length", "gram", r6("w").alias("w"))


# -- best strings ----------------------------------------------------------------------------------------------------

_ALL5 = "a AS (SELECT " + " || ".join(f"l{i}.letter" for i in range(5)) + " AS seq FROM " + ", ".join(f"letters l{i}" for i in range(5)) + ")"
_SCORED = f"""{_E_W}, {_ALL5}, s AS (SELECT seq, {" + ".join(f"w{i}x.w" for i in range(4))} AS score FROM a
{" ".join(f"JOIN wl w{i}x ON w{i}x.pos = {i} AND w{i}x.gram = substr(seq, {i + 1}, 2)" for i in range(4))})"""
_ROUND = "round(score / 1000, 6) AS score"


@query(f"""WITH {_E_W}, r AS (SELECT pos AS layer, gram, w AS score FROM wl WHERE pos = 0), {", ".join(
    f"r{p} AS (SELECT {p} AS layer, wl.gram, max(x.score) + wl.w AS score FROM {'r' if p == 1 else f'r{p - 1}'} x JOIN wl ON wl.pos = {p} AND wl.gram[1] = x.gram[2] GROUP BY wl.gram, wl.w)" for p in (1, 2, 3))}
SELECT CAST(layer AS INTEGER) AS layer, gram, {_ROUND} FROM (SELECT * FROM r UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""")
def best_by_layer(spark: SparkSession, d: str) -> DataFrame:
    return design.layer_max(_weights(spark, d), 5).select("layer", "gram", r6("score").alias("score"))


@query(f"WITH {_SCORED} SELECT seq, {_ROUND} FROM s ORDER BY s.score DESC, seq LIMIT 1")
def best_designed_string(spark: SparkSession, d: str) -> DataFrame:
    return design.best_string(_weights(spark, d), 5).select("seq", r6("score").alias("score"))


@query(f"WITH {_SCORED} SELECT CAST(row_number() OVER (ORDER BY s.score DESC, seq) AS INTEGER) AS rank, seq, {_ROUND} FROM s QUALIFY rank <= 50")
def fifty_best_strings(spark: SparkSession, d: str) -> DataFrame:
    return design.k_best_strings(_weights(spark, d), 5, 50).select("rank", "seq", r6("score").alias("score"))


@query(f"""WITH {_SCORED}, q AS (SELECT DISTINCT seq[1:2] AS prefix FROM ev WHERE length(seq) >= 2)
SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY s.score DESC, s.seq) AS INTEGER) AS rank, s.seq, {_ROUND} FROM s JOIN q ON s.seq[1:2] = q.prefix QUALIFY rank <= 3""")
def best_completions(spark: SparkSession, d: str) -> DataFrame:
    p = I.event_strings(spark, d).where("length(seq) >= 2").select(F.substring("seq", 1, 2).alias("prefix")).distinct()
    got = design.complete_prefix(_weights(spark, d), p.withColumn("prefix_id", F.col("prefix")), 5, 3)
    return got.select(F.col("prefix_id").alias("prefix"), "rank", "seq", r6("score").alias("score"))


@query(f"""WITH {_SCORED} SELECT CAST(row_number() OVER (ORDER BY s.score DESC, seq) AS INTEGER) AS rank, seq, {_ROUND} FROM s
WHERE seq[1:2] <> 'VV' AND seq[4:5] <> 'CC' AND seq[2:4] <> 'VPC' QUALIFY rank <= 20""")
def best_strings_without(spark: SparkSession, d: str) -> DataFrame:
    no = spark.createDataFrame([(0, "VV"), (3, "CC"), (1, "VPC")], "pos int, gram string")
    return design.k_best_strings(_weights(spark, d), 5, 20, forbidden=no).select("rank", "seq", r6("score").alias("score"))


def _range_sql() -> str:
    parts = []
    for size in (4, 5, 6):
        letters = ", ".join(f"letters l{i}" for i in range(size))
        terms = [f"coalesce((SELECT w FROM w WHERE w.n = {n} AND w.pos = {p} AND w.gram = substr(seq, {p + 1}, {n})), 0)" for n in (1, 2, 3) for p in range(size - n + 1)]
        parts.append(f"SELECT {size} AS length, seq, ({' + '.join(terms)}) / sqrt({sum(size - n + 1 for n in (1, 2, 3))}) AS v FROM (SELECT {' || '.join(f'l{i}.letter' for i in range(size))} AS seq FROM {letters})")
    return " UNION ALL ".join(parts)


@query(f"WITH {_X_W.replace('{L}', '6')} SELECT CAST(length AS INTEGER) AS length, seq, round(v, 6) AS value FROM ({_range_sql()}) ORDER BY v DESC, length LIMIT 1")
def best_string_over_lengths(spark: SparkSession, d: str) -> DataFrame:
    weights, ends = W.weights_in_range(_lengths(spark, d, 6), 1, 3, 4, 6, I.event_letters(spark))
    best = design.best_string_in_range(materialized(weights, "rolled"), materialized(ends, "ends"), 4, 6, 1, True)
    return best.select("length", "seq", r6("value").alias("value"))


def _centred_coefs(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq, coef): the strings' values less their mean, in thousands."""
    s = I.event_strings(spark, d)
    mean = s.agg(F.avg("y").alias("m"))
    return s.crossJoin(F.broadcast(mean)).select("id", "seq", ((F.col("y") - F.col("m")) / 1000).alias("coef"))


def _centred_weights(spark: SparkSession, d: str, length: int) -> DataFrame:
    return materialized(W.gram_weights(_centred_coefs(spark, d), I.event_letters(spark), EVENT, length, True), "weights")


def _designs_sql(sizes: tuple[int, ...], coef: str = "(y - avg(y) OVER ()) / 1000", exact: bool = False) -> str:
    """Table d (seq, score, norm) of all strings of the given lengths: scores by the model of coefficients coef, and the kernel with itself."""
    every = " UNION ALL ".join(f"SELECT {' || '.join(f'l{i}.letter' for i in range(n))} AS seq FROM {', '.join(f'letters l{i}' for i in range(n))}" for n in sizes)
    same = "CASE WHEN {0} = {1} THEN 1.0 ELSE 0.0 END"
    cell = f"{same.format('x.c', 'z.c')} * (1 + CASE WHEN x.c2 = z.c2 THEN 1.0 ELSE 0.0 END)" if exact else "s.s * (1 + coalesce(t.s, 0))"
    return f"""{_OWN}, cf AS (SELECT ev.id, seq, {coef} AS y FROM ev JOIN own USING (id)), pz AS (SELECT unnest(range(0, {max(sizes)})) AS p),
v1 AS (SELECT p AS pos, a AS gram, sum(y * exp(-((p - pos) ** 2) / 4.5) * s) AS w FROM (SELECT pos, gram, sum(y) AS y FROM {sql_grams("cf", 1, "y")} GROUP BY 1, 2) JOIN sim ON b = gram, pz GROUP BY 1, 2),
v2 AS (SELECT p AS pos, s.a || t.a AS gram, sum(y * exp(-((p - pos) ** 2) / 4.5) * s.s * t.s) AS w FROM (SELECT pos, gram, sum(y) AS y FROM {sql_grams("cf", 2, "y")} GROUP BY 1, 2) JOIN sim s ON s.b = gram[1] JOIN sim t ON t.b = gram[2], pz GROUP BY 1, 2),
a AS ({every}), m AS (SELECT seq, i - 1 AS pos, seq[i] AS c, CASE WHEN i < length(seq) THEN seq[i + 1] END AS c2 FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM a)),
sc AS (SELECT m.seq, sum(v1.w + coalesce(v2.w, 0)) AS score FROM m JOIN v1 ON v1.pos = m.pos AND v1.gram = m.c LEFT JOIN v2 ON v2.pos = m.pos AND v2.gram = m.c || m.c2 GROUP BY 1),
nm AS (SELECT x.seq, sum(exp(-((x.pos - z.pos) ** 2) / 4.5) * {cell}) AS norm FROM m x JOIN m z ON x.seq = z.seq {_SIMS} GROUP BY 1),
d AS (SELECT * FROM sc JOIN nm USING (seq))"""


_BEST10 = "SELECT CAST(row_number() OVER (ORDER BY score / sqrt(norm) DESC, seq) AS INTEGER) AS rank, seq, round(score / sqrt(norm), 6) AS score, TRUE AS is_exact FROM d QUALIFY rank <= 10"


@query(f"WITH {_designs_sql((5,))} {_BEST10}")
def best_normalized_strings(spark: SparkSession, d: str) -> DataFrame:
    return design.k_best_normalized(_centred_weights(spark, d, 5), I.event_letters(spark), EVENT, 5, 10).withColumn("score", r6("score"))


@query(f"WITH {_designs_sql((5,), exact=True)} {_BEST10}")
def best_normalized_by_matches(spark: SparkSession, d: str) -> DataFrame:
    found = design.k_best_normalized(_centred_weights(spark, d, 5), I.event_letters(spark), EVENT, 5, 10, kernel="exact")
    return found.withColumn("score", r6("score"))


@query(f"WITH {_designs_sql((3, 4, 5))} SELECT seq, round(score / sqrt(norm), 6) AS score, CAST(length(seq) AS INTEGER) AS length, TRUE AS is_exact FROM d ORDER BY score / sqrt(norm) DESC, length(seq), seq LIMIT 1")
def best_normalized_over_lengths(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: _centred_weights(spark, d, n) for n in (3, 4, 5)}
    return design.best_normalized_in_range(tables, I.event_letters(spark), EVENT).withColumn("score", r6("score"))


@query(f"WITH {_designs_sql((3, 4, 5), exact=True)} SELECT seq, round(norm - 2 * score, 6) AS distance, CAST(length(seq) AS INTEGER) AS length, TRUE AS is_exact FROM d ORDER BY norm - 2 * score, length(seq), seq LIMIT 1")
def least_distance_string(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: _centred_weights(spark, d, n) for n in (3, 4, 5)}
    return design.best_distance(tables, I.event_letters(spark), EVENT).withColumn("distance", r6("distance"))


@query(f"WITH {_designs_sql((5,), '(y - avg(y) OVER ()) / 1000 / sqrt(k)')} {_BEST10}")
def designed_from_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return design.design(_centred_coefs(spark, d), "coef", I.event_letters(spark), COSINE, 5, 10).withColumn("score", r6("score"))


# -- learning --------------------------------------------------------------------------------------------------------


@query()
def ridge_predictions(spark: SparkSession, d: str) -> DataFrame:
    s = I.event_strings(spark, d)
    model = learn.fit_ridge(s, I.event_letters(spark), KernelParams(1.5, 1.2, 2, True), 1.0, center=True)
    return learn.predict_ridge(model, s).select("id", r6("prediction").alias("prediction"))


@query()
def ridge_coefficients(spark: SparkSession, d: str) -> DataFrame:
    s = I.event_strings(spark, d)
    model = learn.fit_ridge(s, I.event_letters(spark), EVENT, 1.0)
    return learn.dual_coefficients(model, s).select("id", r6("coef").alias("coef"))


@query()
def ridge_targets(spark: SparkSession, d: str) -> DataFrame:
    s = I.event_strings(spark, d).withColumn("len", F.length("seq").cast("double")).withColumn("s", F.lit(0.5) + F.col("len"))
    model = learn.fit_ridge(s, I.event_letters(spark), EVENT, [1.0, 10.0], sample_weight="s", targets=["y", "len"])
    return learn.predict_ridge(model, s).select("id", "target", r6("prediction").alias("prediction"))


def _kernel_sums(spark: SparkSession, s: DataFrame, coef: DataFrame, params: KernelParams = EVENT) -> DataFrame:
    """(id, f): sums of coefficients times kernel over all strings, by weights of grams: another path than a fit and its predictions."""
    longest = G.length_range(s).first()["max_len"]
    w = W.length_weights(coef.join(s.select("id", "seq"), "id").select("id", "seq", "coef"), I.event_letters(spark), params, longest)
    return W.score_strings(materialized(w, "sums"), s).select("id", F.col("score").alias("f"))


@query(f"WITH {EV} SELECT id, t AS target, 0.0::DOUBLE AS residual FROM ev, (VALUES ('len'), ('y')) x(t)")
def ridge_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the equations (K + alpha / s) c = y of a weighted fit of two targets: zero for every string."""
    s = I.event_strings(spark, d).withColumn("len", F.length("seq").cast("double")).withColumn("s", F.lit(0.5) + F.col("len"))
    s = materialized(s.withColumn("y", F.col("y") / 1000), "ridge")
    alpha = {"y": 1.0, "len": 10.0}
    model = learn.fit_ridge(s, I.event_letters(spark), EVENT, list(alpha.values()), sample_weight="s", targets=list(alpha))
    coef = materialized(learn.dual_coefficients(model, s, "s"), "duals")
    out = None
    for t, a in alpha.items():
        own = coef.where(F.col("target") == t)
        rows = s.join(own, "id").join(_kernel_sums(spark, s, own), "id")
        rows = rows.select("id", "target", (F.round(F.col("f") + a * F.col("coef") / F.col("s") - F.col(t), 5) + 0.0).alias("residual"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {EV} SELECT id, 0.0::DOUBLE AS residual FROM ev")
def ridge_residuals_centred(spark: SparkSession, d: str) -> DataFrame:
    """The same of a fit with a centred kernel: (C + alpha) c = y - mean, where C c comes from sums over the plain kernel."""
    s = materialized(I.event_strings(spark, d).withColumn("y", F.col("y") / 1000), "ridge")
    model = learn.fit_ridge(s, I.event_letters(spark), EVENT, 1.0, center=True)
    coef = materialized(learn.dual_coefficients(model, s), "duals")
    ones = _kernel_sums(spark, s, s.select("id", F.lit(1.0).alias("coef")))
    own = kernels.gs_self(s, I.event_letters(spark), EVENT)
    n = s.count()
    variance = own.agg(F.avg("k")).first()[0] - ones.agg(F.avg("f")).first()[0] / n
    rows = s.join(coef, "id").join(_kernel_sums(spark, s, coef), "id")
    means = rows.agg(F.avg("f"), F.avg("y")).first()
    left = (F.col("f") - means[0]) / variance + F.col("coef") - (F.col("y") - means[1])
    return rows.select("id", (F.round(left, 5) + 0.0).alias("residual"))


@query(f"WITH {EV} SELECT id, 0.0::DOUBLE AS residual FROM ev")
def ridge_residuals_of_tables(spark: SparkSession, d: str) -> DataFrame:
    """The same of a weighted fit whose coefficients stay tables: (K + alpha / s) c = y."""
    s = I.event_strings(spark, d).withColumn("s", F.lit(0.5) + F.length("seq"))
    s = materialized(s.withColumn("y", F.col("y") / 1000), "ridge")
    model = tabled.fit_tabled(s, I.event_letters(spark), EVENT, 10.0, sample_weight="s", landmarks=256)
    coef = materialized(learn.dual_coefficients(model, s, "s"), "duals")
    rows = s.join(coef, "id").join(_kernel_sums(spark, s, coef), "id")
    return rows.select("id", (F.round(F.col("f") + 10 * F.col("coef") / F.col("s") - F.col("y"), 5) + 0.0).alias("residual"))


def _above_mean(spark: SparkSession, d: str) -> DataFrame:
    """The strings, with y 1 where their value is above the mean."""
    s = I.event_strings(spark, d)
    mean = s.agg(F.avg("y")).first()[0]
    return materialized(s.withColumn("y", (F.col("y") > mean).cast("double")), "classes")


@query()
def svm_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _above_mean(spark, d)
    return svm.predict_svm(svm.fit_svm(rows, I.event_letters(spark), COSINE, 1.0), rows)


@query(f"WITH {EV} SELECT id, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS balance, TRUE AS agrees FROM ev")
def svm_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the conditions of the least penalty: f - b = K c with c from the slopes of the loss, and sum c = 0, which decide a
    convex problem; and whether the class is the sign of f. Kernel sums come by weights of grams, another path than the fit's."""
    s = _above_mean(spark, d)
    model = svm.fit_svm(s, I.event_letters(spark), EVENT, 0.01)
    coef = materialized(svm.svm_coefficients(model, s).select("id", "coef"), "duals")
    total = coef.agg(F.sum("coef")).first()[0]
    rows = learn.predict_ridge(model, s).join(_kernel_sums(spark, s, coef), "id").join(svm.predict_svm(model, s), "id")
    left = F.col("prediction") - float(model.intercept[0]) - F.col("f")
    agrees = (F.col("label") == 1.0) == (F.col("prediction") > 0)
    return rows.select("id", (F.round(left, 5) + 0.0).alias("residual"), (F.round(F.lit(total), 5) + 0.0).alias("balance"), agrees.alias("agrees"))


@query()
def designed_from_model(spark: SparkSession, d: str) -> DataFrame:
    s = I.event_strings(spark, d)
    model = learn.fit_ridge(s, I.event_letters(spark), KernelParams(1.5, 1.2, 2, True), 10.0)
    coef = learn.dual_coefficients(model, s).select("id", "coef").join(s, "id")
    return design.design(coef, "coef", I.event_letters(spark), KernelParams(1.5, 1.2, 2, True), 5, 10)


@query(f"""WITH {EV}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM ev)
SELECT id, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r""")
def contiguous_folds(spark: SparkSession, d: str) -> DataFrame:
    return learn.kfold(I.event_strings(spark, d), 7, "id").select("id", "fold")


_GRID = {"sigma_p": [0.5, 2.0], "sigma_c": [1.0], "n": [1, 2], "alpha": [0.1, 1.0, 10.0]}


@query(f"""WITH {EV}, u AS (SELECT DISTINCT length(seq) AS len FROM ev), a(alpha, i) AS (VALUES (0.1, 0), (1.0, 1), (10.0, 2)), l AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS j FROM u)
SELECT CAST(j * 3 + i AS BIGINT) AS param_id, CAST(len AS DOUBLE) AS n, CAST(alpha AS DOUBLE) AS alpha FROM l, a""")
def grid_of_parameters(spark: SparkSession, d: str) -> DataFrame:
    sizes = sorted(r[0] for r in I.event_strings(spark, d).select(F.length("seq")).distinct().collect())
    return learn.param_grid(spark, {"n": sizes, "alpha": [0.1, 1.0, 10.0]})


def _cv(spark: SparkSession, d: str) -> DataFrame:
    s = learn.kfold(I.event_strings(spark, d), 4, "id")
    return learn.grid_search(s, I.event_letters(spark), learn.param_grid(spark, _GRID), normalized=False)


@query()
def grid_scores(spark: SparkSession, d: str) -> DataFrame:
    return _cv(spark, d).select("param_id", "fold", "phase", r6("r2").alias("r2"), r6("mse").alias("mse"))


@query()
def nested_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = learn.nested_cv(I.event_strings(spark, d), I.event_letters(spark), _GRID, 3, 3, normalized=False)
    return rows.select("id", "fold", r6("prediction").alias("prediction"))


@query()
def random_grid_scores(spark: SparkSession, d: str) -> DataFrame:
    s = learn.kfold(I.event_strings(spark, d), 3, "id")
    return learn.grid_search(s, I.event_letters(spark), learn.random_search(spark, _GRID, 4, 7), normalized=False).select("param_id", "fold", "phase", r6("r2").alias("r2"))


@query(f"""WITH {EV}, fo AS (SELECT unnest(range(0, 3)) AS fold), ph(phase) AS (VALUES ('train'), ('test')), ty AS (SELECT unnest(range(0, 2)) AS n_)
SELECT CAST(n_ * 2 + a_ AS BIGINT) AS param_id, CAST(fold AS INTEGER) AS fold, phase, 0.0::DOUBLE AS r2_gap, 0.0::DOUBLE AS mse_gap FROM ty, (SELECT unnest(range(0, 2)) AS a_), fo, ph""")
def grid_scores_of_fits(spark: SparkSession, d: str) -> DataFrame:
    """The scores of a grid, less those of a fit of its own for each set and fold, scored by its predictions: no difference."""
    s = materialized(learn.kfold(I.event_strings(spark, d).withColumn("y", F.col("y") / 1000), 3, "id"), "folds")
    grid = learn.param_grid(spark, _GRID | {"sigma_p": [2.0], "alpha": [0.1, 10.0]})
    found, own = learn.grid_search(s, I.event_letters(spark), grid, normalized=True), []
    for p in grid.collect():
        for k in range(3):
            params = KernelParams(p["sigma_p"], p["sigma_c"], int(p["n"]), True)
            model = learn.fit_ridge(s.where(F.col("fold") != k), I.event_letters(spark), params, p["alpha"])
            phase = F.when(F.col("fold") == k, "test").otherwise("train").alias("phase")
            scored = learn.predict_ridge(model, s).join(s.select("id", "y", phase), "id")
            # two rows a fit, taken at once: a plan of all fits together outgrows the driver
            own += [(p["param_id"], k, r["phase"], r["r2"], r["mse"]) for r in learn.regression_metrics(scored, ["phase"]).collect()]
    out = spark.createDataFrame(own, "param_id long, fold int, phase string, own_r2 double, own_mse double")
    gap = lambda c: (F.round((F.col(c) - F.col(f"own_{c}")) / F.greatest(F.lit(1.0), F.abs(c)), 6) + 0.0).alias(f"{c}_gap")
    return found.join(out, ["param_id", "fold", "phase"]).select("param_id", "fold", "phase", gap("r2"), gap("mse"))


@query(f"""WITH {EV}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM ev)
SELECT id, CAST(CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS lead FROM r""")
def nested_predictions_of_sums(spark: SparkSession, d: str) -> DataFrame:
    """Predictions out of fold, less kernel sums with the coefficients of a fit of the chosen set on the other folds (another path than a
    model's predictions); and by how much another set's mean score is above that of the chosen one in the fold's search: nothing."""
    s, letters = materialized(I.event_strings(spark, d).withColumn("y", F.col("y") / 1000), "nested"), I.event_letters(spark)
    rows, chosen = learn.nested_cv(s, letters, _GRID, 3, 3, normalized=False)
    rows, sets, out = materialized(rows, "nested-rows"), {r["param_id"]: r for r in learn.param_grid(spark, _GRID).collect()}, None
    for c in chosen.collect():
        p = sets[c["param_id"]]
        params = KernelParams(p["sigma_p"], p["sigma_c"], int(p["n"]))
        train = s.join(rows.where(F.col("fold") != c["fold"]).select("id"), "id")
        scores = learn.grid_search(learn.kfold(train, 3, "id"), letters, learn.param_grid(spark, _GRID), normalized=False).where("phase = 'test'").groupBy("param_id").agg(F.avg("r2").alias("r2"))
        lead = float(scores.agg(F.max("r2")).first()[0]) - c["score"]
        coef = materialized(learn.dual_coefficients(learn.fit_ridge(train, letters, params, p["alpha"]), train).select("id", "coef"), "nested-duals")
        sums = _kernel_sums(spark, s, coef, params)
        got = rows.where(F.col("fold") == c["fold"]).join(sums, "id").select("id", "fold", (F.round(F.col("prediction") - F.col("f"), 5) + 0.0).alias("gap"), (F.round(F.lit(lead), 9) + 0.0).alias("lead"))
        out = got if out is None else out.unionByName(got)
    return out


#: Results of a parameter search, as the reports take them: made of the events' values.
_CV = """cv AS (SELECT user_id % 4 AS a, event_id % 3 AS b, user_id % 3 AS c, (user_id % 4) * 3 + event_id % 3 AS param_id, CAST(event_id % 5 AS INTEGER) AS fold,
CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'train' END AS phase, value AS score FROM events)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = I.read(spark, d, "events")
    u, v = F.col("user_id"), F.col("event_id")
    return e.select((u % 4).alias("a"), (v % 3).alias("b"), (u % 3).alias("c"), ((u % 4) * 3 + v % 3).alias("param_id"), (v % 5).cast("int").alias("fold"),
                    F.when(v % 2 == 0, "test").otherwise("train").alias("phase"), F.col("value").alias("score"))


@query(f"WITH {_CV} SELECT param_id, round(avg(score), 6) AS score FROM cv WHERE phase = 'test' GROUP BY 1 ORDER BY avg(score) DESC, param_id LIMIT 1")
def best_parameters(spark: SparkSession, d: str) -> DataFrame:
    return learn.best_params(_results(spark, d), "score").select("param_id", r6("score").alias("score"))


@query("""SELECT l_returnflag, round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
round(avg((l_extendedprice - 1500 * l_quantity) ** 2) / 1e6, 6) AS mse FROM lineitem GROUP BY 1""")
def metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("prediction"))
    return learn.regression_metrics(rows, ["l_returnflag"]).select("l_returnflag", r6("r2").alias("r2"), r6(F.col("mse") / 1e6).alias("mse"))


# -- spectra ---------------------------------------------------------------------------------------------------------

_SPEC = f"""{EV}, spec AS (SELECT id // 1000 AS target, gram, count(*) * 0.75 AS w FROM {sql_grams("ev", 2)} GROUP BY 1, 2), th AS (SELECT gram, round(avg(w), 3) AS threshold FROM spec GROUP BY 1)"""


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    """(target, gram, w): each user's counts of pairs of events in a day, three quarters of them."""
    g = G.positional_grams(I.event_strings(spark, d), 2)
    return g.groupBy(F.floor(F.col("id") / 1000).alias("target"), "gram").agg((F.count("*") * 0.75).alias("w"))


@query(f"""WITH {_SPEC}, j AS (SELECT target, gram, w, CAST(w > threshold AS INTEGER) AS o, row_number() OVER (PARTITION BY target ORDER BY w DESC, gram) AS b FROM spec JOIN th USING (gram)),
f AS (SELECT *, CASE WHEN o = 0 AND b <= 12 THEN 1 ELSE 0 END AS free, sum(o) OVER (PARTITION BY target) AS n FROM j),
x AS (SELECT *, sum(free) OVER (PARTITION BY target ORDER BY b) AS nth FROM f)
SELECT target, gram, CAST(CASE WHEN o = 1 OR (free = 1 AND nth <= 12 - n) THEN 1 ELSE 0 END AS BIGINT) AS count FROM x""")
def spectra_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = materialized(_spectra(spark, d), "spectra")
    limits = s.groupBy("gram").agg(F.round(F.avg("w"), 3).alias("threshold"))
    return spectrum.round_by_threshold(s, limits, 12)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).select("target", "gram", F.bround("w").cast("long").alias("count"))


_COUNTS = f"{_SPEC}, cn AS (SELECT target, gram, CAST(CASE WHEN w % 1 = 0.5 THEN 2 * round(w / 2) ELSE round(w) END AS BIGINT) AS count FROM spec)"


@query(f"WITH {_COUNTS} SELECT target, gram FROM (SELECT target, gram, unnest(range(0, count)) FROM cn)")
def spectra_expanded(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.expand_counts(_counts(spark, d))


@query(f"WITH {_COUNTS} SELECT target, gram[1] AS source, gram[2] AS sink, CAST(sum(count) AS BIGINT) AS multiplicity FROM cn WHERE count > 0 GROUP BY 1, 2, 3")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.debruijn_edges(_counts(spark, d))


@query(f"""WITH {_COUNTS}, e AS (SELECT target, gram[1] AS node, count AS o, 0 AS i FROM cn WHERE count > 0 UNION ALL SELECT target, gram[2], 0, count FROM cn WHERE count > 0)
SELECT target, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM e GROUP BY 1, 2""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.debruijn_nodes(_counts(spark, d))


_ROUNDED = f"""WITH RECURSIVE {_SPEC}, st AS (SELECT target, 0 AS step, list(gram ORDER BY gram) AS g, list(w::DOUBLE ORDER BY gram) AS w FROM spec GROUP BY 1
UNION ALL SELECT target, step + 1, g, list_transform(w, lambda x: x * list_min(list_transform(w, lambda v: (ceil(v + 0.5) - 0.49) / v))) FROM st WHERE list_sum(list_transform(w, lambda x: round_even(x, 0))) < 39),
rd AS (SELECT target, unnest(g) AS gram, CAST(round_even(unnest(w), 0) AS BIGINT) AS count FROM st QUALIFY row_number() OVER (PARTITION BY target ORDER BY step DESC) = 1)"""


@query(f"{_ROUNDED} SELECT target, gram, count FROM rd")
def spectra_rounded(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.round_to_count(_spectra(spark, d), 40)


@query(f"{_ROUNDED} SELECT target, gram, count, CAST(0 AS BIGINT) AS missing FROM rd WHERE count > 0")
def grams_of_spectrum_strings(spark: SparkSession, d: str) -> DataFrame:
    """Of each gram of a rounded spectrum, how many of its repetitions the spectrum's string lacks: none."""
    counts = materialized(spectrum.round_to_count(_spectra(spark, d), 40), "rounded")
    found = G.gram_counts(spectrum.euler_strings(counts).withColumnRenamed("target", "id"), 2).withColumnRenamed("id", "target")
    rows = counts.where("count > 0").join(found, ["target", "gram"], "left")
    return rows.select("target", "gram", "count", F.greatest(F.lit(0).cast("long"), F.col("count") - F.coalesce("value", F.lit(0.0)).cast("long")).alias("missing"))


@query()
def strings_of_spectra(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.euler_strings(spectrum.round_to_count(_spectra(spark, d), 40))


# -- reports ---------------------------------------------------------------------------------------------------------


@query("""SELECT round(avg(value), 6) AS search_mean_time, round(avg(value / 2), 6) AS search_mean_solution_time, round(avg(value / 8), 6) AS search_mean_start_nodes_time,
round(avg(user_id), 6) AS search_mean_n_iterations, round(avg(user_id // 2), 6) AS search_mean_solution_n_iterations,
round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS search_percentage_of_approximates, count(*) AS search_n_examples FROM events""")
def summary_of_searches(spark: SparkSession, d: str) -> DataFrame:
    log = I.read(spark, d, "events").select(
        F.col("value").alias("total_time"), (F.col("value") / 2).alias("solution_time"), (F.col("value") / 8).alias("start_nodes_time"),
        F.col("user_id").alias("n_iterations"), F.floor(F.col("user_id") / 2).alias("solution_n_iterations"), (F.col("event_type") == "error").alias("is_approximate"),
    )
    s = report.search_summary(log)
    return s.select(*[r6(c).alias(c) if c != "search_n_examples" else F.col(c) for c in s.columns])


@query(f"""WITH {_CV} SELECT a, {", ".join(f'round(avg(score) FILTER (b = {i}), 6) AS "{i}"' for i in range(3))} FROM cv WHERE phase = 'test' GROUP BY 1""")
def heatmap_of_scores(spark: SparkSession, d: str) -> DataFrame:
    h = report.score_heatmap(_results(spark, d), "a", "b", "test")
    return h.select("a", *[r6(c).alias(c) for c in h.columns[1:]])


@query(f"WITH {_CV} " + " UNION ALL ".join(f"SELECT phase, '{x}' AS x, '{y}' AS y, CAST({x} AS DOUBLE) AS x_value, CAST({y} AS DOUBLE) AS y_value, round(avg(score), 6) AS score FROM cv GROUP BY phase, {x}, {y}" for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))
def heatmaps_of_scores(spark: SparkSession, d: str) -> DataFrame:
    return report.score_heatmaps(_results(spark, d), ["a", "b", "c"]).withColumn("score", r6("score"))


@query("SELECT event_type AS label, string_agg(user_id || ':' || value, ',' ORDER BY user_id, value) AS points FROM events GROUP BY 1")
def series_of_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("x"), F.col("value").alias("y"))
    s = report.series_by_group(rows)
    return s.select("label", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("points"))


@query("SELECT event_type AS label, user_id AS x, value AS y FROM events")
def series_as_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("x"), F.col("value").alias("y"))
    return report.ordered_series(rows)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
v AS (SELECT event_type, value, q1, m, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q USING (event_type))
SELECT event_type, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(min(value) FILTER (ok), 6) AS low_whisker, round(max(value) FILTER (ok), 6) AS high_whisker,
count(*) FILTER (NOT ok) AS n_outliers FROM v GROUP BY 1, 2, 3, 4""")
def boxes_of_groups(spark: SparkSession, d: str) -> DataFrame:
    b = report.box_summary(I.read(spark, d, "events"), "event_type", "value")
    return b.select("event_type", *[r6(c).alias(c) for c in ("q1", "median", "q3", "low_whisker", "high_whisker")], "n_outliers")


@query("SELECT event_type, share::DOUBLE AS share, round(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])[i], 6) AS q FROM events, (VALUES (0.1, 1), (0.25, 2), (0.5, 3), (0.75, 4), (0.9, 5)) x(share, i) GROUP BY event_type, share, i")
def quantiles_of_groups(spark: SparkSession, d: str) -> DataFrame:
    return report.quantiles(I.read(spark, d, "events"), "event_type", "value", (0.1, 0.25, 0.5, 0.75, 0.9)).withColumn("q", r6("q"))


@query("""WITH s AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 50 AS w, count(*) AS total FROM events GROUP BY 1),
c AS (SELECT event_type, CAST(least(49, floor((value - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY 1, 2),
g AS (SELECT *, unnest(range(0, 50)) AS bin FROM s)
SELECT g.event_type, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS low, round(coalesce(n, 0) / (total * w), 9) AS density FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.bin = g.bin""")
def histograms_of_groups(spark: SparkSession, d: str) -> DataFrame:
    h = report.histogram(I.read(spark, d, "events"), "event_type", "value")
    return h.select("event_type", "bin", r6("low").alias("low"), F.round("density", 9).alias("density"))


@query("""WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
g AS (SELECT *, sd * n ** (-0.2) AS h, unnest(range(0, 20)) AS i FROM s), p AS (SELECT *, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 19) AS x FROM g)
SELECT p.event_type, CAST(i AS INTEGER) AS point, round(any_value(x), 6) AS x, round(sum(exp(-0.5 * ((x - value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM p JOIN events e ON e.event_type = p.event_type GROUP BY 1, 2""")
def densities_of_groups(spark: SparkSession, d: str) -> DataFrame:
    k = report.kde(I.read(spark, d, "events"), "event_type", "value", 20)
    return k.select("event_type", "point", r6("x").alias("x"), F.round("density", 9).alias("density"))


@query(f"""WITH {EV}, c AS (SELECT pos, gram AS letter, count(*) AS n FROM {sql_grams("ev", 1)} GROUP BY 1, 2), f AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS f, sum(n) OVER (PARTITION BY pos) AS t FROM c),
h AS (SELECT *, -sum(f * log2(f)) OVER (PARTITION BY pos) AS h FROM f)
SELECT CAST(pos AS INTEGER) AS pos, letter, n, round(f, 6) AS frequency, round(f * (log2(5) - h - 4.0 / (2 * ln(2) * t)), 6) AS bits FROM h""")
def profile_of_motifs(spark: SparkSession, d: str) -> DataFrame:
    m = report.motif_profile(I.event_strings(spark, d), True, 5)
    return m.select("pos", "letter", "n", r6("frequency").alias("frequency"), r6("bits").alias("bits"))


@query("SELECT least(min(l_extendedprice), min(1500 * l_quantity)) AS low, greatest(max(l_extendedprice), max(1500 * l_quantity)) AS high FROM lineitem")
def limits_of_axes(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("prediction"))
    return report.axis_limits(rows)
