"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from . import decontam, katz, langid, lexical, lines, mixing, quality, revisits, secrets, simhash, substrings, topk, whitening
from .util import written


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(m: int) -> Column:
    """The crc32 of the id as text, modulo m: parts off held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    span = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"] != "checked")
    return found.select(
        "row.doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        count("checked"),
        F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", span), ",").alias("spans"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: A line on more than one in twenty of a site's pages, five at least, belongs to the site, not to its pages.
SITE_LINES = {"max_ratio": 0.05, "min_pages": 5}


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages by the host of their URL: the text of each without the lines of its site."""
    pages = lines.page_text(_read(spark, sf_dir, "pages"))
    found = lines.drop_boilerplate(pages.select("page_id", "host", "text"), "host", **SITE_LINES)
    return found.select("row.page_id", "row.host", F.col("clean").alias("text"), "n_lines", "n_dropped")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "kept"
    )


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, written as shuffled output shards; the words taken of each document are those read back from the shards."""
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), carry=["doc_id"]).withColumn("n", F.monotonically_increasing_id())
    mixed = written(mixed, "mixed")
    path = f"{shared_dir(spark)}/mix-shards-{uuid.uuid4().hex}"
    files = max(16, mixed.count() // 100_000)
    mixing.write_shards(mixed.select(F.struct("n", "row.doc_id").alias("row"), "places"), path, files)
    back = spark.read.parquet(path).groupBy("row.n").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"))
    rows = mixed.drop("taken").join(back, "n", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("row.doc_id", "size", "source_size", "target", none("taken"), none("copies"), F.to_json("places").alias("places"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_crc(7) == 2, F.lit(False)).alias("held_out"))
    found = katz.score_documents(docs.withColumn("learn", ~F.col("held_out")), "learn", carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of each page: its response, and two revisits under other spellings of the URL.

    Times, validators and spellings follow from page_id alone. Every seventh first revisit carries another
    entity tag, every fifth second revisit has only a date, every ninth page has no tag, every eleventh no date.
    """
    p = F.col("page_id")
    tag = F.when(p % 9 != 0, F.concat(F.lit('"'), F.md5("html"), F.lit('"')))
    date = F.when(p % 11 != 0, F.concat(F.lit("day "), (p % 700).cast("string")))
    ts = F.lit(1_700_000_000) + (p * 7919) % 250_000 * 60

    def record(k: int, kind: str, url: Column, at: Column, etag: Column, headers: dict[str, Column]) -> Column:
        return F.struct(
            (p * 3 + k).alias("record_id"),
            F.lit(kind).alias("kind"),
            url.alias("url"),
            at.cast("long").alias("ts"),
            etag.alias("etag"),
            date.alias("last_modified"),
            F.when(F.lit(k == 0), F.md5("html")).alias("digest"),
            F.map_from_arrays(
                F.array(*[F.lit(h) for h in headers]), F.array(*[v.cast("string") for v in headers.values()])
            ).alias("headers"),
        )

    first = {"Content-Type": F.lit("text/html"), "Content-Length": F.length("html"), "Date": ts, "ETag": F.coalesce(tag, F.lit("-"))}
    later = {"Content-Length": F.lit(0), "Date": ts + 86_400, "Cache-Control": F.concat(F.lit("max-age="), p % 60)}
    rows = F.array(
        record(0, "response", F.col("url"), ts, tag, first),
        record(1, "revisit", F.concat("url", F.lit("#again")), ts + 86_400, F.when(p % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)), later),
        record(2, "revisit", F.regexp_replace("url", "^https?://", "HTTP://www."), ts + 3 * 86_400 + p % 1000, F.when(p % 5 != 0, tag), later),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(captures(_read(spark, sf_dir, "pages")))
    return found.select(
        "row.record_id",
        "canonical",
        "response_id",
        "verdict",
        "digest",
        F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("headers"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _crc(5) == 0)
    model = langid.fit(docs.where("not held_out"), "text", "lang", F.col("doc_id"))
    found = langid.identify(docs, model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", F.coalesce("row.held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=8)
    found, error = whitening.whiten(vectors, model, carry=["vec_id"])
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    rows = found.select("row.vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_list(xs: list[str]) -> str:
    return "(" + ", ".join(map(_sql_text, xs)) + ")"


SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[i : i + m - 1] AS g, m
      FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, m, i, w[i : i + m - 1] AS g
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT s.doc_id, s.i, p.m, p.item_id FROM s JOIN p ON s.m = p.m AND s.g = p.g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_site_lines": rf"""
WITH d AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)), '') AS host, string_split(regexp_replace(
             regexp_replace(regexp_replace(regexp_replace(html, {_sql_text(lines.NO_TEXT)}, '', 'g'), {_sql_text(lines.BLOCK_TAGS)}, chr(10), 'g'), '<[^>]*>', '', 'g'),
             '\n[\x20\x09-\x0D]+', chr(10), 'g'), chr(10)) AS l FROM pages),
s AS (SELECT host, line, count(*) AS n
      FROM (SELECT host, unnest(list_distinct(l)) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
t AS (SELECT host, count(*) AS total FROM d GROUP BY 1),
x AS (SELECT s.host, line FROM s JOIN t ON s.host IS NOT DISTINCT FROM t.host WHERE n >= {SITE_LINES["min_pages"]} AND n > {SITE_LINES["max_ratio"]}::DOUBLE * total),
e AS (SELECT page_id, host, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM d),
k AS (SELECT e.page_id, e.host, e.i, e.line, x.line IS NOT NULL AS gone
      FROM e LEFT JOIN x ON e.host IS NOT DISTINCT FROM x.host AND e.line = x.line)
SELECT page_id, host, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM k GROUP BY page_id, host
UNION ALL SELECT page_id, host, NULL, 0, 0 FROM d WHERE l IS NULL""",
    "op6_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, unnest(i) AS i FROM (SELECT doc_id, list(i) AS i FROM e GROUP BY doc_id, g HAVING count(*) > 1)),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY 1),
x AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM d),
y AS (SELECT doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM x),
v AS (SELECT *, len(regexp_split_to_array(t, '[\x20\x09-\x0D]+')) AS n, length(t) - length(translate(t, '{quality.SEPARATORS}', '')) AS seps,
             t <> '' AND right(t, 1) NOT IN {_sql_list(quality.ENDS)} AND len(regexp_split_to_array(t, '[\x20\x09-\x0D]+')) <= {quality.MENU_WORDS} AS short FROM y),
o AS (SELECT *, coalesce(lag(short) OVER s, false) OR coalesce(lead(short) OVER s, false) AS beside FROM v WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c, t <> '' AS worded,
             t <> '' AND (10 * (length(t) - length(translate(t, '{quality.SYMBOLS}', ''))) > length(t)
               OR 2 * (length(t) - length(translate(t, {_sql_text(quality.SIGNS)}, ''))) > length(t)
               OR (seps >= 2 AND n <= {quality.FIELD_WORDS} * (seps + 1)) OR (short AND beside) OR (short AND n < 3)
               OR (length(t) <= {quality.NOTICE_CHARS} AND (regexp_matches(t, {_sql_text(quality.NOTICE)}) OR {" OR ".join(f"contains(lower(t), {x})" for x in map(_sql_text, quality.PHRASES))}))) AS bad FROM o),
q AS (SELECT doc_id, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(c) FILTER (NOT bad), 0) AS left_chars,
             count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines FROM z GROUP BY 1),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, n_dup_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, n_bad_lines, left_chars
      FROM d JOIN q USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_bad_lines,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (word_chars = 0 OR 1 - left_chars::DOUBLE / word_chars <= 0.5) AS kept
FROM f""",
    "op9_revisits": r"""
WITH p AS (SELECT page_id AS p, url, md5(html) AS h, length(html) AS n, CASE WHEN page_id % 9 <> 0 THEN '"' || md5(html) || '"' END AS tag,
                  1700000000 + (page_id * 7919) % 250000 * 60 AS ts FROM pages),
r AS (SELECT p * 3 AS record_id, 'response' AS kind, url, ts, ts AS t0, tag AS etag, p, h, n, tag FROM p
      UNION ALL SELECT p * 3 + 1, 'revisit', url || '#again', ts + 86400, ts, CASE WHEN p % 7 = 0 THEN '"other"' ELSE 'W/' || tag END, p, h, n, tag FROM p
      UNION ALL SELECT p * 3 + 2, 'revisit', regexp_replace(url, '^https?://', 'HTTP://www.'), ts + 3 * 86400 + p % 1000, ts, CASE WHEN p % 5 <> 0 THEN tag END, p, h, n, tag FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(bare, '\?.*$', ''), '/+$', '') AS place,
             list_sort(list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_replace(bare, '^[^?]*\?', '') ELSE '' END, '&'),
               lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)$'))) AS q FROM b),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(place, '^[^/]*')), '^www\.', ''), ':(80|443)$', '')
             || regexp_extract(place, '^[^/]*(.*)$', 1) || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c),
j AS (SELECT v.record_id, v.canonical, v.etag, v.p, v.t0, f.record_id AS response_id, f.etag AS f_etag, f.p AS fp, f.h AS fh, f.n AS fn, f.t0 AS ft
      FROM (SELECT * FROM u WHERE kind = 'revisit') v LEFT JOIN (SELECT * FROM u WHERE kind = 'response') f ON v.canonical = f.canonical AND f.ts < v.ts
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1),
k AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan'
                     WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
                     WHEN p % 11 = 0 OR fp % 11 = 0 THEN 'unchecked' WHEN p % 700 = fp % 700 THEN 'resolved' ELSE 'changed' END AS verdict FROM j)
SELECT record_id, canonical, response_id, verdict, CASE WHEN verdict = 'resolved' THEN fh END AS digest,
       CASE WHEN verdict = 'resolved' THEN 'cache-control=max-age=' || (p % 60) || ';content-length=' || fn || ';content-type=text/html;date=' || (t0 + 86400)
            || ';etag=' || coalesce(f_etag, '-') END AS headers
FROM k""",
    "op11_topk": """
WITH v AS (SELECT vec_id, len(embedding) AS d, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.d = c.d AND q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op12_lexical": f"""
WITH t AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
i AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM n, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM f JOIN w USING (term) JOIN m USING (doc_id) JOIN i USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}

QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_simhash, op3_secrets, op4_substrings, op5_site_lines, op6_quality, op7_mix, op8_katz, op9_revisits, op10_language, op11_topk, op12_lexical, op13_whitening)
}
