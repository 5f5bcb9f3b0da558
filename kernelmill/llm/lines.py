"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import written

#: Up to this size, which is measured, the sites' lines are broadcast; beyond it, a site is dealt over a task for each SITE_PAGES of its pages.
BROADCAST_BYTES, SITE_PAGES = 8 << 20, 20_000
#: Sites of more pages are broadcast up to so many, which are counted.
BROADCAST_SITES = 200_000


# What of a page is no text, and the tags that end a line.
NO_TEXT = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
BLOCK_TAGS = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"


def page_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host (the lower-case host of the URL, null where it has none) and text (a line for each block of the page, tags removed)."""
    host = F.nullif(F.lower(F.regexp_extract(pages[url], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)), F.lit(""))
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(pages[html], NO_TEXT, ""), BLOCK_TAGS, "\n"), "<[^>]*>", "")
    text = F.regexp_replace(lines, r"\n[\x20\x09-\x0D]+", "\n")
    return pages.withColumns({"host": host, "text": text})


def _host(c: Column) -> Column:
    """A join key of the host; a null host is a site of its own."""
    return F.coalesce(F.concat(F.lit("h"), c), F.lit("n"))


def boilerplate_lines(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, total, lines): the pages of each site that has boilerplate lines, and the MD5 digests of those.

    A line is boilerplate where it stands on at least min_pages pages of the site and on more than
    max_ratio of all its pages. A site has at most (mean lines a page) / max_ratio of them, so the
    array is bounded however many pages the site has. Lines are counted once a page; partial counts
    are made before the shuffle, so a frequent line or a large site costs no more than others.
    """
    site = _host(pages[host]).alias("site")
    lines = F.array_distinct(F.filter(F.split(pages[text], "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    seen = (
        pages.select(site, F.explode(F.transform(lines, lambda x: F.unhex(F.md5(x)))).alias("line"))
        .groupBy("site", "line")
        .agg(F.count("*").alias("n"))
    )
    totals = pages.select(site).groupBy("site").agg(F.count("*").alias("total"))
    return (
        seen.where(F.col("n") >= min_pages)
        .join(totals, "site")
        .where(F.col("n") > F.lit(float(max_ratio)) * F.col("total"))
        .groupBy("site")
        .agg(F.first("total").alias("total"), F.collect_list("line").alias("lines"))
    )


def _row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns; maps and other types that can't be hashed are left out."""
    own = [df[f.name] for f in df.schema.fields if "map<" not in (t := f.dataType.simpleString()) and "variant" not in t]
    return F.xxhash64(*own) if own else F.lit(0).cast("long")


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.01, min_pages: int = 5
) -> DataFrame:
    """All columns of pages as struct `row`, `clean` (the text without its boilerplate lines), n_lines, n_dropped.

    Every row counts as one page, repeated rows too. Lines are cut at \\n; lines without a word are
    never dropped. A null text stays null with no lines, an empty text has one line and stays empty;
    null hosts form one site. An empty table gives an empty result.
    """
    drop = written(boilerplate_lines(pages, host, text, max_ratio, min_pages), "boilerplate")
    size = int(drop.agg(F.sum(F.size("lines") * 16 + 64)).first()[0] or 0)
    large = None
    if size <= BROADCAST_BYTES:
        drop = F.broadcast(drop.withColumn("salt", F.lit(0)))
    else:  # a large site is dealt over several tasks by a hash of the whole row, each with the site's lines
        salts = F.ceil(F.col("total") / SITE_PAGES).cast("int")
        large = drop.where(salts > 1).select(F.col("site").alias("of"), salts.alias("salts"))
        large = F.broadcast(large) if large.count() <= BROADCAST_SITES else large
        drop = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    src = pages.select(
        (F.lit(0) if large is None else _row_hash(pages)).alias("hash"),
        F.struct(*[pages[c] for c in pages.columns]).alias("row"),
        _host(pages[host]).alias("site"),
        F.split(pages[text], "\n").alias("all"),
    )
    if large is None:
        src = src.withColumn("salt", F.lit(0))
    else:
        src = src.join(large, F.col("site") == F.col("of"), "left").withColumn("salt", F.pmod("hash", F.coalesce("salts", F.lit(1))).cast("int"))
    kept = F.when(
        F.col("lines").isNotNull(), F.filter("all", lambda x: ~F.array_contains("lines", F.unhex(F.md5(x))))
    ).otherwise(F.col("all"))
    return (
        src.join(drop, ["site", "salt"], "left")
        .select("row", "all", kept.alias("kept"))
        .select(
            "row",
            F.array_join("kept", "\n").alias("clean"),
            F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("all") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        )
        .withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    )
