"""Not-modified revisits of web archives: an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import written

# Query parameters that only track, and the headers that a 304 response may update.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid)$"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or a default port, no scheme, fragment, tracking parameters or last slash; sorted query."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), r"/+$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^[^/]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(place, r"^[^/]*(.*)$", 1)
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise(F.lit(""))
    params = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    )
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(tag, "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with those of the not-modified response that it may update (names in lower case)."""

    def low(m: Column) -> Column:
        """Names in lower case; of names that differ only by case, the last one's value."""
        rows = F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        names = F.transform(rows, lambda e: e["key"])
        return F.map_from_entries(F.filter(rows, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))

    allowed = F.map_filter(low(fresh), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    base = F.map_filter(low(stored), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(base, allowed)


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Each revisit with what it stands for: struct `row`, canonical, response_id, verdict, merged_headers, digest.

    records: record_id, url, ts (seconds, long), kind ('response' or 'revisit'), etag, last_modified, digest,
    headers (a map; of names that differ only by case, the last counts); more columns may stand beside them and stay in `row`. A revisit
    takes the latest full response of its canonical URL with a smaller ts (of equal ts: the largest
    record_id). verdict: `resolved` if the validators agree (entity tags by weak comparison where both
    have one, else Last-Modified where both have one), `changed` if they differ, `unchecked` if there are
    none to compare, `orphan` if there is no earlier response. Only resolved revisits get merged_headers
    and digest. Rows of null url or ts are orphans; repeated rows are resolved one by one.

    The join runs in two levels so that one URL with very many captures isn't one group: within (URL,
    time bucket) by a window, and over a table of each bucket's last response by a second window, whose
    rows a URL are bounded by the number of buckets. Nothing but these columns is shuffled; payloads stay
    where they are, and can be fetched by response_id. Rows of null url or ts go to no join or window, so they make no hot key.
    """
    own = ["record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers"]
    full = F.struct(*[F.col(c) for c in ("ts", "record_id", "etag", "last_modified", "digest", "headers")])
    src = records.select(
        F.struct(*[records[c] for c in records.columns]).alias("row"),
        canonical_url(records["url"]).alias("canonical"),
        *[records[c] for c in own if c != "url"],
    )
    placed = records["url"].isNotNull() & records["ts"].isNotNull()
    lost, src = src.where(~placed & (records["kind"] == "revisit")), src.where(placed)
    # written once, as five steps read them: URLs are made canonical once
    src = written(src.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds)), "revisits")
    light = src.withColumn("full", F.when(F.col("kind") == "response", full))
    last = light.where("full is not null").groupBy("canonical", "bucket").agg(
        F.max_by("full", F.struct("ts", "record_id")).alias("last")
    )
    # The last response of the nearest earlier bucket, for buckets that hold any record.
    seen = light.groupBy("canonical", "bucket").agg(F.count("*").alias("n")).drop("n")
    earlier = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.join(last, ["canonical", "bucket"], "left").select(
        "canonical", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried")
    )
    inside = Window.partitionBy("canonical", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    joined = (
        light.select("*", F.max(F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).over(inside).alias("near"))
    )
    # The window keeps only (ts, record_id) of the nearest response; its other columns come by an equi-join.
    joined = joined.where("kind = 'revisit'").join(carried, ["canonical", "bucket"], "left")
    near = light.where("full is not null").groupBy("canonical", "bucket", F.struct("ts", "record_id").alias("near")).agg(
        F.first("full").alias("near_full")
    )
    joined = joined.join(near, ["canonical", "bucket", "near"], "left").withColumn("hit", F.coalesce("near_full", "carried"))
    tags = F.col("etag").isNotNull() & F.col("hit.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("hit.last_modified").isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(F.col("hit.etag"))).when(
        dates, F.col("last_modified") == F.col("hit.last_modified")
    )
    verdict = (
        F.when(F.col("hit").isNull(), "orphan").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")
    )
    ok = F.col("verdict") == "resolved"
    out = joined.withColumn("verdict", verdict).select(
        "row",
        "canonical",
        F.col("hit.record_id").alias("response_id"),
        "verdict",
        F.when(ok, merge_headers(F.col("hit.headers"), F.col("headers"))).alias("merged_headers"),
        F.when(ok, F.col("hit.digest")).alias("digest"),
    )
    none = {c: F.lit(None).cast(t).alias(c) for c, t in out.dtypes}
    return out.unionByName(lost.select("row", "canonical", none["response_id"], F.lit("orphan").alias("verdict"), none["merged_headers"], none["digest"]))
