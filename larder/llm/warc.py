"""WARC: resolve not-modified revisits to the latest earlier full response of the same canonical URL.

Records have record_id, warc_type (``response`` or ``revisit``), target_uri, warc_date (timestamp),
http_status, headers array<struct<name,value>> and payload. A full response is a ``response`` of
status 200. A revisit takes the payload and headers of the latest full response that is earlier
than itself. Its validators must agree: the ETag by weak comparison where both have one, else
Last-Modified where both have one. Headers of the revisit replace stored ones of the same name,
except those that describe the connection or the stored body.

Outcome of a row: ``response``, ``resolved``, ``no_response`` (none is earlier, or the revisit has
no URL or no date), ``mismatch`` (a validator differs) or ``unchecked`` (no validator in common).
The latter three get no payload, and keep their own headers. A response of the same time isn't
earlier. Of responses at one time the one with the largest record_id counts; of rows that share a
record_id the one that comes first by headers and payload. Null headers count as none. Revisits
that repeat are resolved one by one. An empty table gives an empty result. Further columns of the
records are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialize

#: Headers of a not-modified answer that never replace stored ones.
KEPT_HEADERS: tuple[str, ...] = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, default port, fragment and ``utm_`` parameters dropped, the rest sorted.

    Null where there's no scheme and host.
    """
    whole = F.regexp_replace(url, r"#[\s\S]*$", "")
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??([\s\S]*)$"
    scheme, host, path, query = (F.regexp_extract(whole, pattern, i) for i in (1, 2, 3, 4))
    scheme, host = F.lower(scheme), F.lower(host)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    path = F.when(path == "", "/").otherwise(path)
    kept = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, kept))


def header(headers: Column, name: str) -> Column:
    """The first value of a header; null where it has none."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(F.transform(found, lambda h: h["value"]), F.lit(1))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, those of ``fresh`` in place of ones of the same name where permitted; sorted."""
    permitted = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(*KEPT_HEADERS))
    names = F.transform(permitted, lambda h: F.lower(h["name"]))
    rest = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False)))
    return F.array_sort(F.concat(rest, permitted))


def _as_of(events: DataFrame) -> DataFrame:
    """Adds ``full``, the latest response before each row of the same key, in the order of ``place``.

    No key is gathered in one task. Rows are dealt out by ranges of (key, time), so a key with very
    many captures covers several partitions; each finds its answers inside its partition, and only
    what every partition carries over, one row per key and partition, meets in a window by key.
    """
    order = ["key", "at", "kind", "record_id"]
    placed = events.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    own = F.when(F.col("kind") == 1, F.struct("record_id", "etag", "modified"))
    inside = Window.partitionBy("part", "key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(own, ignorenulls=True).over(inside))
    carried = placed.groupBy("part", "key").agg(F.max_by(own, F.when(own.isNotNull(), F.col("place"))).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("part", "key", F.last("last", ignorenulls=True).over(before).alias("far"))
    carried = carried.where("far is not null")
    return near.join(carried, ["part", "key"], "left").withColumn("full", F.coalesce("near", "far"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per record: record_id, url (canonical), warc_date, warc_type, outcome, refers_to, headers, payload.

    Only keys, times and validators are ordered and matched. Payloads are shuffled once, to the
    revisits that refer to them; a response with very many revisits is split by the adaptive join.
    """
    columns = ["record_id", "warc_type", "target_uri", "warc_date", "http_status", "headers", "payload"]
    rows = records.select(*columns).withColumn("url", canonical_url(F.col("target_uri")))
    rows = rows.withColumn("headers", F.coalesce("headers", F.array().cast(HEADERS)))
    rows = rows.withColumn("full", (F.col("warc_type") == "response") & (F.col("http_status") == 200))
    revisit = F.col("warc_type") == "revisit"
    events = rows.where((F.col("full") | revisit) & F.col("url").isNotNull() & F.col("warc_date").isNotNull())
    events = events.select(
        F.unhex(F.md5("url")).alias("key"), F.col("warc_date").alias("at"), F.col("full").cast("int").alias("kind"),
        "record_id", header(F.col("headers"), "etag").alias("etag"),
        header(F.col("headers"), "last-modified").alias("modified"),
    )
    answered = _as_of(events).where("kind = 0")
    tag, stored = (F.regexp_replace(c, "^W/", "") for c in (F.col("etag"), F.col("full.etag")))
    agree = F.coalesce(tag == stored, F.col("modified") == F.col("full.modified"))
    outcome = (
        F.when(F.col("full").isNull(), "no_response").when(agree, "resolved").when(~agree, "mismatch").otherwise("unchecked")
    )
    # Rows of one record_id, time and key have the same answer if their validators agree, too.
    same = ["key", "at", "record_id", "etag", "modified"]
    answers = answered.groupBy(*same).agg(F.first("full").alias("full")).withColumn("outcome", outcome)
    answers = answers.select(*[F.col(c).alias(f"a_{c}") for c in same], "outcome", F.col("full.record_id").alias("refers_to"))
    asked = rows.where(revisit).select(
        "record_id", "url", "warc_date", "warc_type", "headers", F.unhex(F.md5("url")).alias("key"), F.col("warc_date").alias("at"),
        header(F.col("headers"), "etag").alias("etag"), header(F.col("headers"), "last-modified").alias("modified"),
    )
    match = (F.col("key") == F.col("a_key")) & (F.col("at") == F.col("a_at"))
    for c in ("record_id", "etag", "modified"):
        match = match & F.col(c).eqNullSafe(F.col(f"a_{c}"))
    asked = asked.join(answers, match, "left").withColumn("outcome", F.coalesce("outcome", F.lit("no_response")))
    asked = materialize(asked.select("record_id", "url", "warc_date", "warc_type", "headers", "outcome", "refers_to"))
    bodies = rows.where("full").groupBy(F.col("record_id").alias("source")).agg(
        F.min(F.struct("headers", "payload")).alias("body")
    )
    # Only what is resolved looks for a body; the others have no key and would all meet in one task.
    found = asked.where("outcome = 'resolved'").join(bodies, F.col("refers_to") == F.col("source"), "left")
    out = ["record_id", "url", "warc_date", "warc_type"]
    headers = merged_headers(F.coalesce("body.headers", F.array().cast(HEADERS)), F.col("headers"))
    resolved = found.select(*out, "outcome", "refers_to", headers.alias("headers"), F.col("body.payload").alias("payload"))
    open_ = asked.where("outcome != 'resolved'").select(
        *out, "outcome", "refers_to", F.array_sort("headers").alias("headers"), F.lit(None).cast("string").alias("payload")
    )
    plain = rows.where(~F.coalesce(revisit, F.lit(False))).select(
        *out, F.lit("response").alias("outcome"), F.lit(None).cast("string").alias("refers_to"),
        F.array_sort("headers").alias("headers"), "payload",
    )
    return plain.unionByName(resolved).unionByName(open_)


def captures(pages: DataFrame) -> DataFrame:
    """Records made from ``pages``: of every page a full response, and a revisit of its URL.

    Page n is fetched n hours after the start of 2024. Its revisit carries the ETag, or for every
    third page only the date, of that response; it follows 50 hours later, but for every seventh page
    an hour before, so that another page of the same URL, or none, may be the latest earlier one.
    """
    hours = F.col("page_id").cast("long")
    fetched = F.timestamp_seconds(F.lit(1_704_067_200) + hours * 3600)
    lag = F.when(hours % 7 == 0, -3600).otherwise(180_000)
    body = F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.md5(body), F.lit('"'))
    modified = F.date_format(F.date_trunc("day", fetched), "yyyy-MM-dd'T'HH:mm:ss")

    def named(*pairs: tuple[str, Column]) -> Column:
        found = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])
        return F.filter(found, lambda h: h["value"].isNotNull()).cast(HEADERS)

    full = pages.select(
        F.concat(F.lit("response-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("warc_type"),
        F.col("url").alias("target_uri"), fetched.alias("warc_date"), F.lit(200).alias("http_status"),
        named(
            ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(body)), ("ETag", etag),
            ("Last-Modified", modified), ("Cache-Control", F.lit("max-age=60")),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        F.concat(F.lit("revisit-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("warc_type"),
        F.col("url").alias("target_uri"), F.timestamp_seconds(F.lit(1_704_067_200) + hours * 3600 + lag).alias("warc_date"),
        F.lit(304).alias("http_status"),
        named(
            ("ETag", F.when(hours % 3 != 0, F.concat(F.lit("W/"), etag))), ("Last-Modified", modified),
            ("Content-Length", F.lit(0)), ("cache-control", F.lit("max-age=600")), ("Age", hours % 60),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)
