"""Resolution of not-modified revisits in web archives.

A revisit record says that the server answered 304: its body is that of an earlier full
response for the same URL. Each revisit meets the latest earlier full response of its
canonical URL (as-of join); then its validators are checked, and headers are merged.

* Canonical URL: no scheme, ``www.``, fragment, default port or trailing slash; host in
  lower case; query parameters sorted, without those of trackers.
* As-of: within slices of time by a window, and across slices by the last response of
  each slice, so that a URL with a third of all captures is spread over its slices.
* Validators: ETags compare weakly if both have one, else Last-Modified, else payload
  digests; without any in common there is no proof, and the revisit stays unresolved.
* Headers: those of the response, overlaid with the revisit's but for
  :data:`NOT_MERGED`, which describe a body that the revisit doesn't have.

Outcomes: ``resolved``, ``mismatch`` (a validator differs), ``unproven`` and ``missing``
(no earlier response). Records of equal time are ordered by id, a response before a
revisit of the same id; a null URL or time gives ``missing``; null headers are an empty
map; repeated rows of a response are one, those of a revisit each have a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a 304 must not change, and those of one connection only.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

TRACKERS = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """The key under which captures of one resource meet."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKERS))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _headers(column: Column) -> Column:
    """Names in lower case; of a name that stands twice, the last value."""
    entries = F.transform(F.map_entries(F.coalesce(column, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def resolve(records: DataFrame, slice_width: int = 4096) -> DataFrame:
    """Each revisit of ``(record_id, url, time, kind, headers, digest)`` with what it resolves to.

    time is an integer, slices are slice_width of it. Returns ``(record_id, url_key, source_id,
    outcome, headers)``; source_id is the response, null if there is none; headers are the
    merged ones of a resolved revisit, else null. Bodies stay where they are: see :func:`with_bodies`.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"), "kind", _headers(F.col("headers")).alias("headers"), "digest")
    r = r.withColumn("slice", F.floor(F.col("time") / slice_width))
    known = F.col("url_key").isNotNull() & F.col("time").isNotNull()
    order = F.struct("time", F.col("record_id").alias("id"), F.when(F.col("kind") == "response", 0).otherwise(1).alias("late"))
    full = F.when(F.col("kind") == "response", F.struct(F.col("time").alias("at"), F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), F.col("digest").alias("stored_digest")))
    r = r.withColumn("order", order).withColumn("full", full)
    placed = r.where(known)
    within = Window.partitionBy("url_key", "slice").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.withColumn("found", F.last("full", ignorenulls=True).over(within)).where("kind = 'revisit'").drop("full", "order", "time")
    last = placed.groupBy("url_key", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("order"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("url_key", "slice", "carried").where("carried IS NOT NULL")
    met = near.join(carried, ["url_key", "slice"], "left").withColumn("found", F.coalesce("found", "carried"))
    met = met.select("record_id", "url_key", "headers", "digest", "found.*")
    lost = r.where(~known & (F.col("kind") == "revisit")).select("record_id", "url_key", "headers", "digest", *(F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("at", "source_id", "stored", "stored_digest")))
    met = met.unionByName(lost)
    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    proofs = [(tag(F.col("headers")), tag(F.col("stored"))), (F.element_at("headers", "last-modified"), F.element_at("stored", "last-modified")), (F.col("digest"), F.col("stored_digest"))]
    outcome = F.when(F.col("source_id").isNull() & F.col("stored").isNull(), "missing")
    for own, stored in proofs:
        outcome = outcome.when(own.isNotNull() & stored.isNotNull(), F.when(own == stored, "resolved").otherwise("mismatch"))
    outcome = outcome.otherwise("unproven")
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(NOT_MERGED))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k))
    met = met.withColumn("outcome", outcome)
    return met.select("record_id", "url_key", "source_id", "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, fresh)).alias("headers"))


def with_bodies(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their source, of responses ``(record_id, body)``."""
    bodies = responses.select(F.col("record_id").alias("source_id"), "body").dropDuplicates(["source_id"])
    return resolved.where("outcome = 'resolved'").join(bodies, "source_id")


def header_lines(headers: Column) -> Column:
    """The map as sorted lines ``name: value``."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
