"""Not-modified revisits of a web archive: which earlier response does each stand for?

A crawler that gets "not modified" stores a revisit record without a body. It stands for the latest full response of
the same canonical URL that was captured earlier. The validators of the two must agree, and the revisit's own headers
replace those of the stored response, except the ones that describe the body or the connection.

The as-of join is a range partition of thin rows by (URL, time), a running ``last`` inside each partition, and a
hand-over of the last response of a URL to later partitions. One URL with a third of all captures is spread over many
partitions, and what is handed over is one row per URL and partition. Bodies are not part of it; ``with_bodies`` joins
them by record id.

Defined results, in ``status``:
    resolved     an earlier response was found and every validator that both records have is equal
    unverified   one was found, but the two have no validator in common
    mismatch     one was found and a validator differs; base_id names it, headers stay the revisit's own
    no_base      the URL has no earlier full response
    invalid      the revisit has no URL or no date
Of responses at one instant the one with the greatest record id counts as latest; a response at the instant of the
revisit counts as earlier. Records of other types, and responses with a status other than 200, neither resolve nor
are resolved. Null headers are none; header names are compared without case; of repeated validators the first counts.
Rows repeated in full are resolved each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltawarden.llm.common import same
from deltawarden.session import cut_lineage

# The profile of a "not modified" revisit, and headers that a revisit may not replace: those of the
# connection, and those that describe a body the revisit does not have.
NOT_MODIFIED = "server-not-modified"
NOT_REPLACED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te",
    "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
)
VALIDATORS = ("etag", "last-modified")
HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., no scheme, default port, fragment, tracking parameters or closing slash; the
    remaining parameters in order."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(
        r"^(utm_[a-z]+|jsessionid|phpsessid|sid|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(""))


def _headers(column: Column) -> Column:
    return F.filter(F.coalesce(column, F.array().cast(HEADERS)), lambda h: h.isNotNull() & h["name"].isNotNull())


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.get(found, F.lit(0))["value"]


def _validators(headers: Column) -> Column:
    """Strong and weak entity tags compare alike: a revisit only says that the stored body may be used."""
    tag = F.regexp_replace(F.trim(header(headers, "etag")), r"^[Ww]/", "")
    return F.struct(tag.alias("etag"), F.trim(header(headers, "last-modified")).alias("last_modified"))


def merged_headers(base: Column, update: Column) -> Column:
    """Headers of the base with those of the update in place of equal names; base order first, then update order."""
    connection = F.transform(F.split(F.lower(F.coalesce(header(update, "connection"), F.lit(""))), ","), lambda n: F.trim(n))
    allowed = F.filter(update, lambda h: ~F.lower(h["name"]).isin(*NOT_REPLACED)
                       & ~F.array_contains(connection, F.lower(h["name"])))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(base, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def latest_before(events: DataFrame, key: str, when: str, value: str, partitions: int | None = None) -> DataFrame:
    """Add ``found``: the last non-null ``value`` at or before each row, within its key.

    events has key, when, tie (an orderable column that puts values before askers at one instant) and value.
    """
    spark = events.sparkSession
    wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(events.repartitionByRange(wanted, key, when, "tie").withColumn(
        "part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "part").orderBy(when, "tie").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("local", F.last(value, ignorenulls=True).over(inside))
    # What a partition hands over for a URL: one row, however many captures it has.
    last = dealt.where(F.col(value).isNotNull()).groupBy(key, "part").agg(
        F.max(F.struct(F.col(when).alias("at"), "tie", F.col(value).alias("value"))).alias("last"))
    touched = dealt.select(key, "part").distinct().join(last, [key, "part"], "left")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = touched.select(key, "part", F.last(F.col("last")["value"], ignorenulls=True).over(before).alias("handed"))
    return local.join(handed, [key, "part"]).withColumn("found", F.coalesce("local", "handed")).drop(
        "local", "handed", "part")


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per not-modified revisit.

    records: record_id, warc_type, profile, target_uri, captured_at (timestamp), http_status and http_headers
    (array of name, value); further columns are not read.
    """
    headers = _headers(records["http_headers"])
    thin = records.select(
        "record_id", "warc_type", records["profile"].alias("profile"), "target_uri", "captured_at", "http_status",
        headers.alias("headers"), canonical_url(records["target_uri"]).alias("url_key"))
    revisits = thin.where((F.col("warc_type") == "revisit") & F.col("profile").contains(NOT_MODIFIED))
    valid = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()
    full = (F.col("warc_type") == "response") & (F.col("http_status") == 200)
    base = F.struct(F.col("record_id").alias("base_id"), F.col("captured_at").alias("base_captured_at"),
                    F.col("headers").alias("base_headers"))
    is_revisit = (F.col("warc_type") == "revisit") & F.col("profile").contains(NOT_MODIFIED)
    events = thin.where(valid & (full | F.coalesce(is_revisit, F.lit(False)))).select(
        "url_key", "captured_at", F.struct((~full).cast("int").alias("asks"), "record_id").alias("tie"),
        F.when(full, base).alias("base"), "target_uri", "headers")
    found = latest_before(events, "url_key", "captured_at", "base", partitions).where("tie.asks = 1").select(
        F.col("tie.record_id").alias("record_id"), "target_uri", "captured_at", "url_key", "headers", "found")
    lost = revisits.where(~valid).select("record_id", "target_uri", "captured_at", "url_key", "headers").withColumn(
        "found", F.lit(None).cast(found.schema["found"].dataType)).withColumn("lost", F.lit(True))
    rows = found.withColumn("lost", F.lit(False)).unionByName(lost)
    own, stored = _validators(F.col("headers")), _validators(F.col("found")["base_headers"])
    checked = rows.withColumns({"own": own, "stored": stored})
    fields = ("etag", "last_modified")
    common = [F.col("own")[f].isNotNull() & F.col("stored")[f].isNotNull() for f in fields]
    differs = [c & (F.col("own")[f] != F.col("stored")[f]) for c, f in zip(common, fields, strict=True)]
    status = (F.when(F.col("lost"), "invalid").when(F.col("found").isNull(), "no_base")
              .when(differs[0] | differs[1], "mismatch").when(common[0] | common[1], "resolved")
              .otherwise("unverified"))
    merged = F.when(status.isin("resolved", "unverified"),
                    merged_headers(F.col("found")["base_headers"], F.col("headers"))).otherwise(F.col("headers"))
    return checked.select(
        "record_id", "target_uri", "captured_at", "url_key", status.alias("status"),
        F.col("found")["base_id"].alias("base_id"), F.col("found")["base_captured_at"].alias("base_captured_at"),
        merged.alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """Add the body of the response that each resolved or unverified revisit stands for; null for the others."""
    bodies = records.where("warc_type = 'response'").select(
        F.col("record_id").alias("body_of"), F.col(body).alias("body"))
    usable = F.when(resolved["status"].isin("resolved", "unverified"), resolved["base_id"])
    return resolved.join(bodies, same(usable, F.col("body_of")) & usable.isNotNull(), "left").drop("body_of")
