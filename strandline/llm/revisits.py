"""Not-modified revisits of a web archive resolved to the responses they stand for (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common

#: Headers that a 304 answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change what a URL shows.
TRACKING = "^(utm_[a-z_]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a slash at its end, other parameters sorted.

    Scheme and fragment are dropped; a null stays null; a text that is no http URL is kept as it is, trimmed.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"^[A-Za-z]+://([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(whole, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    rebuilt = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(whole.rlike("^[A-Za-z]+://[^/?]"), rebuilt).otherwise(F.trim(url))


def resolve(records: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """One row for each revisit: the latest earlier full response of its canonical URL, if the validators agree.

    ``records``: record_id, ts (long), kind (response or revisit), url, etag, last_modified, digest, headers (map with
    lower-case names). Result: record_id, url_key, ts, status, response_id, digest, headers. Status is resolved,
    validator_mismatch (an ETag, else a Last-Modified, differs from the response's or is missing on one side; with
    neither on the revisit nothing contradicts) or no_response; response_id, digest and headers are null unless
    resolved. Headers are the response's, with the revisit's permitted ones over them.

    Earlier means a smaller (ts, record_id), so of records with equal ts the ids decide; equal ids as well: any. A null
    ts comes first. A null url resolves to nothing. Repeated rows are revisits of their own. Time is cut into ranges of about equal numbers of records, so one URL's rows are spread over
    tasks; what a range takes over from those before is one row for each URL and range. Other columns are
    ignored, also ones named range, near or far. An empty table gives none.
    """
    spark = records.sparkSession
    n = n_ranges or _common.parts(spark)
    own = records.select(
        "record_id", "ts", "kind", canonical_url(F.col("url")).alias("url_key"), "etag", "last_modified", "digest", "headers"
    )
    bounds = own.select("ts").approxQuantile("ts", [k / n for k in range(1, n)], 0.01) if n > 1 else []
    cuts = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]).cast("array<bigint>")
    own = own.withColumn("range", F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col("ts"))), F.lit(0)))
    own = own.withColumn("range", F.when(F.col("ts").isNull(), -1).otherwise(F.col("range")))
    known, nowhere = own.where("url_key is not null"), own.where("url_key is null and kind = 'revisit'")
    full = F.when(
        F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    )
    order = Window.partitionBy("url_key", "range").orderBy("ts", "record_id")
    within = known.withColumn("near", F.last(full, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = known.where("kind = 'response'").groupBy("url_key", "range").agg(
        F.max_by(F.struct("record_id", "etag", "last_modified", "digest", "headers", "ts"), F.struct("ts", "record_id")).alias("last")
    )
    asked = known.where("kind = 'revisit'").select("url_key", "range").distinct()
    marks = ends.unionByName(
        asked.select("url_key", "range", F.lit(None).cast(ends.schema["last"].dataType).alias("last"))
    ).groupBy("url_key", "range").agg(F.first("last", True).alias("last"))
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "range", F.last("last", True).over(before).alias("far")).where("far is not null")
    within = within.where("kind = 'revisit'").unionByName(nowhere.withColumn("near", F.lit(None).cast(within.schema["near"].dataType)))
    found = within.join(carried, ["url_key", "range"], "left")

    def pick(name: str) -> Column:
        return F.when(F.col("near").isNotNull(), F.col(f"near.{name}")).otherwise(F.col(f"far.{name}"))

    # a revisit without validators of its own has nothing that could differ
    fits = F.when(F.col("etag").isNotNull(), F.coalesce(F.col("etag") == pick("etag"), F.lit(False))).when(
        F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == pick("last_modified"), F.lit(False))
    ).otherwise(True)
    there = (F.col("near").isNotNull() | F.col("far").isNotNull()) & F.col("url_key").isNotNull()
    status = F.when(~there, "no_response").when(fits, "resolved").otherwise("validator_mismatch")
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", empty), lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce(pick("headers"), empty), lambda k, _: ~F.map_contains_key(new, k))
    done = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "url_key", "ts", "status",
        F.when(done, pick("record_id")).alias("response_id"),
        F.when(done, pick("digest")).alias("digest"),
        F.when(done, F.map_concat(old, new)).alias("headers"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """Adds the payload of the response that stands behind each row (``responses``: record_id, payload)."""
    return resolved.join(responses.select(F.col("record_id").alias("response_id"), "payload"), "response_id", "left")


def pages_to_records(pages: DataFrame) -> DataFrame:
    """A crawl's records in mixed order: pages are fetched one after the other, and each again while others are fetched.

    Page p is a full response at 10 p (if it has html) and, if p is even, a changed one at 10 p + 50. It is asked for
    with the first ETag at 10 p - 5, before any answer, and at 10 p + 35; and at 10 p + 75 with the ETag of the latest
    of its answers, but every third page sends the first one. All three are answered with 304. Record ids are 8 p + k.
    """
    p = F.col("page_id")
    text = F.coalesce("html", F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.md5(text).alias("e1"), F.md5(F.concat(F.lit("2:"), text)).alias("e2"),
        F.length(text).cast("string").alias("size"), F.col("html").isNotNull().alias("full"),
    )
    even = F.pmod(p, F.lit(2)) == 0

    def record(k: int, at: int, kind: str, etag: Column, there: Column) -> Column:
        ts = p * 10 + at
        response = kind == "response"
        names = [F.lit("content-length"), F.col("size") if response else F.lit("0"), F.lit("date"), ts.cast("string")]
        return F.when(there, F.struct(
            (p * 8 + k).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("kind"), F.col("url").alias("url"), etag.alias("etag"),
            F.lit(None).cast("string").alias("last_modified"), (etag if response else F.lit(None).cast("string")).alias("digest"),
            F.create_map(*names, *([F.lit("etag"), etag] if response else [])).alias("headers"),
        ))

    e1, e2, yes = F.col("e1"), F.col("e2"), p.isNotNull()
    third = F.when(even & (F.pmod(p, F.lit(3)) != 0), e2).otherwise(e1)
    records = F.array(
        record(0, 0, "response", e1, yes & F.col("full")), record(1, 50, "response", e2, even & F.col("full")),
        record(2, -5, "revisit", e1, yes), record(3, 35, "revisit", e1, yes), record(4, 75, "revisit", third, yes),
    )
    return own.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve(_common.stage(pages_to_records(pages), "captures"))
    return found.select(
        "record_id", "url_key", "ts", "status", "response_id", "digest",
        F.col("headers")["content-length"].alias("content_length"), F.col("headers")["date"].alias("date"),
        F.col("headers")["etag"].alias("etag"),
    )


OP10_SQL = r"""
with p as (
  select page_id, md5(coalesce(html, '')) as e1, md5('2:' || coalesce(html, '')) as e2, length(coalesce(html, ''))::varchar as size, html is not null as is_full,
    trim(url) as u, regexp_replace(trim(url), '#.*$', '') as w from pages
), k as (
  select *, list_sort(list_filter(string_split(regexp_extract(w, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z_]*|ref|fbclid|gclid)(=|$)'))) as kept from p
), c as (
  select page_id, e1, e2, size, is_full, case when regexp_matches(w, '^[A-Za-z]+://[^/?]') then
      regexp_replace(lower(regexp_extract(w, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
      || regexp_replace(regexp_extract(w, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '')
      || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end
    else u end as url_key from k
), f as (
  select url_key, 10 * page_id as ts, 8 * page_id as record_id, e1 as etag, size from c where is_full
  union all select url_key, 10 * page_id + 50, 8 * page_id + 1, e2, size from c where is_full and page_id % 2 = 0
), r as (
  select url_key, 10 * page_id - 5 as ts, 8 * page_id + 2 as record_id, e1 as etag from c
  union all select url_key, 10 * page_id + 35, 8 * page_id + 3, e1 from c
  union all select url_key, 10 * page_id + 75, 8 * page_id + 4, case when page_id % 2 = 0 and page_id % 3 <> 0 then e2 else e1 end from c
), j as (
  select r.*, f.record_id as response_id, f.etag as answer, f.size from r asof left join f on r.url_key = f.url_key and r.ts > f.ts
)
select record_id, url_key, ts, case when response_id is null then 'no_response' when etag = answer then 'resolved' else 'validator_mismatch' end as status,
  case when etag = answer then response_id end as response_id, case when etag = answer then answer end as digest,
  case when etag = answer then size end as content_length, case when etag = answer then ts::varchar end as date, case when etag = answer then answer end as etag
from j
"""
