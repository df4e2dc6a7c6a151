"""``op5_revisits``: the 304 records of a crawl log made from ``pages``, resolved.

Every page gives up to four captures: a response, a later changed response for one page in three,
and two revisits, of which some come before any response, carry another entity tag or none.
"""

from pyspark.sql import functions as F

from lotwise.llm.registry import query, table
from lotwise.llm.revisits import resolve_revisits

SQL = """
WITH c AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, unnest([0, 1, 2, 3]) AS k FROM pages),
r AS (
  SELECT page_id * 4 + k AS record_id, k, url,
         CASE k WHEN 0 THEN 100 WHEN 1 THEN 250 WHEN 2 THEN CASE WHEN page_id % 5 = 0 THEN 50 ELSE 200 END ELSE 300 END
           + page_id % 89 AS at,
         CASE WHEN k <= 1 THEN tag || CAST(k AS VARCHAR) ELSE NULL END AS digest,
         CASE k WHEN 0 THEN '"' || tag || '"' WHEN 1 THEN '"' || tag || '-1"'
                WHEN 2 THEN CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/"' || tag || '"' END
                ELSE CASE WHEN page_id % 3 = 0 THEN '"' || tag || '-1"' END END AS etag,
         'day ' || CAST(page_id % 28 AS VARCHAR) AS changed,
         page_id
  FROM c WHERE k <> 1 OR page_id % 3 = 0),
u AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM r),
v AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
           lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS fields
  FROM u),
n AS (SELECT *, host || path || CASE WHEN fields <> '' THEN '?' || fields ELSE '' END AS url_key FROM v),
p AS (
  SELECT a.record_id, a.url_key, a.k, a.page_id, a.etag, a.changed, b.record_id AS refers_to, b.etag AS stored,
         b.changed AS stored_changed, b.digest, b.page_id AS stored_page
  FROM n a LEFT JOIN n b ON a.url_key = b.url_key AND b.k <= 1 AND b.at < a.at
  WHERE a.k > 1
  QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY b.at DESC NULLS LAST, b.record_id DESC) = 1),
o AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'missing'
                 WHEN coalesce(regexp_replace(etag, '^W/', '') = stored, changed = stored_changed, false) THEN 'resolved'
                 ELSE 'mismatch' END AS outcome
  FROM p)
SELECT record_id, url_key, refers_to, outcome,
       CASE WHEN outcome = 'resolved' THEN
         'cache-control: max-age=' || CAST(60 * k AS VARCHAR) || chr(10) || 'content-length: 1' || chr(10)
         || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(etag, stored) || chr(10)
         || 'last-modified: ' || changed END AS headers,
       CASE WHEN outcome = 'resolved' THEN digest END AS digest
FROM o
"""


def captures(pages):
    """The crawl log: record_id, url, time, kind, headers, digest."""
    page, k = F.col("page_id"), F.col("k")
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    rows = rows.filter((k != 1) | (page % 3 == 0))
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    first = F.when(page % 5 == 0, 50).otherwise(200)
    time = F.when(k == 0, 100).when(k == 1, 250).when(k == 2, first).otherwise(300) + page % 89
    etag = (
        F.when(k == 0, quoted(F.col("tag")))
        .when(k == 1, quoted(F.col("tag"), F.lit("-1")))
        .when((k == 2) & (page % 7 == 0), F.lit('"other"'))
        .when(k == 2, F.concat(F.lit("W/"), quoted(F.col("tag"))))
        .when(page % 3 == 0, quoted(F.col("tag"), F.lit("-1")))
    )
    headers = F.create_map(
        F.lit("content-type"), F.when(k <= 1, "text/html").otherwise("none"),
        F.lit("content-length"), F.when(k <= 1, "1").otherwise("0"),
        F.lit("cache-control"), F.concat(F.lit("max-age="), (60 * k).cast("string")),
        F.lit("last-modified"), F.concat(F.lit("day "), (page % 28).cast("string")),
        F.lit("etag"), etag,
    )
    return rows.select(
        (page * 4 + k).alias("record_id"), "url", time.alias("time"),
        F.when(k <= 1, "response").otherwise("revisit").alias("kind"),
        F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers"),
        F.when(k <= 1, F.concat("tag", k.cast("string"))).alias("digest"),
    )


@query("op5_revisits", SQL)
def op5_revisits(spark, sf):
    found = resolve_revisits(captures(table(spark, sf, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))
