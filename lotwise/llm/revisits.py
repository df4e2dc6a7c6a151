"""Not-modified revisits: the stored response that a 304 record stands for.

A revisit belongs to the latest earlier full response of its canonical URL.  Its validators must
agree with that response (entity tags compared weakly, else the modification time); then the
stored headers are updated with those that a 304 may change, and the stored payload is referred to.

The as-of join is one window.  A URL may hold a third of all records, so time is cut into SLOTS of
about equally many records: the window runs inside (URL, slot), the last response of each slot is
pre-aggregated, and a second window over at most SLOTS rows a URL carries it to later slots.  Only
DataFrame functions are used.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

SLOTS = 64
#: fields that a 304 response sends to update a stored one (RFC 9110, 15.4.5), and the modification time
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: query fields that name a visit, not a page
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url):
    """Host in lower case without ``www.`` and default port, path without its last slash, and the
    sorted query without tracking fields; no scheme and no fragment.  Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    fields = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    fields = F.array_join(F.array_sort(F.filter(fields, lambda f: (f != "") & ~f.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(fields != "", F.concat(F.lit("?"), fields)).otherwise(""))


def resolve_revisits(records, permitted=PERMITTED):
    """One row per revisit: ``record_id``, ``url_key``, ``refers_to``, ``outcome``, ``headers``, ``digest``.

    ``records`` has ``record_id``, ``url``, ``time`` (any ordered type that casts to double),
    ``kind`` (``response`` is full, ``revisit`` is not modified), ``headers`` (lower-case names to
    values) and ``digest`` of the payload.  ``outcome`` is ``resolved``, ``mismatch`` (a validator
    differs, or none is shared) or ``missing`` (no earlier response; also where URL or time is
    null).  Only resolved rows have ``headers`` and ``digest``; ``refers_to`` is set for mismatches
    too.  Of responses at one time the largest ``record_id`` counts as latest; one at the time of
    the revisit is not earlier.  Repeated revisits are resolved each; other kinds and columns are
    ignored.
    """
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("double").alias("at"),
        (F.col("kind") == "response").alias("full"), "headers", "digest",
    )
    response = F.when(
        F.col("full") & F.col("at").isNotNull(), F.struct("at", "record_id", "headers", "digest")
    )
    placed = rows.withColumn("slot", _slot(rows)).withColumn("response", response)
    inside = Window.partitionBy("url_key", "slot").orderBy("at", "full", "record_id")
    seen = placed.withColumn(
        "here", F.last("response", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    ends = placed.groupBy("url_key", "slot").agg(
        F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("at", "record_id"))).alias("end")
    )
    slots = Window.partitionBy("url_key").orderBy("slot")
    carried = ends.select(
        F.col("url_key").alias("of_url"), F.col("slot").alias("of_slot"),
        F.last("end", ignorenulls=True).over(slots.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
    ).filter("carried is not null")
    revisits = seen.filter(~F.col("full"))
    same = (F.col("url_key") == F.col("of_url")) & (F.col("slot") == F.col("of_slot"))
    joined = revisits.join(carried, same, "left").withColumn("stored", F.coalesce("here", "carried"))
    usable = F.col("url_key").isNotNull() & F.col("at").isNotNull() & F.col("stored").isNotNull()
    agreed = _agree(F.col("stored.headers"), F.col("headers"))
    outcome = F.when(~usable, "missing").when(agreed, "resolved").otherwise("mismatch")
    merged = _merge(F.col("stored.headers"), F.col("headers"), permitted)
    resolved = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url_key",
        F.when(F.col("outcome") != "missing", F.col("stored.record_id")).alias("refers_to"),
        "outcome",
        F.when(resolved, merged).alias("headers"),
        F.when(resolved, F.col("stored.digest")).alias("digest"),
    )


def _slot(rows):
    """Number of the time slot, by approximate quantiles; null times share slot 0."""
    shares = [i / SLOTS for i in range(1, SLOTS)]
    found = rows.agg(F.percentile_approx("at", shares, 1_000).alias("cuts")).first().cuts or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(found))]) if found else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("at"))), F.lit(0))


def _tag(headers):
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def _agree(stored, sent):
    """Equal entity tags where both have one; else equal modification times where both have one."""
    changed = F.element_at(stored, "last-modified") == F.element_at(sent, "last-modified")
    return F.coalesce(_tag(stored) == _tag(sent), changed, F.lit(False))


def _merge(stored, sent, permitted):
    allowed = F.map_filter(sent, lambda name, _: name.isin(permitted))
    kept = F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.map_concat(kept, allowed)
