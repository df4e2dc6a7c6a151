"""``op1_secrets``: secrets in every document."""

from pyspark.sql import functions as F

from lotwise.llm.registry import query, table
from lotwise.llm.secrets import ALLOWED, ALLOWED_WORDS, CLASSES, KINDS, SCALE, WINDOW, listed, scan


def _sql():
    letters = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
    words = "|".join(letters.values()) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = rf"""(?:{words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    patterns = [assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", *[p for _, p, _ in CLASSES]]
    least = [0, 16, 32, WINDOW, WINDOW]
    found = "UNION ALL".join(f"""
  SELECT r, {rank} AS rank, unnest(range(1, len(m) + 1)) AS i, m, v,
         list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, {n} AS least
  FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {int(rank == 0)}) AS v FROM d)
""" for rank, (p, n) in enumerate(zip(patterns, least)))
    limits = " ".join(
        f"WHEN {3 + i} THEN CAST(floor({WINDOW} * (log2({WINDOW}) - {bound}) * {SCALE}) AS BIGINT)"
        for i, (_, _, bound) in enumerate(CLASSES)
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
h AS (
  SELECT r, rank, m[i] AS word,
         CAST(list_sum(list_slice(gaps, 1, i)) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS INTEGER) AS s
  FROM f WHERE CASE WHEN rank = 0 THEN length(v[i]) >= 8 ELSE length(m[i]) >= least END),
b AS (SELECT r, rank, s, s + length(word) AS e FROM h WHERE rank < 3),
w AS (
  SELECT r, rank, s + i - 1 AS s, s + i - 1 + {WINDOW} AS e, substr(word, i, {WINDOW}) AS characters,
         (SELECT sum(CAST(round(c * log2(c) * {SCALE}) AS BIGINT)) FROM
           (SELECT unnest(map_values(list_aggregate(string_split(substr(word, i, {WINDOW}), ''), 'histogram'))) AS c)) AS total
  FROM (SELECT *, unnest(range(1, length(word) - {WINDOW} + 2)) AS i FROM h
        WHERE rank >= 3 AND NOT regexp_matches(word, '{ALLOWED}'))),
g AS (SELECT r, rank, s, e FROM w WHERE total <= CASE rank {limits} END AND NOT regexp_matches(characters, '{ALLOWED_WORDS}')),
j AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r, rank ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY r, rank ORDER BY s) AS part FROM j),
a AS (SELECT r, rank, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e FROM k GROUP BY r, rank, part),
n AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = a.r AND b.s <= a.s AND a.e <= b.e)),
spans AS (
  SELECT r, string_agg({kinds}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) AS l
  FROM (SELECT * FROM b UNION ALL SELECT * FROM n) GROUP BY r),
base AS (
  SELECT r, string_agg({kinds}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) AS l,
         count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
  FROM b GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base.l, '')) AS base_sha256, coalesce(spans.l, '') AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN spans USING (r)
"""


def _number_of(rank):
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")


@query("op1_secrets", _sql())
def op1_secrets(spark, sf):
    found = scan(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [_number_of(rank).alias(f"n_{name}") for rank, name in enumerate(KINDS[:3])]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
