"""``op13_resampling``: documents resampled towards the texts of ``benchmark``."""

from lotwise.llm.registry import query, table
from lotwise.llm.resampling import resample

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word FROM d),
g AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
step AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS of
  FROM (SELECT unnest(range(256)) AS i)),
crc AS (
  SELECT word, CAST(xor(list_reduce(
    list_transform(range(length(hex(encode(word))) // 2), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(of[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM g)), step),
s AS (SELECT bucket, count(*) AS s FROM w JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN crc USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM w) AS ns, (SELECT count(*) FROM g) AS nt),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ns + 10000 AS DOUBLE)
         / (CAST(s + 1 AS DOUBLE) * CAST(nt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), n),
weight AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE)
         + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (r)),
drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= 10 * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN drawn USING (r)
"""


@query("op13_resampling", SQL)
def op13_resampling(spark, sf):
    drawn = resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
