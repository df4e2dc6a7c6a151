"""``op10_suffix_groups``: documents without their repeated passages of 35 words."""

from pyspark.sql import functions as F

from lotwise.llm.registry import query, table
from lotwise.llm.suffix_groups import remove_repeats

SQL = """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT r, i, sha256(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS p FROM rep, (SELECT unnest(range(35)) AS j)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""


@query("op10_suffix_groups", SQL)
def op10_suffix_groups(spark, sf):
    kept = remove_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return kept.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256")
    )
