"""``op11_fill_in_middle``: every document rearranged for filling its middle, and rebuilt."""

from pyspark.sql import functions as F

from lotwise.llm.fill_in_middle import rearrange, restored
from lotwise.llm.registry import query, table

SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
e AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""


@query("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark, sf):
    done = rearrange(table(spark, sf, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return done.select(
        "doc_id", "fim.n", "fim.form", F.col("fim.prefix").alias("prefix_chars"), F.col("fim.middle").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"),
    )
