"""``op3_vector_search``: five best inner products of every fiftieth vector."""

from pyspark.sql import functions as F

from lotwise.llm.registry import query, table
from lotwise.llm.vector_search import top_k, whole_components

SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""


@query("op3_vector_search", SQL)
def op3_vector_search(spark, sf):
    vectors = whole_components(table(spark, sf, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
