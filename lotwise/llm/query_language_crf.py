"""``op8_language_crf``: language of every document, learned from two thirds of them."""

from pyspark.sql import functions as F

from lotwise.llm.language_crf import fit, label
from lotwise.llm.registry import query, table


def held_out(doc_id):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op8_language_crf")
def op8_language_crf(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter(~F.col("held_out")).select("text", "lang"))
    return label(docs.select("doc_id", "held_out", "text"), model, with_spans=False).drop("text")
