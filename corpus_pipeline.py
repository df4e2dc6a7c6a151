"""A pipeline over ``documents``: stages that each apply one operator to what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from pyspark.sql import functions as F

from lotwise.llm.decontamination import without_matches
from lotwise.llm.language_crf import UNKNOWN, fit, label
from lotwise.llm.near_duplicates import kept_documents
from lotwise.llm.packing import pack, word_lengths
from lotwise.llm.query_language_crf import held_out
from lotwise.llm.secrets import redact
from lotwise.llm.tables import commit

#: a text in which no language holds this share of the words is rejected
LANGUAGE_SHARE = 0.3


def language_id(spark, docs, sf_dir):
    """Rejects texts without a letter and those in which no language has LANGUAGE_SHARE of the words."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    labelled = label(docs, model, with_spans=False)
    kept = labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
    return kept.select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each class of near duplicates."""
    return kept_documents(docs)


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold an item of ``benchmark``."""
    return without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scan_secrets(spark, docs, sf_dir):
    """Masks secrets in the texts; every document stays."""
    return redact(docs, size="n_chars")


def pack_sequences(spark, docs, sf_dir):
    """Places the documents in sequences of permitted lengths."""
    return pack(word_lengths(docs))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", scan_secrets),
    ("best-fit packing", pack_sequences),
]
#: language ID, near-dedup, edit matching and packing have no SQL form; tests compare them with brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = commit(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
