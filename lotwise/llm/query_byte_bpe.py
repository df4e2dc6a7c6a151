"""``op12_byte_bpe``: every document encoded by a public vocabulary, and decoded again."""

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm.byte_bpe import decoded_batches, encoded_batches, share
from lotwise.llm.registry import query, table

_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(batches):
    """Digests of (doc_id, text, ids, decoded)."""
    for batch in batches:
        ids = [row.values.to_numpy(zero_copy_only=False).astype("<u4") for row in batch.column(2)]
        columns = [
            batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column(3)], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@query("op12_byte_bpe")
def op12_byte_bpe(spark, sf):
    """The maps of ``encode`` and ``decode`` in one pass, so that ids and texts stay in the task."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = share(spark, public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoded_batches(shared, 1, 2, ["doc_id", "text", "ids"])
    decode = decoded_batches(shared, 2, 3, ["doc_id", "text", "ids", "decoded"])
    return docs.mapInArrow(lambda batches: digests(decode(encode(batches))), _DIGESTS)
