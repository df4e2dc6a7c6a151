"""``op7_packing``: every document's place in sequences of 512 to 4096 tokens."""

from lotwise.llm.packing import pack, word_lengths
from lotwise.llm.registry import query, table


@query("op7_packing")
def op7_packing(spark, sf):
    return pack(word_lengths(table(spark, sf, "documents")))
