"""``op9_sparse_suffixes``: passages of 50 and more words that occur twice or more."""

from lotwise.llm.registry import query, table
from lotwise.llm.sparse_suffixes import repeated_passages


@query("op9_sparse_suffixes")
def op9_sparse_suffixes(spark, sf):
    return repeated_passages(table(spark, sf, "documents"))
