"""All registered queries of this subpackage."""

from lotwise.llm import (  # noqa: F401
    query_byte_bpe,
    query_decontamination,
    query_fill_in_middle,
    query_language_crf,
    query_near_duplicates,
    query_packing,
    query_resampling,
    query_revisits,
    query_secrets,
    query_sparse_suffixes,
    query_suffix_groups,
    query_url_rules,
    query_vector_search,
)
from lotwise.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
