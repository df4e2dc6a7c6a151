"""All registered queries."""

from lotwise.queries import evaluation, files, ledger, prep, sampling, scoring, training, updates  
from lotwise.queries.registry import ORACLES, QUERIES

flagship = training.flagship
__all__ = ["ORACLES", "QUERIES", "flagship"]
