"""All registered queries and their checking SQL."""
from citegrove.plans import queries_core, queries_eval, queries_variants
from citegrove.plans.queries_core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_core", "queries_eval", "queries_variants"]
