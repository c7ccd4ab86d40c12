"""Queries and SQL of this subpackage."""

from . import ann, exact_topk, lm_scores, mixing, near_dups, secret_scan, sentence_pieces, token_counts, token_output, toxicity

MODULES = [token_output, toxicity, secret_scan, mixing, sentence_pieces, near_dups, exact_topk, ann, lm_scores, token_counts]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
