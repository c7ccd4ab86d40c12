"""Columns: times, buckets, predicates and metrics, all built-in expressions."""
