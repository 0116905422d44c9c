"""Operators: statistics, predicates, joins, workload shaping, rewrites, execution and metrics."""
