"""Compositions of operators: pipelines, audit, the query catalog."""
