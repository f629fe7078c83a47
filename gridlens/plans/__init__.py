"""Composite datasets, bindings of the test tables, and the query registry."""
