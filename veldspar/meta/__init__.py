"""Metadata: dump and load of definitions, comparison of schemas, generated model code."""
