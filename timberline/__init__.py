"""Structured-log analytics on Spark: sources and formats, filters, jq predicates, queries, streaming."""
