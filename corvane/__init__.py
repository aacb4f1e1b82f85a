"""Retrieval, knowledge-graph and citation-checking analytics on Spark."""
