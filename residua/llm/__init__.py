"""Training-data operators: deduplication, scoring, filtering and packing of documents.

Nothing outside this subpackage imports it.
"""
