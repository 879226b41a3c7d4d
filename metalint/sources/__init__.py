"""Readers, row-level flattening of documents, and sinks."""
