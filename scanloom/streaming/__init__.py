"""Streaming of the document-extraction engine."""
