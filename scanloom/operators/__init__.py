"""Operators of the document-extraction engine."""
