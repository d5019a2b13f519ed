"""Plans of the document-extraction engine."""
