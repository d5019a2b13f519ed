"""Sources of the document-extraction engine."""
