"""Part of the document-intelligence engine."""
