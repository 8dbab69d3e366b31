"""Readers and writers: golden tables, extractions, run reports, documents, sinks."""
