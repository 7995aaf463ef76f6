"""Incremental forms of ingest, conversation append and catalog upsert."""
