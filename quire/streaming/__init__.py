"""Stateless ingestion of document files."""
