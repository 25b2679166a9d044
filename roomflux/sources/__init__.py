"""Readers and writers of documents: JSON files, documents within pages and scripts, listings of files."""
