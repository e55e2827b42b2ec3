"""Readers and writers for flow tables, split folders and metadata records."""
