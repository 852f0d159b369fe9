"""Readers and writers for the formats the pipelines land on disk."""
