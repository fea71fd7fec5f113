"""Readers and writers for site tables, signal vectors, annotations and sequences."""
