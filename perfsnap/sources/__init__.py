"""Readers for marker-delimited dumps, section schemas, and the dump renderer."""
