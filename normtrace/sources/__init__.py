"""Readers, writers and column plumbing at the edges of a plan."""
