"""Readers, writers and helpers around stored tables."""
