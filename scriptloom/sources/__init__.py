"""Readers, writers and fixed catalogs."""
